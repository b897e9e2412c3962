"""Run queries against DuckDB: ``python -m tests.check_all SF_DIR [name ...]``."""

import sys
import time

from demandloom import get_spark
from demandloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import connect, difference


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        begun = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                verdict = difference(df, con, ORACLES[name])
            else:
                verdict = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name} {time.time() - begun:.1f}s {verdict or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(main())
