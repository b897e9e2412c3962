"""The driver contract and rules every plan keeps."""

import os
import re
from pathlib import Path
from types import SimpleNamespace

import pytest

import __spark_entry__ as contract
from demandloom.plans.catalog import ORACLES, QUERIES
from tests.plan_audit import marks, plan_of

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables not present")


@needs_data
def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["run_id", "hour", "mean_shed_w_ft2", "n_days"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cartesian_join_and_no_python(spark, name):
    found = marks(plan_of(QUERIES[name](spark, SF_DIR)))
    assert not {"cartesian", "nested", "python", "single"} & set(found)


@needs_data
def test_queries_read_the_shared_tables(spark):
    for name, query in QUERIES.items():
        if not name.endswith("round_trip") and name != "report_sqlite_files":  # read from what they write
            assert query(spark, SF_DIR).inputFiles(), name


def test_sources_keep_to_the_dataframe_api():
    files = [p for p in (ROOT / "demandloom").rglob("*.py") if "llm" not in p.parts]
    text = "\n".join(p.read_text() for p in files)
    for banned in ("crossJoin", "localCheckpoint", ".rdd", ".collect()", "toPandas", "mapPartitions"):
        assert not re.search(re.escape(banned) + r"\b", text), banned


def session_like(master, **settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key.replace(".", "_"), default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_dir_follows_the_session(spark, tmp_path):
    from demandloom import scratch_dir

    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    shared = session_like("spark://host", spark_checkpoint_dir=str(tmp_path))
    assert scratch_dir(shared, "x").startswith(str(tmp_path))
    with pytest.raises(ValueError):
        scratch_dir(session_like("spark://host"), "x")


def test_shuffles_start_from_enough_partitions():
    from demandloom.session import sized_for

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert sized_for(1)[key] == "200"
    assert sized_for(10 * 1024**4)[key] == "40960"
    assert sized_for(100 * 1024**4)[key] == "409600"
