import math
from fractions import Fraction

import numpy as np
import pytest

from demandloom.llm import whitening
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, most=4):
    """vec_id -> (n, deviation, whitened by component up to a sign, explained), with exact sums."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in ok]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    z = {x: row @ axes[:, order] / np.sqrt(values[order]) for x, row in zip(fit, centred)}
    explained = values[order] / np.trace(cov)
    return [(i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), z[x], explained) for i, x in xs]


def check(df, rows):
    want = plain(rows)
    got = df.orderBy("vec_id", "component").collect()
    assert len(got) == len(want) * min(4, len(want[0][3]))
    by_id = {}
    for row in got:
        by_id.setdefault(row.vec_id, {})[row.component] = row
    signs = None
    for i, n, deviation, z, explained in want:
        own = [by_id[i][c] for c in sorted(by_id[i])]
        assert {(r.n, int(r.deviation)) for r in own} == {(n, deviation)}
        mine = np.array([r.whitened for r in own])
        if signs is None and np.all(np.abs(z) > 1e-3):
            signs = np.sign(mine * z)
        if signs is not None:
            assert mine * signs == pytest.approx(z, abs=1e-8)
        assert [r.explained for r in own] == pytest.approx(explained, rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = QUERIES["op13_whitening"](spark, SF_DIR)
    assert dict(df.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    check(df, rows)


def test_many_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 9]]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(50)]  # repeated vectors count once
    table = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), ["x", "id", "index", "n"])
    check(whitening.whiten(table, block_bytes=7 * 8 * 5), rows)


def test_awkward_vectors(spark, tmp_path):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [0.5, -0.25]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []),
        (8, [1.0, 2.0, 3.0]), (None, [-3.0, 0.125]), (2, [1.0, 2.0]), (9, [-0.0, 0.0001]), (10, [0.0, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 2, 2, 9, 10) for c in (1, 2))
    assert {r.n for r in got} == {4}  # 9 and 10 are one integer vector
    table.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    none = QUERIES["op13_whitening"](spark, str(tmp_path))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "component", "n"]


def test_nothing_varies(spark):
    table = spark.createDataFrame([(i, [1.5, 2.0], 0) for i in range(3)], SCHEMA)
    got = whitening.whiten(table).collect()
    assert {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    flat = spark.createDataFrame([(i, [float(i), 7.0], 0) for i in range(4)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(flat).collect()}
    assert got[0, 2].whitened is None and got[0, 1].whitened is not None and got[0, 1].identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**33 * i * i + 2**30), float(-(2**35) * i)]) for i in range(5)]
    check(whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")), rows)
