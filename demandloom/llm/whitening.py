"""Whitening of embeddings with MLlib's distributed block matrices.

Vectors become integers (``floor(256 * c)``), so that equal ones are found and counts and
sums are exact. The different vectors, centred, are the rows of a block matrix ``A``; the scatter
matrix is ``A' A``, of which the local part is one block of dimensions by dimensions. Its
eigenvectors, each over the root of its eigenvalue, are the whitening matrix, and ``A`` times that
matrix projects the rows.

Blocks hold ``BLOCK_BYTES`` of rows each. The product ``A' A`` has a single result block, so it is asked
for in as many splits of the middle dimension as there are row blocks; else all
rows would meet in one task. Only the dimensions and their square come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from demandloom.llm.common import stored

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 4 << 20
# Eigenvalues up to this share of their sum are rounding errors of zero.
ZERO = 1e-13

_ROW_BITS = 33  # of monotonically_increasing_id
_ALL = "decimal(38,0)"


def scaled(embeddings: DataFrame, vec_col: str) -> DataFrame:
    """``embeddings`` with ``x``, its vectors as integers; rows with a null vector or a null or non-finite entry go."""
    entry_is_finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    vector = F.col(vec_col).cast("array<double>")
    rows = embeddings.where(F.coalesce(F.forall(vector, entry_is_finite), F.lit(False)))
    return rows.withColumn("x", F.transform(vector, lambda c: F.floor(c * SCALE).cast("long")))


def _as_matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Rows, sums by dimension and largest absolute entry, all exact."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _as_matrix(batch.column(0))
                low, high = int(x.min()), int(x.max())
                if max(-low, high) * len(x) < 1 << 62:
                    sums = x.sum(axis=0).tolist()
                else:
                    sums = x.astype(object).sum(axis=0).tolist()
                rows = [len(x), *sums]
                yield pa.RecordBatch.from_pydict(
                    {
                        "at": pa.array(range(len(rows)), pa.int32()),
                        "total": pa.array(map(str, rows), pa.string()),
                        "most": pa.array([str(max(-low, high))] * len(rows), pa.string()),
                    }
                )

    parts = fit.select("x").mapInArrow(each, "at int, total string, most string")
    found = parts.groupBy("at").agg(
        F.sum(F.col("total").cast(_ALL)).cast("string").alias("total"), F.max(F.col("most").cast(_ALL)).cast("string").alias("most")
    )
    totals = sorted((row.at, int(row.total), int(row.most)) for row in found.toLocalIterator())
    return totals[0][1], [total for _, total, _ in totals[1:]], totals[0][2]


def _with_index(fit: DataFrame) -> DataFrame:
    """``fit`` with ``index``, 0, 1, 2 and so on: ids count within the tasks that wrote them, and tasks follow each other."""
    task = F.shiftright("id", _ROW_BITS)
    sizes = fit.groupBy(task.alias("task")).agg(F.count("*").alias("n"))  # one row per task
    begun, offsets = 0, {}
    for row in sorted(sizes.toLocalIterator()):
        offsets[row.task] = begun
        begun += row.n
    table = fit.sparkSession.createDataFrame(list(offsets.items()), "of_task long, begun long")
    placed = fit.withColumn("task", task).join(F.broadcast(table), F.col("task") == F.col("of_task"))
    return placed.select("id", "x", (F.col("begun") + F.col("id").bitwiseAND((1 << _ROW_BITS) - 1)).alias("index"))


def _block_matrix(rows: DataFrame, n: int, width: int, block_rows: int) -> BlockMatrix:
    """``(index, vector)`` rows as a block matrix as wide as one block."""
    rows = MLUtils.convertVectorColumnsFromML(rows, "vector")
    return IndexedRowMatrix(rows, n, width).toBlockMatrix(block_rows, width)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left.multiply(right)`` with its middle dimension in ``splits``, which Python's method does not offer."""
    other = right._java_matrix_wrapper._java_model
    product = left._java_matrix_wrapper.call("multiply", other, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _deviations(rows: DataFrame, n: int, sums: list[int], most: int) -> DataFrame:
    """``rows`` with ``deviation``, the sum over dimensions of ``(n x - S)^2``; null above 38 digits."""
    small = len(sums) * (n * most + max(map(abs, sums))) ** 2 < 1 << 63
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _as_matrix(batch.column(names.index("x")))
            if small:
                away = n * x - np.array(sums, dtype=np.int64)
                found = np.einsum("ij,ij->i", away, away).tolist()
            else:
                away = n * x.astype(object) - np.array(sums, dtype=object)
                found = (away * away).sum(axis=1).tolist()
            texts = [str(value) if value < 10**38 else None for value in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "deviation"])

    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
    return rows.mapInArrow(each, f"{kinds}, deviation string").withColumn("deviation", F.col("deviation").cast(_ALL))


def whiten(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    components: int = COMPONENTS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component.

    Vectors that are null or hold null or non-finite entries go, and so do vectors of another
    length than the commonest (the longer of equally common ones), which have no place in one covariance; empty vectors
    have no components. ``n`` counts the different integer vectors. A component without variance, as where there is one vector only, has
    null ``whitened``; ``explained`` is null where nothing varies, ``identity_error`` where no component does. A
    ``deviation`` above 38 digits is null. Repeated rows and null ids stay, an empty table gives an empty table,
    further columns are not read.
    """
    spark = embeddings.sparkSession
    rows = scaled(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")), "vector").select("vec_id", "x")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation {_ALL}, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if commonest is None or not commonest.d:
        return spark.createDataFrame([], schema)
    d = commonest.d
    rows = rows.where(F.size("x") == d)

    fit = stored(rows.select("x").distinct().withColumn("id", F.monotonically_increasing_id()), "fit")
    n, sums, most = _sums(fit)
    mean = F.array(*(F.lit(total / n) for total in sums))
    block_rows = max(1, block_bytes // (8 * d))
    blocks = math.ceil(n / block_rows)
    indexed = _with_index(fit)
    centred = F.zip_with("x", mean, lambda value, middle: value - middle)
    vectors = indexed.select("index", array_to_vector(centred).alias("vector"))
    if vectors.rdd.getNumPartitions() < blocks // 8:  # a task that multiplies holds a few blocks
        vectors = vectors.repartition(blocks // 8)
    matrix = _block_matrix(vectors, n, d, block_rows).persist(StorageLevel.DISK_ONLY)  # read by two products and their set-ups
    covariance = _times(matrix.transpose(), matrix, blocks).toLocalMatrix().toArray() / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    total = float(np.trace(covariance))
    m = min(components, d)
    varies = [total > 0 and value > ZERO * total for value in values[:m]]
    weights = np.column_stack([axes[:, i] / math.sqrt(values[i]) if varies[i] else np.zeros(d) for i in range(m)])

    table = [(i, Vectors.dense(row)) for i, row in enumerate(weights)]
    whitening = IndexedRowMatrix(spark.createDataFrame(table, ["index", "vector"]), d, m).toBlockMatrix(d, m)
    projected = _times(matrix, whitening, 1).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    found = found.select(F.col("index").alias("of_index"), vector_to_array("vector").alias("z"))
    with_z = indexed.join(found, F.col("index") == F.col("of_index")).select("x", "z")
    coded = stored(_deviations(with_z, n, sums, most), "whitened")
    matrix._java_matrix_wrapper.call("blocks").unpersist()

    pairs = [(i, j) for i in range(m) for j in range(i, m) if varies[i] and varies[j]]
    error = None
    if pairs:
        entries = coded.agg(*(F.covar_pop(F.col("z")[i], F.col("z")[j]) for i, j in pairs)).first()
        error = float(max(abs(value - (i == j)) for value, (i, j) in zip(entries, pairs)))
    each = F.array(
        *(
            F.struct(
                F.lit(i + 1).alias("component"),
                (F.col("z")[i] if varies[i] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(float(values[i]) / total if total > 0 else None).cast("double").alias("explained"),
            )
            for i in range(m)
        )
    )
    joined = rows.join(coded.withColumnRenamed("x", "of_x"), F.col("x") == F.col("of_x"))
    return joined.select("vec_id", "deviation", F.inline(each)).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
