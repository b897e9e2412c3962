"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that separate words: space and the five ASCII controls 9 to 13,
# which are exactly the ones that bytes.split() takes.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

# Tasks work on slices of about so many bytes of text, so that their memory
# depends on the longest text and not on the number of rows in a batch.
SLICE_BYTES = 2 * 1024**2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session with a local master, as in tests, gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where losing an executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart that differ in text; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes in column ``text_at``, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, length in enumerate(lengths):
            if held and held + length > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length + 64
        if start < len(lengths):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker stays for the tasks of other stages


def utf8_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back; deleted when the session's JVM ends.

    Smaller on disk than a checkpoint, and read by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
