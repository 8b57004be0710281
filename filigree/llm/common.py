"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER_CHARS, LOWER_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of all word and line rules: space, tab, \n, \v, \f, \r.
SPACE = b" \t\n\x0b\x0c\r"


#: Rows of an Arrow batch, where the session has Spark's default: ten thousand documents at a time are more than a worker and the JVM beside it should hold.
BATCH_ROWS, DEFAULT_ROWS = 1_000, "10000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of whole texts stay small; a setting of the user's own is left alone."""
    if spark.conf.get(_BATCH_SETTING) == DEFAULT_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where none is set (tests), a local one."""
    small_batches(spark)
    if (path := spark.conf.get("spark.checkpoint.dir", None)) is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes what a job has written to a folder of its own and needs no more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a worker holds as Python objects at a time; an Arrow batch may have many more.
SLICE_ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded size, none empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df through rows, one piece of an Arrow batch at a time; no state is kept between pieces."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := rows(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_ascii(column):
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, UPPER_CHARS, LOWER_CHARS)
