"""What the operators of this subpackage share: table access, durable intermediates and the word rule."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Spark's setting for the bytes of an Arrow batch, its default, and what operators take in place of that default: documents are
#: long, and a task holds several copies of a batch, in the JVM and in Python.
BATCH_BYTES, BATCH_DEFAULT, BATCH_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20
#: The six characters between words, for translate().
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names. Where it is unset a local folder will do
    for a local master; on a cluster it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of the stashes that df reads, when no later plan reads them."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {name.rpartition("/")[0]: 0 for name in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def few(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if its rows, of which there are so many, are at most `most`."""
    return F.broadcast(df) if rows <= most else df


def hinted(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stash of narrow rows with a broadcast hint if it has at most `most` rows; more are left to a shuffle join."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def heavy(counted: DataFrame, count: str = "times", parts: int = 10_000) -> DataFrame:
    """The keys that have over a `parts`-th of all rows, by their counts: fewer than `parts`, so they may be broadcast."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return F.broadcast(counted.where(F.col(count) > max(total / parts, 1000)))


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], count: str = "times") -> DataFrame:
    """rows joined to counted, one row a key with the number of its rows.

    Heavy keys are joined by broadcast where their rows lie; the others, none of which has many, by a shuffle. Both sides
    are read twice, so they should be stashed.
    """
    hot = heavy(counted, count)
    return rows.join(hot, on).union(rows.join(hot.select(*on), on, "left_anti").join(counted.join(hot.select(*on), on, "left_anti"), on))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        first = total = 0
        for i, n in enumerate(sizes):
            if i > first and total + n > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(n)
        yield batch.slice(first)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def n_words(text: Column) -> Column:
    """Number of words of a text, JVM-side; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def release() -> None:
    """Give memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function after which its worker, which Spark keeps for later stages, gives memory back to the system."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow() of a released() function, in batches of BATCH_MOST bytes where the session has Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES).rstrip("b") == str(BATCH_DEFAULT):
        conf.set(BATCH_BYTES, str(BATCH_MOST))
    return df.mapInArrow(released(run), schema)
