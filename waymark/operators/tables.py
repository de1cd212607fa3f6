"""What operators do with whole tables: cutting lineage durably, and positions over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of Parquet and rows up to which Spark may broadcast what kept() gives.
SMALL, FEW = 256 * 1024, 20_000


def kept(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df written as Parquet into the folder that spark.checkpoint.dir names, which executors share, and read back: lineage ends
    there, and so do size estimates. A checkpoint hands these on, each join multiplies them, and a loop that joins a table
    to itself doubles their digits every round, until the driver has no memory left. Where the folder is unset a local one
    will do for a local master; on a cluster it is an error. spent: results of kept() that no later plan reads; they go.

    Compressed Parquet says little of how many rows it has, and Spark broadcasts by its size, through the driver; what is
    larger than SMALL, or more rows than FEW, is joined by sorting.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    store = lambda folder: folder.getFileSystem(sc._jsc.hadoopConfiguration())
    for old in spent:
        for name in old.inputFiles()[:1]:
            folder = sc._jvm.org.apache.hadoop.fs.Path(name).getParent()
            store(folder).delete(folder, True)
    back, folder = spark.read.schema(df.schema).parquet(path), sc._jvm.org.apache.hadoop.fs.Path(path)
    large = store(folder).getContentSummary(folder).getLength() > SMALL or back.count() > FEW
    return back.hint("merge") if large else back


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with pos, counted from 1 in `order` over the whole table; what ties in it gets its positions in any sequence.

    Spark sorts by ranges, rows are counted inside their partition, and each partition adds the rows of those before it:
    one row a partition is what is broadcast, and no task sees the whole table.
    """
    rows = kept(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_row") - F.shiftleft("_part", 33)
    return rows.join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + inside + 1).drop("_part", "_row", "_before")


def last_before(asked: DataFrame, facts: DataFrame, keys: list[str], at: str, value: str, width: int = 4096) -> DataFrame:
    """asked(keys, at, ...) with value: that of the fact of the same keys with the greatest `at` not after it; null if none.

    Keys are cut into slices of `width`, so a key with very many rows is many groups: inside a slice one window finds the
    last fact, and what is the first of its slice takes over from the slices before, of which only the last fact each is
    looked at. Of facts with equal keys and `at` any one counts. There may be as many slices as rows, so none are broadcast.
    """
    part = F.floor(F.col(at) / width).cast("long")
    left = asked.withColumn("_slice", part).withColumn("_row", F.struct(*asked.columns))
    right = facts.select(*keys, F.col(at), value).withColumn("_slice", part)
    both = left.select(*keys, "_slice", at, F.lit(1).alias("_kind"), "_row", F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(*keys, "_slice", at, F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_kind = 1")
    ends = right.groupBy(*keys, "_slice").agg(F.max_by(value, at).alias("_end"))
    wanted = left.select(*keys, "_slice").distinct().withColumn("_end", F.lit(None).cast(right.schema[value].dataType))
    before = Window.partitionBy(*keys).orderBy("_slice", F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_asked", F.lit(False)).unionByName(wanted.withColumn("_asked", F.lit(True))).withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).where("_asked").select(*keys, "_slice", "_carry")
    return near.join(carried.hint("merge"), [*keys, "_slice"], "left").select("_row.*", F.coalesce("_v", "_carry").alias(value))


def running_count(rows: DataFrame, keys: list[str], at: str, name: str, width: int = 4096) -> DataFrame:
    """rows(keys, at, ...) with how many rows of the same keys come before, in order of `at`. Counts of slices of `width` are
    added up, so no task sees all rows of a key."""
    cut = rows.withColumn("_slice", F.floor(F.col(at) / width).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(at)) - 1
    return cut.withColumn("_inside", inside).join(before, [*keys, "_slice"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_slice", "_inside", "_before")


def newest_of(rows: DataFrame, keys: list[str], at: str, most: int, parts: int = 64) -> DataFrame:
    """The `most` rows of each key with the greatest `at`: of each of so many parts of a key first, then of all."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(at).desc()))
    few = rows.withColumn("_part", F.pmod(F.xxhash64(at), F.lit(parts))).withColumn("_r", rank(*keys, "_part")).where(F.col("_r") <= most)
    return few.withColumn("_r", rank(*keys)).where(F.col("_r") <= most).drop("_r", "_part")
