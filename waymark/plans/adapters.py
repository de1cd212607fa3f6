"""The tables of a data folder as the relations that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records for the registered queries: id, kind, value, anchor_ord, severity, confidence, status.
ANCHORS = [
    (1, "path", "src1", 0, "high", 0.9, "active"),
    (2, "path", "src0/en", 0, "medium", 0.8, "active"),
    (3, "pattern", "licensed under", 0, "low", 0.7, "active"),
    (4, "pattern", 'token = "[0-9a-f]{8}', 0, "critical", 0.95, "active"),
    (5, "pattern", "fr/[0-9]*7[.]txt", 0, "medium", 0.6, "challenged"),
    (5, "path", "src9/fr/", 1, "medium", 0.6, "challenged"),
    (6, "path", "nowhere/", 0, "high", 0.5, "active"),
    (6, "path", "src2/de", 1, "high", 0.5, "active"),
    (7, "path", "gone/", 0, "low", 0.4, "active"),
    (7, "pattern", "zzzqqq", 1, "low", 0.4, "active"),
    (8, "pattern", "qqqzzz", 0, "unknown", 0.5, "active"),
    (9, "path", "src3/", 0, "medium", 0.5, "orphaned"),
    (10, "command", "idiot|moron", 0, "high", 0.8, "active"),
    (11, "symbol", "Foo.bar", 0, "low", 0.5, "active"),
    (12, "path", "src", 0, "low", 0.1, "active"),
    (13, "command", "clown|the ", 0, "low", 0.3, "active"),
    (14, "path", "src4/", 0, "high", 0.9, "archived"),
]
#: Violation patterns by record id.
RULES = [(1, "stupid|loser"), (2, "worthless"), (5, "le[ ]la"), (12, "scum")]

ANCHOR_SCHEMA = "id long, kind string, value string, anchor_ord int, severity string, confidence double, status string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchors(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ANCHORS, ANCHOR_SCHEMA)
    return rows.withColumn("source", F.concat(F.lit("records/"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".md")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), path.alias("path"), F.col("text").alias("content"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # Whole seconds as SQL's cast of epoch() gives them: the nearest, of two equally near the even one.
    t = F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long")
    return e.select("event_id", F.col("user_id").alias("repo"), F.get_json_object("props", "$.k").alias("target"), F.col("event_type").alias("record_id"), (F.col("event_type") == "error").alias("violated"), "ts", t.alias("t"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_returnflag").alias("value"), "l_shipdate", "l_orderkey", "l_linenumber")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sha"), F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int")), "yyyy-MM-dd").alias("date"), F.element_at(F.split("text", "\n"), 1).alias("subject"))


def values(rows: list[tuple]) -> str:
    """Rows as SQL values; decimals as doubles."""
    one = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)
    return "values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
