"""WARC captures: reading records, and resolving not-modified revisits.

A server that answers 304 sends no body. Such a revisit is resolved by an as-of join: to the latest earlier full response
of the same canonical URL. If the validators that both name agree, the revisit takes over that response's body and its
headers, renewed by the headers that a 304 may change. Responses and revisits of a URL meet in time slices, and what was
last before a slice comes from one row a slice, so a URL with very many captures is not one task.
"""

from __future__ import annotations

import datetime
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may renew in a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name no page.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
#: Seconds of a time slice.
SLICE = 86_400

RECORD = "record_id string, kind string, url string, ts long, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """A URL without scheme, user, leading www. or m., default port, fragment, tracking parameters and final slash, the
    host in lower case. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^(?:www|m)\\.", ""), ":(?:80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    query = F.regexp_replace(F.regexp_extract(bare, "[?](.*)$", 1), f"(?<![^&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    query = F.regexp_replace(query, "&$", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a plain or gzipped file in pieces, gzip member by member; what follows a broken place is left out."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at, member = 0, None
    while at < len(data):
        member = member or zlib.decompressobj(31)
        try:
            piece = member.decompress(member.unconsumed_tail or data[at : at + step], step)
        except zlib.error:
            return
        if not member.unconsumed_tail:
            at += step
        if member.eof:
            at, member = min(at, len(data)) - len(member.unused_data), None
        if piece:
            yield piece


def _head(block: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    pairs = (line.split(":", 1) for line in rest if ":" in line)
    return first, {k.strip().lower(): v.strip() for k, v in pairs}


def blocks(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every whole record; what is no record is skipped up to the next that begins a line."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while not held.lstrip(b"\r\n"):
            if not more():
                return
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        version, named = _head(bytes(held[:cut]))
        size = named.get("content-length", "")
        if not version.startswith("WARC/") or not size.isdigit():
            while (at := held.find(b"\nWARC/")) < 0:
                if not more():
                    return
            del held[: at + 1]
            continue
        end = cut + 4 + int(size)
        while len(held) < end:
            if not more():
                return
        yield named, bytes(held[cut + 4 : end])
        del held[:end]


def _captures(data: bytes) -> Iterator[tuple]:
    for named, block in blocks(inflated(data)):
        top, _, body = block.partition(b"\r\n\r\n")
        status, headers = _head(top)
        code, kind = re.match(r"HTTP/\S+ (\d{3})", status), named.get("warc-type")
        if kind in ("response", "revisit") and code:
            try:
                when = datetime.datetime.fromisoformat(named.get("warc-date", "").replace("Z", "+00:00"))
            except ValueError:
                continue
            when = when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)
            yield named.get("warc-record-id"), kind, named.get("warc-target-uri"), int(when.timestamp()), int(code[1]), headers, body


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files, plain or gzipped: RECORD columns, header names in lower case.

    ts is the WARC date in seconds. Other record types and records without an HTTP status or a date are passed over; a file
    that breaks off, compressed or not, gives the whole records before the break. A task holds one file as it is stored, at
    most 2 GB as Spark reads it, and one record of its contents. A folder without files is an error of Spark's.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "kind", "url", "ts", "status", "headers", "body"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for data in b.column("content").to_pylist():
                found = ((*r[:5], list(r[5].items()), r[6]) for r in _captures(data))
                while rows := list(itertools.islice(found, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.mapInArrow(run, RECORD)


def last_before(events: DataFrame, width: int = SLICE) -> DataFrame:
    """events(key, ts, ord, full, mark) -> also before: the mark of the latest full event that is earlier.

    Earlier is by (ts, ord): ord tells apart what has one ts. Events with a null key have none before them.
    """
    sliced = events.withColumn("slice", F.floor(F.col("ts") / width))
    order = F.struct("ts", "ord")
    lasts = sliced.where("full").groupBy("key", "slice").agg(F.max_by("mark", order).alias("last"))
    carried = lasts.select(F.col("key").alias("k"), "slice", "last")
    # A slice's carry is the last of the latest earlier slice with a full response: one row a key and slice.
    slices = sliced.select("key", "slice").distinct().join(carried.withColumnRenamed("slice", "s"), (F.col("key") == F.col("k")) & (F.col("slice") == F.col("s")), "left")
    by_key = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(F.col("key").alias("k"), F.col("slice").alias("s"), F.last("last", ignorenulls=True).over(by_key).alias("carry"))
    inner = Window.partitionBy("key", "slice").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.last(F.when(F.col("full"), F.col("mark")), ignorenulls=True).over(inner))
    joined = near.join(carry, (near.key == carry.k) & (near.slice == carry.s), "left")
    return joined.withColumn("before", F.when(F.col("key").isNotNull(), F.coalesce("near", "carry"))).drop("slice", "near", "carry", "k", "s")


def resolve(records: DataFrame, width: int = SLICE) -> DataFrame:
    """Every revisit of records (RECORD columns, body optional) with what it resolves to:
    (record_id, url, ts, outcome, refers_to, headers).

    outcome: 'resolved'; 'mismatch' if etag or last-modified, where both name it, differ (a weak etag equals its strong
    form); 'unvalidated' if they share no validator; 'missing' without an earlier full response (status 200, kind
    response). Only a resolved revisit has refers_to and merged headers. Among responses of one ts the greater record_id
    is later, and a response of a revisit's own ts is not earlier unless its record_id is smaller. Repeated rows resolve
    alike. Null urls are missing; null headers name nothing.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    events = records.where(full | (F.col("kind") == "revisit")).select(
        canonical(F.col("url")).alias("key"), "url", "ts", F.col("record_id").alias("ord"), F.coalesce(full, F.lit(False)).alias("full"), "headers", F.struct("record_id", "headers").alias("mark")
    )
    met = last_before(events, width).where("not full")
    new, old = F.col("headers"), F.col("before.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    pairs = [(tag(new), tag(old)), (new["last-modified"], old["last-modified"])]
    differ = F.lit(False)
    shared = F.lit(False)
    for a, b in pairs:
        differ = differ | F.coalesce(a != b, F.lit(False))
        shared = shared | (a.isNotNull() & b.isNotNull())
    outcome = F.when(F.col("before").isNull(), "missing").when(differ, "mismatch").when(~shared, "unvalidated").otherwise("resolved")
    renewed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(renewed), k), F.lit(False)))
    merged = F.map_concat(kept, renewed)
    return met.withColumn("outcome", outcome).select(
        F.col("ord").alias("record_id"), "url", "ts", "outcome",
        F.when(F.col("outcome") == "resolved", F.col("before.record_id")).alias("refers_to"),
        F.when(F.col("outcome") == "resolved", merged).alias("headers"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the bodies of the responses they refer to."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), "body")
    return resolved.join(bodies, "refers_to")


#: Of the crawl that captures() makes: seconds between pages, and at most so many pages until a page is asked for again.
STEP, LAG = 1800, 997


def captures(pages: DataFrame) -> DataFrame:
    """The pages table as a crawl: a page every half hour, in order of page_id, and second requests in between.

    A page is asked for again up to three weeks after it was fetched, every seventh page a quarter of an hour before. The request
    carries the validators of its own page, every eleventh none, and the answer has new dates. So a revisit resolves to the
    latest capture of its canonical URL until then, unless that had other contents, there is none yet, or nothing validates it.
    """
    etag, ident = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.col("page_id").cast("long")
    fetched = ident * STEP
    asked = F.when(F.pmod(ident, F.lit(7)) == 3, fetched - 900).otherwise(fetched + 900 + STEP * F.pmod(ident * 7919, F.lit(LAG)))
    first = pages.select(
        F.format_string("a%019d", "page_id").alias("record_id"), F.lit("response").alias("kind"), "url", fetched.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), fetched.cast("string"), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")).alias("headers"),
    )
    plain = F.create_map(F.lit("date"), asked.cast("string"), F.lit("content-length"), F.lit("0"))
    again = pages.select(
        F.format_string("b%019d", "page_id").alias("record_id"), F.lit("revisit").alias("kind"), "url", asked.alias("ts"), F.lit(304).alias("status"),
        F.when(F.pmod(ident, F.lit(11)) == 5, plain).otherwise(F.map_concat(plain, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag)))).alias("headers"),
    )
    return first.union(again)
