"""SimHash fingerprints and their links, by pivot distance tables.

Fingerprints are computed once over whole texts and reduced to distinct values, so exact copies cost one row. A pair
within `radius` differing bits agrees on at least `BLOCKS - radius` of the blocks the 64 bits are cut into; every choice
of agreeing blocks is a hash key, which is how Spark brings possible pairs together without comparing all. Within a key
the pivot table decides: the Hamming distances of every fingerprint to many reference fingerprints are precomputed, a
pair whose largest coordinate difference exceeds the radius is discarded (triangle inequality), survivors are verified.
Keys with more than `SMALL` fingerprints are not compared pairwise: there each fingerprint names the reference
fingerprints at distance one or less, and all that name the same one are within two bits of each other; such a group has
at most 65 members. No pair is lost in either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_tasks, slices, stash
from .components import components

BLOCKS = 5
RADIUS = 2
#: Largest group compared by the pivot table; larger ones go by common reference fingerprints.
SMALL = 64
N_PIVOTS = 16


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of a Hadamard matrix, so that any two are 32 bits apart."""
    bits = np.arange(64, dtype=np.uint64)
    rows = [int(sum(1 << int(b) for b in bits[np.bitwise_count(bits & np.uint64(r)) % 2 == 1])) for r in range(1, n + 1)]
    return np.array(rows, np.uint64)


def block_masks() -> list[int]:
    """Masks of every choice of BLOCKS - RADIUS blocks, as signed longs."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(blocks, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64, seed 42, of every run of so many words; of the whole text if it has fewer; nothing without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    cuts = zip(starts, ends[words - 1 :]) if len(parts) >= words else [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in cuts], "<u8")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of one text: majority of the bits of its shingles' XXH64, seed 42; 0 without words."""
    return majority(shingles(text, words))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in as_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return in_tasks(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def pivot_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within radius: discarded by the pivot table first, then verified."""
    near = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    i, j = np.triu_indices(len(fps), 1)
    kept = np.abs(near[i] - near[j]).max(axis=1) <= radius
    i, j = i[kept], j[kept]
    close = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[close], j[close]


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out_a, out_b = [], []
        for members in b.column("members").to_pylist():
            fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
            for i, j in zip(*pivot_links(fps)):
                out_a.append(members[i]["rep"])
                out_b.append(members[j]["rep"])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def links(reps: DataFrame) -> DataFrame:
    """(fp, rep) distinct fingerprints -> (a, b): links among the reps, enough to join all that are within RADIUS."""
    keyed = reps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(block_masks())])).alias("k")).select("fp", "rep", "k.c", "k.bits")
    sizes = keyed.groupBy("c", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(keyed.join(sizes, ["c", "bits"]).select("fp", "rep", "c", "bits", "n"))
    small = shared.where(F.col("n") <= SMALL).groupBy("c", "bits").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).select("members").mapInArrow(_link_groups, "a long, b long")
    large = shared.where(F.col("n") > SMALL).select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)])
    named = large.select("rep", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("reference"))
    heads = named.groupBy("reference").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("reference", "a")
    by_reference = named.join(heads, "reference").where("a <> rep").select("a", F.col("rep").alias("b"))
    return small.union(by_reference).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Texts are lower-cased in A-Z only; fewer words than a shingle make one shingle; none give fingerprint zero, linked
    like any other. Repeated rows stay repeated. A null doc_id gets the component of its fingerprint's other documents,
    null if it has none, and links no others. Ids may be of any type with an order. Extra columns are ignored; an empty
    table gives no rows.
    """
    prints = stash(fingerprints(docs, words))
    reps = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    found = stash(components(links(reps.select("fp", F.col("fp").alias("rep")))))
    least = reps.join(found, reps.fp == found.node).groupBy("label").agg(F.min("rep").alias("least"))
    labels = reps.join(found.join(least, "label").select("node", "least"), reps.fp == F.col("node"), "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each group does: the one with the smallest doc_id.

    Rows with a null doc_id stay, as do all rows of the smallest doc_id if it repeats.
    """
    groups = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti")
