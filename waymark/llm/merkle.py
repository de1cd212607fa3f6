"""A Merkle manifest of a table: a leaf for every row, a tree for every source, and a tree over the sources.

Blocks of FAN ** LEVELS neighbouring nodes of a tree are reduced in tasks, again and again while more than TOP nodes are
left; the driver builds the small rest and broadcasts it. Executors take from it the path above each block, finish every
row's proof and fold the row's leaf up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hinted, stash

FAN = 16
#: Levels that one pass over blocks reduces, so 4 096 nodes a block, and nodes that the driver gets at most.
LEVELS, TOP = 3, 16_384
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A run of neighbouring nodes and the place in it of the node whose path this is; from below to above.
Path = list[tuple[int, list[bytes]]]


def digest(parts: list[bytes]) -> bytes:
    """sha256 of digests as hex text, one after another, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes, and each of `levels` levels above them."""
    tiers = [nodes]
    for _ in range(levels):
        tiers.append([digest(tiers[-1][i : i + FAN]) for i in range(0, len(tiers[-1]), FAN)])
    return tiers


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climb(tiers: list[list[bytes]], i: int) -> Path:
    """The runs from node i to below the last tier."""
    out = []
    for tier in tiers[:-1]:
        out.append((i % FAN, tier[i - i % FAN : i - i % FAN + FAN]))
        i //= FAN
    return out


def siblings(path: Path) -> bytes:
    return b"".join(x for i, run in path for j, x in enumerate(run) if j != i)


def fold(node: bytes, path: Path) -> bytes:
    for i, run in path:
        node = digest([*run[:i], node, *run[i + 1 :]])
    return node


def packed(path: Path) -> bytes:
    return b"".join(bytes([len(run), i]) + bytes.fromhex(b"".join(run).decode()) for i, run in path)


def unpacked(data: bytes) -> Path:
    out, at = [], 0
    while at < len(data):
        n, i = data[at], data[at + 1]
        out.append((i, [data[at + 2 + 32 * k : at + 34 + 32 * k].hex().encode() for k in range(n)]))
        at += 2 + 32 * n
    return out


class Top:
    """The upper part of all trees, from the nodes of each tree that are left, in order, and the tree over their roots."""

    def __init__(self, trees: dict[str, list[bytes]]):
        self.tiers = {key: reduced(nodes, height(len(nodes))) for key, nodes in trees.items()}
        self.order = {key: i for i, key in enumerate(sorted(trees, key=str.encode))}
        self.roots = reduced([self.subroot(key) for key in self.order], height(len(trees)))

    def subroot(self, key: str) -> bytes:
        return self.tiers[key][-1][0]

    @property
    def root(self) -> bytes:
        return self.roots[-1][0]

    def path(self, key: str, pos: int) -> Path:
        return climb(self.tiers[key], pos) + climb(self.roots, self.order[key])


def field(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row, or of the row with another text, as 32 bytes."""
    changed = F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)) if text is not None else None
    return F.unhex(F.sha2(F.concat(*[changed if f == "text" and changed is not None else field(f) for f in FIELDS]).cast("binary"), 256))


def positions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with pos, from 0 in `order` among those of a key, and n, their number.

    Spark sorts by ranges of key and order, so a large key is many partitions. Only the first row of each key in each
    partition, and how many there are, goes back to the rows: at most as many rows as partitions and keys together.
    """
    sorted_rows = stash(rows.orderBy(key, *order).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    spans = sorted_rows.groupBy("_part", key).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stash(spans.select("_part", key, "_first", before.alias("_before"), F.sum("_n").over(of).alias("n")))
    return sorted_rows.join(hinted(spans, 100_000), ["_part", key]).withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def blocks(nodes: DataFrame, levels: int, above: DataFrame | None = None) -> DataFrame:
    """nodes(key, pos, n, digest, ...) dealt out by blocks and in order; above(key, pos, path, subroot, root) gives each block
    a first row with what lies above it."""
    by = F.floor(F.col("pos") / FAN**levels).cast("long")
    rows = nodes.withColumn("block", by)
    if above is not None:
        rows = rows.unionByName(above.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block, which may go on in the next batch."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["key"], row["block"]) != (held[0]["key"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def written(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def levels_of(n: int, levels: int) -> int:
    """Levels that a block of a tree of n nodes is reduced by: all of them if it is the whole tree."""
    return height(n) if n <= FAN**levels else levels


def parents(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, pos, n, digest) of the node above each block."""
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in groups(batches):
            n = g[0]["n"]
            top = reduced([x["digest"].hex().encode() for x in g], levels_of(n, levels))[-1][0]
            yield g[0]["key"], g[0]["block"], -(-n // FAN**levels), bytes.fromhex(top.decode())

    slim = blocks(nodes.select("key", "pos", "n", "digest"), levels)
    return slim.mapInArrow(lambda batches: written(rows(batches), schema), "key string, pos long, n long, digest binary")


def above_of(group: list[dict], top: Top | None) -> tuple[list[dict], Path, bytes, bytes]:
    """A block's nodes, the path above it, and its tree's root and the root of all."""
    first = group[0]
    if top:
        return group, top.path(first["key"], first["block"]), top.subroot(first["key"]), top.root
    return group[1:], unpacked(first["path"]), first["subroot"].hex().encode(), first["root"].hex().encode()


def with_paths(nodes: DataFrame, levels: int, top: Top | None, above: DataFrame | None) -> DataFrame:
    """(key, pos, path, subroot, root) of nodes, from what lies above their blocks."""
    sent = nodes.sparkSession.sparkContext.broadcast(top)
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in groups(batches):
            own, path, subroot, root = above_of(g, sent.value)
            tiers = reduced([x["digest"].hex().encode() for x in own], levels_of(own[0]["n"], levels))
            for i, x in enumerate(own):
                yield x["key"], x["pos"], packed(climb(tiers, i) + path), bytes.fromhex(subroot.decode()), bytes.fromhex(root.decode())

    dealt = blocks(nodes.select("key", "pos", "n", "digest"), levels, above)
    return dealt.mapInArrow(lambda batches: written(rows(batches), schema), "key string, pos long, path binary, subroot binary, root binary")


def ascend(leaves: DataFrame, levels: int, top: int) -> tuple[Top | None, DataFrame | None]:
    """What lies above the blocks of leaves: for the driver's part a Top, else a table as with_paths() makes it.

    Blocks are reduced until at most `top` nodes are left in all trees. If there are more trees than that, their roots are
    the nodes of one more tree, which goes the same way.
    """
    rounds = [leaves]
    while True:
        rounds.append(stash(parents(rounds[-1], levels)))
        left, most = rounds[-1].agg(F.count("*"), F.max("n")).first()
        if left <= top or most == 1:
            break
    built, above = None, None
    if left <= top:
        trees: dict[str, list[bytes]] = {}
        for row in sorted(rounds[-1].collect(), key=lambda r: (r["key"], r["pos"])):
            trees.setdefault(row["key"], []).append(bytes(row["digest"]).hex().encode())
        built = Top(trees) if trees else None
    else:
        roots = stash(positions(rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("tree"), "digest"), "key", "tree"))
        further, higher = ascend(roots, levels, top)
        found = with_paths(roots, levels, further, higher).select("pos", "path", "root")
        above = stash(roots.join(found, "pos").select(F.col("tree").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))
    for nodes in rounds[-2:0:-1]:
        above, built = stash(with_paths(nodes, levels, built, above)), None
    for spent in rounds[1:]:
        discard(spent)
    return built, above


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified): every row of docs(doc_id, source, lang, n_chars, text) with
    its leaf, its source's root, the root of all, the sha256 of its siblings from below to above, and the root that comes
    out when its leaf goes up again: the leaf of its text as `changed` gives it now, if that is given and not null.

    Leaves of a source ascend by doc_id, null first; rows that tie in it ascend by digest, and equal rows, whose leaves are
    the same, may change places. Null fields, the source among them, are `-`; null sources are a tree of their own. An empty
    table has no rows and no root. doc_id may be of any type with an order. Extra columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    now = leaf(docs, changed) if changed is not None else F.lit(None).cast("binary")
    own = leaf(docs)
    each = docs.select("doc_id", key.alias("key"), own.alias("digest"), F.when(now != own, now).alias("now"))
    # The number of each row keeps equal rows apart, so that ranges can part them.
    first = stash(each.withColumn("_at", F.monotonically_increasing_id()))
    leaves = positions(first, "key", "doc_id", "digest", "_at").drop("_at")
    built, above = ascend(leaves, levels, top)
    sent = docs.sparkSession.sparkContext.broadcast(built)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in groups(batches):
            nodes, path, subroot, root = above_of(g, sent.value)
            subroot, root_text, upper = subroot.decode(), root.decode(), siblings(path)
            tiers = reduced([x["digest"].hex().encode() for x in nodes], levels_of(nodes[0]["n"], levels))
            shared: dict[int, bytes] = {}
            for i, x in enumerate(nodes):
                own = climb(tiers, i)
                if i // FAN not in shared:
                    shared = {i // FAN: siblings(own[1:]) + upper}
                proof = hashlib.sha256(siblings(own[:1]) + shared[i // FAN]).hexdigest()
                folded = fold((x["now"] or x["digest"]).hex().encode(), own + path)
                yield x["doc_id"], x["digest"].hex(), subroot, root_text, proof, folded.decode(), folded == root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        names = ["leaf", "subroot", "root", "proof", "folded_root"]
        schema = pa.schema([("doc_id", first.schema.field("doc_id").type), *[(n, pa.string()) for n in names], ("verified", pa.bool_())])
        yield from written(rows(chained(first, batches)), schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks(leaves, levels, above).mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")


def chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digests(docs: DataFrame) -> DataFrame:
    """manifest() of documents of which every fifth, by crc32 of its id, has the letters A-Z of its text in lower case when it
    is folded. Rows with a null id are not changed."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest(docs, F.when(fifth, lower).otherwise(F.col("text")))
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")
