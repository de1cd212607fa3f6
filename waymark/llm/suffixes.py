"""Suffix-array dedup: removes bytes covered by a long string that starts anywhere else as well.

Sorting every suffix of a corpus moves hundreds of bytes for every byte, so suffixes are thinned without losing any
repeat. In each window of LENGTH bytes the anchor is the GRAM-byte string with the least hash; equal windows have equal
anchors at equal places, and an anchor owns a stretch of windows. One pass lists anchors with hashes of their string and
of their stretch; stretches that a task meets again are removed there and listed once. Anchors whose string is met once are
done, as nothing there repeats. Stretches met twice as a whole are done, as every window of theirs repeats. What is left are
the edges of repeats. Their suffixes are range-partitioned by their leading bytes, with splitters that Spark samples, and
sorted in each bucket by multikey quicksort: by tokens of eight bytes in byte order, three ways around a pivot, so that what
stays together through all tokens of LENGTH bytes is equal byte by byte. A string's suffixes share their leading bytes, so
ranges end between strings; a bucket arrives in sorted batches, and the open string at a batch's end is carried over and
compared with the next batch. Strings with more than HOT different stretches would make one task hold them all: their windows
are counted by hash with partial sums instead, which is as exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, join_counted, slices, stash

#: TOKEN divides LENGTH.
LENGTH, GRAM, TOKEN = 400, 128, 8
#: Different stretches of one string above which its windows are counted by hash.
HOT = 1000
#: Bytes worked on at once; a longer document is cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes of stretches sorted at once, in whole strings.
BUCKET = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_TABLES: dict[str, np.ndarray] = {}


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every string of `width` bytes."""
    if len(_TABLES.get("up", ())) <= len(data):
        n = max(len(data) + 1, PIECE + LENGTH * 2)
        _TABLES["up"], _TABLES["down"] = _powers(BASE, n), _powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _TABLES["up"][: len(data)], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _TABLES["down"][: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, key) of the stretches of windows in data; a window lies inside one of the (start, end) bounds.

    first and last are window starts that share the anchor position; key is the hash of the anchor's string.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    h = rolling(data, GRAM)
    place = np.uint64(0xFFFFFF)
    v = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    w = LENGTH - GRAM + 1
    rows = np.full(-(-len(v) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[: len(v)] = v
    rows = rows.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    least = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & place).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    for s, e in bounds:
        if e - s >= LENGTH:
            inside[s] += 1
            inside[e - LENGTH + 1] -= 1
    least[np.cumsum(inside[:n]) == 0] = -1
    edges = np.flatnonzero(np.diff(least, prepend=-2, append=-2))
    first, last = edges[:-1], edges[1:] - 1
    real = least[first] >= 0
    first, last = first[real], last[real]
    a = least[first]
    return first, last, a, h[a].view(np.int64)


def _packed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of about PIECE bytes, and for each piece in one: row, offset in the row, start and end in the buffer."""
    parts, at, held = [], 0, []
    for row, text in enumerate(texts):
        for offset in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            piece = text[offset : offset + PIECE + LENGTH - 1]
            if parts and at + len(piece) > PIECE + LENGTH:
                yield np.frombuffer(b"".join(parts), np.uint8), held
                parts, at, held = [], 0, []
            held.append((row, offset, at, at + len(piece)))
            parts.append(piece)
            at += len(piece)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), held


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each buffer, each kind once; twice says that it was met again. What else is of that kind is removed:
    rows without key, neighbours joined."""
    for b in slices(batches, "text", 4_000_000):
        for data, held in _packed(as_bytes(b.column("text"))):
            first, last, a, key = anchors(data, [(s, e) for _, _, s, e in held])
            if not len(first):
                continue
            starts = np.array([s for _, _, s, _ in held])
            piece = np.searchsorted(starts, first, side="right") - 1
            raw = data.tobytes()
            seg = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist())]), "<i8").reshape(-1, 2)
            order = np.argsort(seg[:, 0], kind="stable")
            kinds = np.column_stack((key, seg))[order]
            new = np.ones(len(order), bool)
            new[1:] = (kinds[1:] != kinds[:-1]).any(axis=1)
            one, times = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
            other = np.ones(len(first), bool)
            other[one] = False
            # Other occurrences of a kind: one row for neighbours whose windows follow one another.
            o = np.flatnonzero(other)
            new = np.ones(len(o), bool)
            new[1:] = (first[o[1:]] != last[o[:-1]] + 1) | (piece[o[1:]] != piece[o[:-1]])
            begin, end = o[new], o[np.append(new[1:], True)[: len(o)]]
            place = np.concatenate((one, begin))
            until = np.concatenate((last[one], last[end]))
            row = np.array([r for r, _, _, _ in held])[piece[place]]
            shift = np.array([f - s for _, f, s, _ in held])[piece[place]]
            known = pa.array(np.arange(len(place)) >= len(one))
            keyed = lambda x: pa.array(np.ascontiguousarray(x[place]), mask=np.arange(len(place)) >= len(one))  # noqa: B023, E731
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("did").take(take), b.column("th").take(take), pa.array(first[place] + shift), pa.array((until - first[place] + 1).astype(np.int32)), pa.array((a - first)[place].astype(np.int32)),
                 keyed(key), keyed(seg[:, 0]), keyed(seg[:, 1]), pa.array(np.append(times > 1, np.zeros(len(begin), bool))), known],
                ["did", "th", "first", "n", "o", "key", "s1", "s2", "twice", "known"],
            )


STRETCH = "did long, th long, first long, n int, o int, key long, s1 long, s2 long, twice boolean, known boolean"


def byte_tokens(data: np.ndarray) -> np.ndarray:
    """The TOKEN bytes from every place on as one number, so that numbers go in the order of bytes."""
    n = len(data) - TOKEN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(TOKEN):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def multikey_sort(tokens: np.ndarray, starts: np.ndarray, classes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at `starts` within their classes, by `depth` tokens each; all parts at a time.

    A part is cut three ways around the median of its first, middle and last token: smaller and greater ones go on with the
    same token, equal ones with the next. Parts of one are sorted, as are equal ones after the last token. Returns the order,
    and a mark for every place whose suffix equals that of the place before in all tokens and in class.
    """
    order = np.argsort(classes, kind="stable")
    same = np.zeros(len(order), bool)
    slots, part = np.arange(len(order)), np.cumsum(np.diff(classes[order], prepend=classes[order[:1]]) != 0) if len(order) else np.zeros(0, np.int64)
    level = np.zeros(part[-1] + 1 if len(part) else 0, np.int64)
    while len(slots):
        sizes = np.bincount(part, minlength=len(level))
        ends = np.cumsum(sizes)
        alive = (sizes > 1) & (level < depth)
        equal = (sizes > 1) & (level >= depth)
        if equal.any():
            inner = equal[part]
            inner[(ends - sizes)[equal]] = False
            same[slots[inner]] = True
        keep = alive[part]
        slots, renamed = slots[keep], np.cumsum(alive) - 1
        part, level = renamed[part[keep]], level[alive]
        if not len(slots):
            break
        sizes = sizes[alive]
        firsts = np.cumsum(sizes) - sizes
        token = tokens[starts[order[slots]] + level[part] * TOKEN]
        a, b, c = token[firsts], token[firsts + sizes // 2], token[firsts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = 3 * part + (token >= pivot) + (token > pivot)
        turn = np.argsort(side, kind="stable")
        order[slots] = order[slots[turn]]
        side = side[turn]
        new = np.diff(side, prepend=-1) != 0
        level = level[side[new] // 3] + (side[new] % 3 == 1)
        part = np.cumsum(new) - 1
    return order, same


def repeats(rows: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """For rows (string, n, o, bytes of a stretch) the runs (first, last) of windows that another row has too."""
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    sizes, n = np.array([len(r[3]) for r in rows]), np.array([r[1] for r in rows])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = base[owner] + j
    _, string = np.unique([r[0] for r in rows], return_inverse=True)
    away = np.array([r[2] for r in rows])[owner] - j
    order, same = multikey_sort(byte_tokens(data), starts, string[owner] * (2 * LENGTH) + away, LENGTH // TOKEN)
    hit = np.zeros(len(starts), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    edges = np.diff(hit.astype(np.int8), prepend=0, append=0)
    turn = np.zeros(len(hit) + 1, bool)
    turn[np.cumsum(n)[:-1]] = True
    begins = np.flatnonzero((edges[:-1] == 1) | (turn[:-1] & hit))
    ends = np.flatnonzero((edges[1:] == -1) | (turn[1:] & hit))
    for s, e in zip(begins.tolist(), ends.tolist()):
        out[owner[s]].append((int(j[s]), int(j[e])))
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by string -> (did, th, lo, hi) removed spans; whole strings are compared, a few at a time."""

    def work(rows: list[dict]) -> pa.RecordBatch:
        found = repeats([(r["key"], r["n"], r["o"], r["bytes"]) for r in rows]) if rows else []
        out = [(r["did"], r["th"], r["first"] + s, r["first"] + e + LENGTH) for r, runs in zip(rows, found) for s, e in runs]
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["did", "th", "lo", "hi"])

    held: list[dict] = []
    size = 0
    for b in batches:
        for r in b.to_pylist():
            if size > BUCKET and held[-1]["key"] != r["key"]:
                yield work(held)
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"])
    yield work(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(r["bytes"][j : j + LENGTH]) for j in range(r["n"])]), "<i8").reshape(-1, 2)
            k = r["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["did"]] * k, pa.int64()), pa.array([r["th"]] * k, pa.int64()), pa.array(r["first"] + np.arange(k)), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], ["did", "th", "lo", "w1", "w2"]
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 4_000_000):
        rows = []
        for text, spans in zip(as_bytes(b.column("text")), b.column("spans").to_pylist()):
            kept, at, removed, runs = [], 0, 0, 0
            end = -1
            for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                if s[0] > end:
                    runs += 1
                    kept.append(text[at : s[0]])
                    removed += s[1] - s[0]
                elif s[1] > end:
                    removed += s[1] - end
                end = max(end, s[1])
                at = end
            kept.append(text[at:])
            rows.append((len(text), removed, runs, b"".join(kept)))
        n, gone, runs, kept = zip(*rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def spans(docs: DataFrame) -> DataFrame:
    """(did, th, lo, hi): bytes [lo, hi) of the document keyed did and th are covered by a repeated string."""
    found = stash(docs.mapInArrow(_stretches, STRETCH))
    listed, times = found.where("not known").drop("known"), F.when(F.col("twice"), 2).otherwise(1)
    met = listed.groupBy("key").agg(F.sum(times).alias("met"), F.min("s1").alias("a1"), F.max("s1").alias("b1"), F.min("s2").alias("a2"), F.max("s2").alias("b2"))
    strings = stash(met.where("met > 1").select("key", "met", ((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).alias("alike")))
    many = stash(join_counted(listed, strings, ["key"], "met"))
    discard(strings)
    mixed = many.where("not alike")
    kinds = stash(mixed.groupBy("key", "s1", "s2").agg(F.sum(times).alias("times"), F.min(F.struct("did", "th", "first", "n", "o")).alias("one")))
    again = stash(kinds.where("times > 1").select("key", "s1", "s2", "times"))
    removed = [join_counted(mixed, again, ["key", "s1", "s2"]), many.where("alike"), found.where("known")]
    whole = reduce(DataFrame.union, [x.select("did", "th", "first", "n") for x in removed])
    whole = whole.select("did", "th", F.col("first").alias("lo"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("hi"))
    counts = stash(kinds.groupBy("key").agg(F.count("*").alias("kinds")))
    wanted = join_counted(kinds, counts, ["key"], "kinds").select("key", "kinds", "one.*")
    of_doc = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("key", "kinds", "first", "n", "o")).alias("w"))
    text = F.col("text").cast("binary")
    cut = docs.join(of_doc, ["did", "th"]).select("did", "th", text.alias("text"), F.explode("w").alias("w")).select("did", "th", "w.*", F.expr(f"substring(text, cast(w.first + 1 as int), w.n + {LENGTH - 1})").alias("bytes"))
    cut = stash(cut.dropDuplicates(["did", "th", "key", "first", "n"]))
    discard(counts)
    ranged = cut.where(F.col("kinds") <= HOT).withColumn("lead", F.expr("substring(bytes, o + 1, 16)")).repartitionByRange("lead", "key").sortWithinPartitions("lead", "key")
    edges = ranged.select("did", "th", "key", "first", "n", "o", "bytes").mapInArrow(_edges, "did long, th long, lo long, hi long")
    windows = cut.where(F.col("kinds") > HOT).mapInArrow(_windows, "did long, th long, lo long, w1 long, w2 long")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    hot = windows.join(again, ["w1", "w2"]).select("did", "th", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return whole.union(edges).union(hot)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text).

    Every byte covered by a LENGTH-byte string that starts at two places of the corpus goes, judged on the input. Null
    texts are empty; rows with equal id and text are copies of one another like any others; matches never cross rows.
    Extra columns are ignored; an empty table gives no rows. Ids that are no integers go by their 64-bit hash, and with it
    that of the text.
    """
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    of = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.coalesce(of, F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"))
    removed = spans(keyed.select("did", "th", "text")).groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return keyed.join(removed, ["did", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
