"""Runs of words that repeat with a period, and texts without the repetitions.

Matches at every lag are counted at once: an exact FFT autocorrelation for a document's frequent words, differences of
positions for its rare ones. A run of period q and length L holds L - q matches in a row at lag q, so a lag with fewer
matches than the shortest run needs has none; the other lags are probed on a grid that no long enough island misses, and
only those that a probe hits are scanned for islands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_bytes, slices

#: Shortest run in words; it is also at least twice its period.
LEAST = 12
#: Differences, or probes, that are held at a time.
HELD = 4_000_000


def flat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def needed(lag: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Matches in a row at a lag that make a run."""
    return np.maximum(least - lag, lag)


def lag_counts(ids: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Matches of every lag up to half of its document, at the place of the document's word of that number.

    ids: the words of all documents, one after another; base and size: where each word's document begins, and its size.
    """
    counts = np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, base))
    key, doc = ids[order], base[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    times = np.diff(np.append(new, len(ids)))
    n = size[order][new]
    # A word costs half its square of differences, or a transform of twice the document's length.
    heavy = times.astype(float) ** 2 > 4 * n * np.log2(n + 2)
    at: dict[int, list[int]] = {}
    for g in np.flatnonzero(heavy).tolist():
        at.setdefault(int(doc[new[g]]), []).append(g)
    for start, groups in at.items():
        m = int(n[groups[0]])
        wide = 1 << (2 * m - 1).bit_length()
        power = np.zeros(wide // 2 + 1)
        for g in groups:
            there = np.zeros(wide, np.float64)
            there[order[new[g] : new[g] + times[g]] - start] = 1
            f = np.fft.rfft(there)
            power += f.real**2 + f.imag**2
        counts[start : start + m] += np.rint(np.fft.irfft(power, wide)[:m]).astype(np.int64)
    # The others: each occurrence with the next of its word, then with the one after, until no word has so many.
    first = flat_ranges(new[~heavy], times[~heavy])
    left = np.repeat(times[~heavy], times[~heavy]) - (first - np.repeat(new[~heavy], times[~heavy])) - 1
    step, held, pending = 0, 0, []
    while True:
        step += 1
        on = left >= step
        first, left = first[on], left[on]
        if not len(first):
            break
        a = order[first]
        lag = order[first + step] - a
        near = 2 * lag <= size[a]
        pending.append((base[a] + lag)[near])
        # Later occurrences of a word only lie farther away.
        first, left = first[near], left[near]
        held += len(pending[-1])
        if held > HELD:
            counts += np.bincount(np.concatenate(pending), minlength=len(ids))
            held, pending = 0, []
    if pending:
        counts += np.bincount(np.concatenate(pending), minlength=len(ids))
    return counts


def probed(ids: np.ndarray, base: np.ndarray, size: np.ndarray, lag: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which of the lags, each of a document at base with size words, may hold a long enough island: every island of m
    matches covers a multiple of m, and from there half of m to one side."""
    need = needed(lag, least)
    points = -(-(size - lag) // need)
    found = np.zeros(len(lag), bool)
    begin = 0
    total = np.cumsum(points)
    while begin < len(lag):
        end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HELD, "right")), begin + 1)
        which = np.repeat(np.arange(begin, end), points[begin:end])
        step, q, low = need[which], lag[which], base[which]
        at = flat_ranges(np.zeros(end - begin, np.int64), points[begin:end]) * step
        same = lambda at, which, q, low: (at >= 0) & (at < size[which] - q) & (ids[low + np.clip(at, 0, size[which] - q - 1)] == ids[low + np.clip(at, 0, size[which] - q - 1) + q])
        hit = same(at, which, q, low)
        at, which, step, q, low = at[hit], which[hit], step[hit], q[hit], low[hit]
        sides = np.zeros(len(at), bool)
        for side in (-1, 1):
            good = np.ones(len(at), bool)
            for part in (1, 2, 4, 8):
                good[good] = same((at + side * ((step - 1) // 2 // part))[good], which[good], q[good], low[good])
            sides |= good
        found[which[sides]] = True
        begin = end
    return found


def islands(words: np.ndarray, lag: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of matches of every stretch of at least `need` matches in a row at a lag."""
    same = np.empty(len(words) - lag + 2, bool)
    same[0] = same[-1] = False
    np.equal(words[lag:], words[:-lag], out=same[1:-1])
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= need
    return starts[long], (ends - starts)[long]


def find(docs: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start, then period. docs: numbers that stand for words."""
    sizes = np.array([len(d) for d in docs], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not sizes.sum():
        return out
    ids = np.concatenate(docs)
    firsts = np.cumsum(sizes) - sizes
    base, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
    counts = lag_counts(ids, base, size)
    lags = np.arange(len(ids)) - base
    may = np.flatnonzero((lags > 0) & (size >= np.maximum(2 * lags, least)) & (counts >= needed(lags, least)))
    may = may[probed(ids, base[may], size[may], lags[may], least)]
    owners = np.repeat(np.arange(len(docs)), sizes)[may]
    for d, place in zip(owners.tolist(), may.tolist()):
        q = int(lags[place])
        need = max(least - q, q)
        if counts[place] < need:  # all but a few of its matches belong to runs of shorter periods
            continue
        low, n = int(firsts[d]), int(sizes[d])
        known = {(s, length) for s, length, p in out[d] if q % p == 0}
        for s, matches in zip(*(x.tolist() for x in islands(ids[low : low + n], q, need))):
            length = matches + q
            if (s, length) in known:
                continue
            out[d].append((s, length, q))
            # At every multiple of q up to its length the run is one island again, of its own extent.
            times = np.arange(2 * q, min(length, n // 2 + 1), q)
            counts[low + times] -= length - times
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are in no run after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): every row of docs(doc_id, text) with the runs of its words, by start, then period, and its
    text without the words that a run repeats, joined by single spaces.

    A run is a stretch of words with smallest period q, of at least `least` words and twice its period, that goes on to
    neither side. A null or blank text has no runs and collapses to an empty one; repeated rows stay, ties of length or
    start are all listed, extra columns are ignored, and no document meets another, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            words = [text.split() for text in as_bytes(b.column("text"))]  # bytes split at the six blanks
            codes = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            ends = np.cumsum([len(ws) for ws in words])
            found = find(np.split(codes, ends[:-1]), least)
            texts = [b" ".join([w for w, k in zip(ws, kept(len(ws), r).tolist()) if k] if r else ws) for ws, r in zip(words, found)]
            flat = [x for r in found for x in r]
            each = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in found]))), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which every tenth document, by crc32 of its id, repeats a stretch of its words to the end.

    Let h be that checksum and g = h div 10: of n words those from g mod n on become the first 1 + (n - g mod n) div
    (3 + g mod 8) of them, over and over. Rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    start = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - start) / (F.lit(3) + g % 8))).cast("int")
    part: Column = F.slice("w", start + 1, period)
    again = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - start) / period).cast("int"))), F.lit(1), n - start)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), start), again), " ")
    return marked.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), text).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of runs(); the run is the longest,
    of those the first, of those the one with the smallest period, and null where there is none."""
    found = runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return each.select(
        "doc_id", "n_runs", (-F.col("b.back")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.less")).alias("period"),
        F.floor(1000 * F.col("b.length") / -F.col("b.less")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
