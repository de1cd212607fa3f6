"""Documents as token ids, packed into few sequences of a fixed size.

Only the histogram of lengths decides how: a linear program over configurations, the multisets of lengths that fit one
sequence, is solved by multiplicative weights. Lengths that are covered less become dearer, and a knapsack by dynamic
programming finds the configurations that are worth most at these prices. Its rounded solution is a short table, and each
piece finds its place there by its number among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import hinted, slices, stash

SIZE, END = 2048, 0
#: Rounds of prices in one solution of the program, solutions, and the step by which a round covers a length at most.
ROUNDS, SOLUTIONS, STEP = 40, 5, 0.1
#: How fast a price falls with what is covered, and the share of the best worth that a configuration needs.
ETA, NEAR = 0.3, 0.98
#: Fixed value: how a byte-level tokenizer parts a text before it merges.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin ones stand for themselves, the others
    follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as the tokenizers library gives them. A plain byte-level BPE vocabulary, whose merges rank as its ids do,
    goes through tiktoken, which gives the same ids in a quarter of the time; what it refuses goes through the library."""

    kept: dict[int, Encoder] = {}

    def __init__(self, data: str):
        self.library = Tokenizer.from_str(data)
        spec = json.loads(data)
        model, parts = spec["model"], spec.get("pre_tokenizer") or {}
        self.fast = None
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens") or []
        plain = model.get("type", "BPE") == "BPE" and not odd and not spec.get("normalizer") and not spec.get("truncation") and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
        if plain and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            byte, special = letters(), {t["content"]: t["id"] for t in added}
            merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
            if merged == sorted(merged):
                ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
                self.fast = tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
            except ValueError:  # its pattern gives up on very long runs of blanks
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    @classmethod
    def of(cls, data: str) -> Encoder:
        """One for each vocabulary and worker."""
        key = hash(data)
        if key not in cls.kept:
            cls.kept = {key: cls(data)}
        return cls.kept[key]


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32): the ids of every row of docs(doc_id, text) and the id `end`, cut into
    pieces of `size` where there are more; the first of those may be shorter.

    A null text is an empty one, whose only id is the last. Repeated rows are cut each for itself; extra columns are
    ignored. The vocabulary is read on the driver, is of fixed size, and goes with the tasks.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(data.value)
        for b in slices(batches, "text", 1_000_000):
            rows = [np.append(encoder.encode(t), np.uint32(end)).astype("<u4") for t in b.column("text").fill_null("").to_pylist()]
            counts = np.array([-(-len(r) // size) for r in rows], np.int64)
            cut = [r[max(k * size + len(r) - n * size, 0) : (k + 1) * size + len(r) - n * size] for r, n in zip(rows, counts.tolist()) for k in range(n)]
            lengths = np.array([len(c) for c in cut], np.int64)
            number = np.arange(len(cut)) - np.repeat(np.cumsum(counts) - counts, counts)
            whole = np.repeat([len(r) for r in rows], counts)
            starts = np.where(number == 0, 0, whole - (np.repeat(counts, counts) - number) * size)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.concatenate(cut).astype(np.int32)))
            crc = pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.repeat(np.arange(len(rows)), counts))), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths), ids, crc], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids array<int>, ids_crc32 long")


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each room up to size the best worth of what fits it, the place of one length of that, and the room left beside."""
    best, item, rest = np.zeros(size + 1), np.full(size + 1, -1), np.zeros(size + 1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(int(lengths[0]), size + 1):
        some = best[room - lengths[: fitting[room]]] + prices[: fitting[room]]
        i = int(some.argmax())
        if some[i] > best[room - 1]:
            best[room], item[room], rest[room] = some[i], i, room - lengths[i]
        else:
            best[room], item[room], rest[room] = best[room - 1], item[room - 1], rest[room - 1]
    return best, item, rest


Config = tuple[np.ndarray, np.ndarray]


def filled(first: np.ndarray, lengths: np.ndarray, item: np.ndarray, rest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Configurations, the first length given and the best beside it: (which, place of a length, how often), by which."""
    which, room = np.arange(len(first)), size - lengths[first]
    pairs = [which * len(lengths) + first]
    while len(which):
        more = item[room] >= 0
        which, room = which[more], room[more]
        pairs.append(which * len(lengths) + item[room])
        room = rest[room]
    keys, often = np.unique(np.concatenate(pairs), return_counts=True)
    return keys // len(lengths), keys % len(lengths), often


def priced(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int, step: float) -> tuple[list[tuple[Config, float]], float]:
    """Configurations and how often to use each, in all at most the counts, and a lower bound of the number of sequences, from
    weak duality.

    The price of a length is its share of a sequence times exp(-z / ETA) where it has been covered z times its count, so at
    first all full sequences are worth the same. Each round takes, for every length, the best configuration that holds it,
    if that is worth nearly as much as the best of all, as often as covers no length by more than a step.
    """
    used: dict[bytes, float] = {}
    covered, bound = np.zeros(len(lengths)), 0.0
    for _ in range(rounds):
        prices = lengths / size * np.exp(-(covered - covered.min()) / ETA)
        best, item, rest = knapsack(lengths, prices, size)
        bound = max(bound, float(prices @ counts) / best[size])
        near = np.flatnonzero(prices + best[size - lengths] >= NEAR * best[size])
        which, place, often = filled(near, lengths, item, rest, size)
        often = np.minimum(often, counts[place])
        heads = np.flatnonzero(np.diff(which, prepend=-1))
        times = np.minimum.reduceat(counts[place] / often, heads) * step
        gain = np.bincount(place, times[which] * often, len(lengths)) / counts
        times /= np.maximum.reduceat(np.maximum(gain[place] / step, 1), heads)
        covered += np.bincount(place, times[which] * often, len(lengths)) / counts
        entries = np.stack((place, often), axis=1)
        for k, (i, j) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(which)])):
            key = entries[i:j].tobytes()
            used[key] = used.get(key, 0.0) + float(times[k])
    out = []
    for key, t in used.items():
        place, often = np.frombuffer(key, np.int64).reshape(-1, 2).T
        out.append(((place, often), t / covered[place].max()))
    return out, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """What is left after rounding: the longest piece, then always the longest that fits, as often as counts allow."""
    left, out = counts.copy(), []
    while left.any():
        row, room = np.zeros(len(lengths), np.int64), size
        while True:
            fits = np.flatnonzero((left > row) & (lengths <= room))
            if not len(fits):
                break
            i = fits[-1]
            n = int(min(left[i] - row[i], room // lengths[i]))
            row[i] += n
            room -= n * int(lengths[i])
        times = int((left[row > 0] // row[row > 0]).min())
        left -= row * times
        out.append((np.flatnonzero(row), row[row > 0], times))
    return out


def plan(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS, solutions: int = SOLUTIONS, step: float = STEP) -> tuple[list[tuple[dict[int, int], int]], float]:
    """[(configuration, times)] that hold every piece of histogram {length: number}, and a lower bound of the sequences.

    Solutions of the program are rounded down; the program is solved anew for what that leaves, and what the last leaves
    is placed by best fit. Its work depends on the number of different lengths alone, which is at most size.
    """
    out = [({size: 1}, histogram[size])] if histogram.get(size) else []
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < size), np.int64)
    left = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    bound = -(-int((lengths * left).sum()) // size)
    chosen: list[tuple[np.ndarray, np.ndarray, int]] = []
    for turn in range(solutions):
        here = np.flatnonzero(left)
        if not len(here):
            break
        used, dual = priced(lengths[here], left[here], size, rounds, step)
        bound = max(bound, dual) if turn == 0 else bound
        taken = 0
        for (place, often), t in sorted(used, key=lambda x: -x[1]):
            place = here[place]
            times = min(int(t), int((left[place] // often).min()))
            if times:
                left[place] -= often * times
                chosen.append((place, often, times))
                taken += times
        if not taken:
            break
    chosen += best_fit(lengths, left, size)
    out += [(dict(zip(lengths[place].tolist(), often.tolist())), times) for place, often, times in chosen]
    return out, bound + histogram.get(size, 0)


def slots(chosen: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length and number: (length << 44) + the first number, times, first sequence, offset, length; sorted."""
    rows, taken, sequence = [], {}, 0
    for config, times in chosen:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append(((length << 44) + first, times, sequence, offset, length))
            taken[length] = first + copies * times
            offset += copies * length
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _part, their partition, and _nth, their number among those of their length in it, from 0."""
    schema = rows.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for b in batches:
            lengths = b.column("length").to_numpy()
            if not len(lengths):
                continue
            seen = np.concatenate((seen, np.zeros(max(int(lengths.max()) + 1 - len(seen), 0), np.int64)))
            order = np.argsort(lengths, kind="stable")
            ranked = lengths[order]
            firsts = np.searchsorted(ranked, ranked, "left")
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.arange(len(lengths)) - firsts + seen[ranked]
            seen += np.bincount(lengths, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(nth)], [*b.schema.names, "_part", "_nth"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _part int, _nth long")


def place(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows(length, ...), lengths from 1 to size, with sequence_id and offset: sequences hold at most size and have no gaps.

    Columns of other names go along, but for _part and _nth. To the driver go the counts of at most size lengths; back
    goes the plan, of at most size rows a configuration. Rows are numbered by length inside their partition, and each
    partition's numbers go on where those of the partitions before it end, so no task sees all rows of a length.
    """
    durable = stash(numbered(rows))
    per_part = stash(durable.groupBy("_part", "length").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["_n"] for r in per_part.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    chosen, _ = plan(histogram, size)
    table = rows.sparkSession.sparkContext.broadcast(slots(chosen))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stash(per_part.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    at = durable.join(hinted(offsets, 500_000), ["_part", "length"]).select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, sequence, offset, length = table.value
        for b in batches:
            if not b.num_rows:
                continue
            own, number = b.column("length").to_numpy(), b.column("_number").to_numpy()
            hit = np.searchsorted(keys, (own << 44) + number, "right") - 1
            copy, turn = np.divmod(number - (keys[hit] - (own << 44)), times[hit])
            columns = [b.column(n) for n in b.schema.names if n != "_number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[hit] + turn), pa.array(offset[hit] + copy * length[hit])], [*(n for n in b.schema.names if n != "_number"), "sequence_id", "offset"])

    return at.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of placed(sequence_id, offset, ids, doc_id) after one another; a group is at most one
    sequence's pieces."""
    each = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return each.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def digests(docs: DataFrame, tokenizer_file: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of docs."""
    return place(pieces(docs, tokenizer_file, size).drop("ids"), size)
