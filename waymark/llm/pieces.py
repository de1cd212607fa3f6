"""SentencePiece BPE encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, and every normalised
character records the bytes of the text it came from, so each piece projects to a span of original bytes. Pieces never
hold an escaped blank after another character (checked on loading), so a normalised text falls into chunks, blanks then
letters, that encode alone; each different chunk of a batch is merged once, and numpy places its ids and spans.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, slices

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Different chunks that a worker remembers; beyond it forgets them and merges anew, with the same result.
REMEMBERED = 100_000
CHUNKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message, in order."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + n]
        i += n


class CharMap:
    """The compiled character map: a double-array trie of byte strings, and the strings that replace them."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob) if blob else (0,)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        # Runs of ASCII in which no prefix is known: neither a character alone nor with what ASCII may follow.
        quiet = bytes(b for b in range(128) if self.units and not any(self.longest(bytes([b, c]), 0) for c in range(128)))
        self.quiet = re.compile(b"[" + re.escape(quiet) + rb"]+(?![\x80-\xff])") if quiet else None

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[i:] and its replacement; None if none is known."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        best, at = None, step(self.units[0])
        for k in range(i, len(data)):
            at ^= data[k]
            if at >= len(self.units) or (unit := self.units[at]) & 0x800000FF != data[k]:
                break
            at ^= step(unit)
            if unit >> 8 & 1:
                best = (k + 1 - i, self.units[at] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


def normaliser_spec(name: str) -> bytes:
    """The normaliser of a rule that the library knows, as its model has it."""
    return dict(fields(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()))[3]


class Model:
    """A model read from its file. normaliser names a rule of the library that takes the place of the model's own map."""

    def __init__(self, data: bytes, normaliser: str | None = None):
        self.pieces: list[tuple[str, float, int]] = []
        spec = {}
        byte_fallback, kind, suffix = 0, 1, 0
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                byte_fallback, kind, suffix = trainer.get(35, 0), trainer.get(3, 1), trainer.get(24, 0)
            elif number == 3:
                spec = dict(fields(value))
        self.map = CharMap((dict(fields(normaliser_spec(normaliser))) if normaliser else spec).get(2, b""))
        self.prefix, self.trim, self.escape = spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        if kind != 2 or suffix or not byte_fallback or not self.escape or any(k in (USER, UNUSED) or BLANK in p.lstrip(BLANK) for p, _, k in self.pieces):
            raise ValueError("only BPE models with byte fallback, escaped blanks at the start of pieces, and no user or unused pieces")
        self.ids = {p: (i, s) for i, (p, s, k) in enumerate(self.pieces) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.widths = np.array([1 if k == BYTE else len(p.encode()) for p, _, k in self.pieces], np.int64)
        self.memory: dict[str, bytes] = {}
        self.library = None
        if self.prefix and not self.map.units and not self.trim:
            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes the original byte offset, with the end last."""
        data = text.encode()
        if not self.map.units and not self.trim:
            body, offsets = text.replace(" ", BLANK), None
            if " " in text:
                widths = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
                offsets = np.repeat(np.arange(len(data)), widths)
        else:
            out, marks, i = [], [], 0
            while i < len(data):
                if self.map.quiet and (run := self.map.quiet.match(data, i)):
                    out.append(run[0])
                    marks.append(np.arange(i, run.end()))
                    i = run.end()
                    continue
                hit = self.map.longest(data, i)
                n = hit[0] if hit else 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = hit[1] if hit else data[i : i + n]
                out.append(new)
                marks.append(np.full(len(new), i))
                i += n
            joined = b"".join(out)
            keep = np.ones(len(joined), bool)
            if self.trim:
                blank = np.frombuffer(joined, np.uint8) == 0x20
                keep = ~(blank & np.concatenate(([True], blank[:-1])))
                last = np.flatnonzero(~blank)
                keep[(last[-1] + 1 if len(last) else 0) :] = False
            kept = np.frombuffer(joined, np.uint8)[keep]
            body = kept.tobytes().decode().replace(" ", BLANK)
            starts = np.concatenate([*marks, np.zeros(0, np.int64)])[keep]
            offsets = np.repeat(starts, np.where(kept == 0x20, 3, 1))
        if offsets is None:
            offsets = np.arange(len(data))
        if self.prefix and body:
            body, offsets = BLANK + body, np.concatenate((np.full(3, offsets[0] if len(offsets) else 0), offsets))
        end = len(data)
        return body, np.append(offsets, end)

    def merge(self, chunk: str) -> list[str]:
        """BPE: the best-scored neighbouring pair first, the leftmost among equals."""
        symbols: list[str | None] = list(chunk)
        after, before = [*range(1, len(symbols)), -1], list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.ids.get(symbols[a] + symbols[b])):
                heapq.heappush(heap, (-found[1], a, b, len(symbols[a]) + len(symbols[b])))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as int32 bytes. The library merges where it normalises to the same chunk again."""
        if self.library:  # it drops a lone blank, which is a piece
            found = [ids or [self.ids[BLANK][0]] for ids in self.library.encode([c[1:].replace(BLANK, " ") for c in chunks], num_threads=1)]
        else:
            found = [[i for p in self.merge(c) for i in ([self.ids[p][0]] if p in self.ids else [self.byte_ids[b] for b in p.encode()])] for c in chunks]
        return [array("i", ids).tobytes() for ids in found]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each text its ids, and the start and end of each piece in the text's original UTF-8 bytes.

        A byte piece has the span of its byte of the normalised text."""
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        place, parts = {}, []
        for text in texts:
            body, offsets = self.normalise(text)
            parts.append((np.array([place.setdefault(c, len(place)) for c in CHUNKS.findall(body)], np.int64), offsets))
        new = [c for c in place if c not in self.memory]
        fresh = dict(zip(new, self.chunk_ids(new)))
        known = [fresh[c] if c in fresh else self.memory[c] for c in place]
        self.memory.update((c, ids) for c, ids in fresh.items() if len(c) < 64)
        flat = np.frombuffer(b"".join(known), np.int32)
        counts = np.array([len(k) // 4 for k in known], np.int64)
        firsts = np.cumsum(counts) - counts
        out: tuple[list, list, list] = ([], [], [])
        for c, offsets in parts:
            n = counts[c]
            ids = flat[np.arange(n.sum()) + np.repeat(firsts[c] - (np.cumsum(n) - n), n)]
            ends = np.cumsum(self.widths[ids])
            out[0].append(ids)
            out[1].append(offsets[ends - self.widths[ids]])
            out[2].append(offsets[ends])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their escapes, runs of bytes as UTF-8, without the blank that encoding put first."""
        if not ids:
            return ""
        text = b"".join(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, _, k in (self.pieces[i] for i in ids))
        text = text.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def decode_all(model: Model, rows: list[np.ndarray]) -> list[str]:
    """decode() of many texts: pieces come from one table of bytes."""
    raw = getattr(model, "raw", None)
    if raw is None:
        raw = model.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(BLANK, " ").encode() for p, _, k in model.pieces]
    texts = (b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace") for ids in rows)
    return [t[1:] if model.prefix and t.startswith(" ") else t for t in texts]


def encode(docs: DataFrame, model_file: str, normaliser: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded): for every row of docs(doc_id, text) its ids, each piece's span in the
    original UTF-8 bytes (end exclusive), and the ids decoded again.

    A null text is an empty one: no ids, decoded "". Repeated rows stay; extra columns are ignored. The model is read
    on the driver, is of fixed size, and goes with the task. normaliser: see Model.
    """
    with open(model_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(data.value, normaliser)
        ints = lambda rows: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
        for b in slices(batches, "text", 500_000):
            ids, starts, ends = model.encode(b.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ints(ids), ints(starts), ints(ends), pa.array(decode_all(model, ids), pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    return in_tasks(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, model_file: str, normaliser: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans) of encode(); spans is a 64-bit hash of all starts, then ends."""
    return encode(docs, model_file, normaliser).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.lower(F.lpad(F.hex(F.xxhash64("starts", "ends")), 16, "0")).alias("spans"),
    )
