"""Words of texts, and every three of them in a row, as 64-bit numbers: keys by which texts that hold a line are found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are read at a time, at least a text.
CHUNK = 1 << 20
#: Bytes of words: letters, digits and _ of ASCII, and all others beyond it.
WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
BASE = 0x9E3779B97F4A7C15
POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n, and the inverses of those, modulo 2 ** 64."""
    if len(POWERS.get("up", ())) <= n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            POWERS[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK), base, np.uint64)]), dtype=np.uint64)
    return POWERS["up"], POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, cuts) of runs of texts: the number of the first one, their bytes, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    x = 0
    while x < len(texts):
        y = max(x + 1, int(np.searchsorted(at, at[x] + CHUNK, "right")) - 1)
        yield x, data[at[x] : at[y]], at[x : y + 1] - at[x]
        x = y


def _spelled(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, h, size) of every word: the number of its text, its hash and its bytes."""
    word = np.append(WORD[data], False)
    joined = word[1:] & word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    joined[inner - 1] = False
    starts = np.flatnonzero(word[:-1] & ~np.concatenate([[False], joined[:-1]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word[:-1] & ~joined) + 1 if len(data) else starts
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    return np.searchsorted(cuts, starts, "right") - 1, _mixed((sums[ends] - sums[starts]) * down[starts]), ends - starts


def _pieces(text: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of every three words in a row of a text."""
    if len(h) < 3:
        return text[:0], h[:0], size[:0]
    here = text[:-2] == text[2:]
    three = _mixed(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
    return text[:-2][here], three[here], (size[:-2] + size[1:-1] + size[2:])[here]


def listed(every: int, wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (of, text) -> (of, h), once each for a text: its pieces that `every` divides, and of its pieces and words those
    that are wanted, sorted numbers; all if that is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("of").to_numpy(zero_copy_only=False)
            for first, data, cuts in _chunks(b.column("text")):
                words = _spelled(data, cuts)
                pieces = _pieces(*words)
                text, h = (np.concatenate([p, w]) for p, w in zip(pieces[:2], words[:2]))
                keep = np.arange(len(h)) < len(pieces[0])
                keep &= h % np.uint64(every) == 0
                if wanted is None:
                    keep[:] = True
                elif len(wanted):
                    keep |= wanted[np.minimum(np.searchsorted(wanted, h.view(np.int64)), len(wanted) - 1)] == h.view(np.int64)
                text, h = text[keep], h[keep]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(names[first + text[new]]), pa.array(h[new].view(np.int64))], ["of", "h"])

    return run


def keyed(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (line) -> (line, h, rank): the number by which texts that hold a line are found, and what it is: 2 a piece that
    listed() has whatever is wanted, 1 another piece, 0 a word; null where there is none.

    The first and last word of the line may go on in the text, so only words between them count. The longest of their
    pieces that `every` divides is taken; else the longest piece, else the longest word of at least three bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, ranks = np.zeros(b.num_rows, np.uint64), np.full(b.num_rows, -1, np.int32)
            for first, data, cuts in _chunks(b.column("line")):
                text, h, size = _spelled(data, cuts)
                same = text[1:] == text[:-1]
                inner = np.append(False, same)[: len(text)] & np.append(same, False)[: len(text)]
                words = (text[inner], h[inner], size[inner])
                pieces = _pieces(*words)
                rank = np.where(pieces[1] % np.uint64(every) == 0, 2, 1)
                three = words[2] >= 3
                text, h, size = (np.concatenate([p, w[three]]) for p, w in zip(pieces, words))
                rank = np.concatenate([rank, np.zeros(len(h) - len(rank), rank.dtype)])
                order = np.lexsort((h, size, rank, text))
                last = order[np.append(text[order][1:] != text[order][:-1], True)[: len(order)]]
                at = first + text[last]
                best[at], ranks[at] = h[last], rank[last]
            yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(best.view(np.int64), mask=ranks < 0), pa.array(ranks, mask=ranks < 0)], ["line", "h", "rank"])

    return run
