"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, all hashed into one table; a passage is the mean
of its words; a linear softmax over that mean gives two classes. Table and softmax are learnt together by Adam. Unseen
misspellings and inflections share n-grams with known words. Labels belong to documents, insults to a few of their words:
after a first fit on whole documents, toxic ones are represented by their most toxic passages. A document's score is that
of its most toxic passage, so a long text is judged as a short one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, release, slices

TOKEN = re.compile(r"\w+")
#: Rows of the hashed table, their width, and lengths of the n-grams.
BUCKETS = 1 << 18
WIDTH = 8
GRAMS = (3, 5)
#: Characters of the pieces that longer words are cut into, and of the overlap of neighbouring pieces.
LONGEST, OVERLAP = 24, 4
#: Words of a passage; each is scored together with none of its neighbours' words.
PASSAGE = 8
#: Bounds of the training sample: toxic and other labelled documents, taken by hash, and passages of each, spread
#: evenly; documents that calibrate; and passages of a training step.
SAMPLE = {1: 3_000, 0: 6_000}
CALIBRATION = 3_000
#: How much worse a missed toxic document is than a rejected clean one; calibration weighs labels by it.
MISS = 3.0
PASSAGES = {1: 64, 0: 16}
BATCH = 3072
#: Pull of a touched vector towards zero.
DECAY = 3e-5
#: Uses in the sample under which a bucket keeps the zero vector: a part of the documents, and the most and least of it.
LEAST = (400, 20, 3)
#: Scores of words that a worker remembers before it forgets them all.
REMEMBERED = 400_000


def tokens(text: str) -> list[str]:
    """The words of a text in lower case. A word of over LONGEST characters is its overlapping pieces, in which every
    run of OVERLAP + 1 of its characters lies whole, so that a script without blanks is read to its end."""
    words = TOKEN.findall(text.lower())
    if all(len(w) <= LONGEST for w in words):
        return words
    step = LONGEST - OVERLAP
    return [w[i : i + LONGEST] for w in words for i in range(0, max(1, len(w) - OVERLAP), step)]


def grams(word: str) -> list[int]:
    """Buckets of a word and its n-grams, with marks at both ends."""
    marked = f"<{word}>".encode()
    return [crc32(marked) % BUCKETS] + [crc32(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


def passages(text: str) -> list[list[str]]:
    words = tokens(text)
    return [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]


@dataclass
class Model:
    """gain[f] is the softmax's difference between the classes on the vector of bucket f; a passage's logit is the mean
    of its words' mean gains, plus the bias."""

    gain: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, words: dict[str, float], texts: list[str]) -> list[float]:
        """The logit of each text's most toxic passage; the bias alone for a text without words."""
        rows = [tokens(text) for text in texts]
        self.learn(words, set().union(*rows))
        out = []
        for row in rows:
            if not row:
                out.append(self.bias)
                continue
            g = np.fromiter(map(words.__getitem__, row), np.float64, len(row))
            starts = np.arange(0, len(g), PASSAGE)
            sums, sizes = np.add.reduceat(g, starts), np.minimum(PASSAGE, len(g) - starts)
            out.append(float((sums / np.maximum(sizes, PASSAGE // 2)).max()) + self.bias)
        return out

    def learn(self, words: dict[str, float], needed: set[str]) -> None:
        """Adds the gains of the needed words that are not there; forgets the others first if there are too many."""
        if len(words) > REMEMBERED:
            words.clear()
        new = list(needed - words.keys())
        if new:
            parts = [grams(w) for w in new]
            sizes = np.array([len(p) for p in parts])
            gains = np.add.reduceat(self.gain[np.fromiter((x for p in parts for x in p), np.int64)], np.cumsum(sizes) - sizes) / sizes
            words.update(zip(new, gains.tolist()))

    def of_bags(self, bags: list[list[str]]) -> np.ndarray:
        """The logit of each passage, given as words."""
        words: dict[str, float] = {}
        self.learn(words, {w for b in bags for w in b})
        return np.array([sum(words[w] for w in b) / max(len(b), PASSAGE // 2) for b in bags]) + self.bias

    def scores(self, words: dict[str, float], texts: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * x + self.shift)))) for x in self.logits(words, texts)]


def _fit(bags: list[list[str]], labels: np.ndarray, epochs: int, rng: np.random.Generator, n_docs: int) -> Model:
    """Adam over mini-batches of passages; only the rows of the table that a batch touches are updated. Both classes
    weigh the same together."""
    n_toxic = max(1, int(labels.sum()))
    weights = np.where(labels == 1, len(labels) / (2 * n_toxic), len(labels) / (2 * max(1, len(labels) - n_toxic))).astype(np.float32)
    vocabulary: dict[str, int] = {}
    ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in bag] for bag in bags]
    parts = [np.array(grams(w)) for w in vocabulary]
    flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    firsts = np.cumsum(sizes) - sizes
    table = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 1, (2, WIDTH)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    often = np.bincount([w for bag in ids for w in bag], minlength=len(parts))
    active = np.bincount(flat, np.repeat(often, sizes), BUCKETS) >= max(LEAST[2], min(LEAST[1], n_docs // LEAST[0]))
    table[~active] = 0  # what is this rare could only be learnt by heart
    lookup = np.zeros(BUCKETS, np.int64)
    m, v = np.zeros_like(table), np.zeros_like(table)
    ms, vs, mb, vb = np.zeros_like(soft), np.zeros_like(soft), np.zeros_like(bias), np.zeros_like(bias)
    rate, b1, b2, step = 0.05, 0.9, 0.99, 0
    size = min(BATCH, max(64, len(ids) // 24))  # a small sample is passed in as many steps
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), size):
            batch = order[at : at + size]
            words = np.array([w for i in batch for w in ids[i]])
            owner = np.repeat(np.arange(len(batch)), [len(ids[i]) for i in batch])
            n = np.maximum(np.bincount(owner, minlength=len(batch)), PASSAGE // 2).astype(np.float32)
            seen, place = np.unique(words, return_inverse=True)
            take = np.repeat(firsts[seen] - (np.cumsum(sizes[seen]) - sizes[seen]), sizes[seen]) + np.arange(sizes[seen].sum())
            rows = flat[take]
            starts = np.cumsum(sizes[seen]) - sizes[seen]
            vectors = np.add.reduceat(table[rows], starts, axis=0) / sizes[seen][:, None]
            edge = np.searchsorted(owner, np.arange(len(batch)))
            hidden = np.add.reduceat(vectors[place], edge, axis=0) / n[:, None]
            z = hidden @ soft.T + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= (weights[batch] / len(batch))[:, None]
            g_soft, g_bias, g_hidden = p.T @ hidden, p.sum(axis=0), p @ soft
            g_bag = (g_hidden / n[:, None])[owner]
            g_word = np.stack([np.bincount(place, g_bag[:, k], len(seen)) for k in range(WIDTH)], axis=1) / sizes[seen][:, None]
            touched = np.flatnonzero(np.bincount(rows, minlength=BUCKETS))
            lookup[touched] = np.arange(len(touched))
            where = lookup[rows]
            spread = np.repeat(g_word, sizes[seen], axis=0)
            g_rows = np.stack([np.bincount(where, spread[:, k], len(touched)) for k in range(WIDTH)], axis=1).astype(np.float32) + DECAY * table[touched]
            g_rows[~active[touched]] = 0
            step += 1
            fix1, fix2 = 1 - b1**step, 1 - b2**step
            m[touched] = b1 * m[touched] + (1 - b1) * g_rows
            v[touched] = b2 * v[touched] + (1 - b2) * g_rows**2
            table[touched] -= rate * (m[touched] / fix1) / (np.sqrt(v[touched] / fix2) + 1e-8)
            for x, g, mm, vv in ((soft, g_soft, ms, vs), (bias, g_bias, mb, vb)):
                mm[:] = b1 * mm + (1 - b1) * g
                vv[:] = b2 * vv + (1 - b2) * g**2
                x -= rate * (mm / fix1) / (np.sqrt(vv / fix2) + 1e-8)
    side = soft[1] - soft[0]
    return Model((table @ side).astype(np.float32), float(bias[1] - bias[0]))


def train(texts: list[list[list[str]]], labels: np.ndarray, seed: int = 7) -> Model:
    """A model from documents as lists of passages. With one class only, every text gets that class's share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    every = [(i, p) for i, t in enumerate(texts) for p in t]
    owner = np.array([i for i, _ in every])
    bags = [p for _, p in every]
    half = rng.permutation(len(labels)) % 2
    chosen = np.ones(len(bags), bool)
    for epochs in (3, 5):
        logit = np.zeros(len(bags))
        for side in (0, 1):  # passages are chosen by a model that has not seen their documents
            use = np.flatnonzero(chosen & (half[owner] == side))
            other = np.flatnonzero(half[owner] != side)
            logit[other] = _fit([bags[i] for i in use], labels[owner[use]], epochs, rng, len(labels)).of_bags([bags[i] for i in other])
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, owner, logit)
        chosen = (labels[owner] == 0) | (logit >= best[owner]) | (logit > 0)
    use = np.flatnonzero(chosen)
    return _fit([bags[i] for i in use], labels[owner[use]], 8, rng, len(labels))


def calibrated(model: Model, best: np.ndarray, labels: np.ndarray) -> Model:
    """The model with the scale and shift by which a document's best logit becomes a probability, from documents it has
    not seen: logistic regression by Newton's method. Without both classes the model stays as it is."""
    if not len(labels) or labels.min() == labels.max():
        return model
    x, y = np.clip(best, -30, 30), labels.astype(float)
    cost = np.where(labels == 1, MISS, 1.0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = cost * np.maximum(p * (1 - p), 1e-6)
        d = cost * (p - y)
        g = np.array([(d * x).sum() + 0.01 * (a - 1), d.sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
        if abs(d).max() < 1e-6:
            break
    return Model(model.gain, model.bias, max(a, 0.05), b)


def fifth(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five; a null id is not held out."""
    return F.coalesce(fifth(doc_id) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, seed: int = 7) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), learnt from rows that are not held out.

    Of the fifths that crc32 makes of the ids, one is held out, three are learnt from and one calibrates. At most `sample`
    labelled documents of each class, those with the smallest hash of their ids, reach the driver, each as at most
    PASSAGES passages spread evenly over its whole text; at most CALIBRATION others are scored whole. Null labels, ids and texts are passed
    over.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = fifth(F.col("doc_id"))
    some = lambda rows, most: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for text, toxic in zip(b.column("text").fill_null("").to_pylist(), b.column("toxic").to_pylist()):
                every, most = passages(text), PASSAGES[toxic]
                few = [every[i * len(every) // most] for i in range(most)] if len(every) > most else every
                rows.append([" ".join(p) for p in few])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(rows, pa.list_(pa.string()))], ["doc_id", "toxic", "passages"])

    both = some(known.where((part > 1) & (F.col("toxic") == 1)), sample[1]).union(some(known.where((part > 1) & (F.col("toxic") == 0)), sample[0]))
    learnt = texts.join(F.broadcast(both), "doc_id").select("doc_id", "toxic", "text")
    rows = in_tasks(learnt, cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, passages array<string>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["passages"]))
    rows = [r for r in rows if r["passages"]]
    one: dict[str, str] = {}  # of equal words one copy
    cut_up = [[[one.setdefault(w, w) for w in p.split(" ")] for p in r["passages"]] for r in rows]
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    del rows
    model = train(cut_up, toxic, seed)
    del cut_up, one
    apart = F.broadcast(some(known.where(part == 1), CALIBRATION))
    seen = score(texts.join(apart.select("doc_id"), "doc_id"), model, logit=True).join(apart, "doc_id").select("score", "toxic").collect()
    return calibrated(model, np.array([r["score"] for r in seen]), np.array([r["toxic"] for r in seen], np.int64))


def score(docs: DataFrame, model: Model, logit: bool = False) -> DataFrame:
    """(doc_id, score), or logits in place of scores, for every row of docs(doc_id, text), over whole texts. Null, empty and wordless texts score what
    the model says without evidence. Repeated rows stay; extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, float] = {}
        call = shared.value.logits if logit else shared.value.scores
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(call(words, b.column("text").fill_null("").to_pylist()), pa.float64())], ["doc_id", "score"])

    return in_tasks(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, from a model that never saw held-out labels."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under `at`, columns unchanged."""
    model = fit(docs, labels)
    release()  # later stages share the driver
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = shared.value, {}
        for b in slices(batches, "text"):
            yield b.filter(pa.array([s < at for s in m.scores(words, b.column("text").fill_null("").to_pylist())], pa.bool_()))

    return in_tasks(docs, run, docs.schema)
