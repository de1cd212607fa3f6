"""Quality by co-training: a text-content and a page-metadata classifier teach each other, then are combined.

The content view sees hashed words, shapes, beginnings and ends of words. The metadata view sees where a page comes from
and how it is laid out: source, language, length, lines, shares of kinds of bytes, repetition; never a word. Every text is
hashed once (`views`), and all that follows reads those rows. Each view is fitted on labelled documents; in every round
both score all unlabelled documents, histograms of the scores say which each is surest of, and from those the other is
taught. Both are then calibrated on labelled documents kept apart, and a logistic regression on the two logits scores
everything.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, slices, stash
from .toxicity import held_out

BUCKETS = 1 << 16
#: Bounds of what a fit takes to the driver: labelled documents, documents that a view teaches the other, both by hash of the
#: ids, and words of each, spread evenly over the text.
LABELLED, TAUGHT, WORDS = 4_000, 2_000, 400
ROUNDS = 3
#: Share of all unlabelled documents that a view is let be sure of: so much more each round, for each class in proportion to
#: the labels. They are chosen anew every round, so a view may take back what it taught.
CONFIDENT = 0.1
#: Bins of a histogram of logits from -30 to 30.
BINS = 6_000
HASHED = 32
REMEMBERED = 400_000
_KINDS = [re.compile(p) for p in (r"[A-ZÀ-Þ]+", r"[a-zß-ÿ]+", r"[0-9]+")]


def word_features(word: str) -> list[int]:
    """Buckets of a word, its shape, its first three and its last three characters."""
    w = shape = word
    for mark, kind in zip("Xx9", _KINDS):
        shape = kind.sub(mark, shape)
    return [crc32(x.encode()) % BUCKETS for x in (f"w{w.lower()}", f"s{shape}", f"p{w[:3]}", f"e{w[-3:]}")]


def metadata(text: str, lang: str | None, source: str | None) -> list[float]:
    """The metadata view of one document: numbers near one, then hashed source and language."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    blanks = counts[32] + counts[9:14].sum()
    share = [counts[65:91].sum() / n, counts[48:58].sum() / n, (n - letters - blanks - counts[48:58].sum()) / n, counts[33] / n, counts[124] / n, counts[[35, 36, 37, 38, 42, 60, 62]].sum() / n]
    layout = [np.log1p(len(data)) / 5, np.log1p(len(lines)) / 3, np.log1p(m / len(lines)) / 3, len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(set(lines)) / len(lines), float(counts[128:].sum()) / n]
    hashed = [0.0] * HASHED
    hashed[crc32(f"s{source}".encode()) % (HASHED - 8)] = 0.3
    hashed[HASHED - 8 + crc32(f"l{lang}".encode()) % 8] = 0.3
    return [1.0, *(4 * float(x) for x in share), *(float(x) for x in layout), *hashed]


def _logit(p: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(p, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a quadratic pull to zero."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logit(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + pull * np.eye(x.shape[1])
        d = np.linalg.solve(h, x.T @ (p - y) + pull * w)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def fit_content(rows: list[np.ndarray], y: np.ndarray, seed: int, epochs: int = 12) -> tuple[np.ndarray, float]:
    """(gain, bias): a document's logit is the mean gain of its word features plus the bias. Mini-batch Adam."""
    rng = np.random.default_rng(seed)
    gain, bias = np.zeros(BUCKETS), 0.0
    m, v, mb, vb, step = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            sizes = np.array([len(rows[i]) for i in batch])
            flat, owner = np.concatenate([rows[i] for i in batch]), np.repeat(np.arange(len(batch)), sizes)
            z = np.bincount(owner, gain[flat], len(batch)) / np.maximum(sizes, 1) + bias
            g = (_logit(z) - y[batch]) / len(batch)
            grad = np.bincount(flat, (g / np.maximum(sizes, 1))[owner], BUCKETS) + 1e-7 * gain
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
            rate = 0.5
            gain -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return gain, float(bias)


def means(values: np.ndarray, bags: list[bytes]) -> np.ndarray:
    """The mean value of each bag's features; an empty bag's is zero."""
    sizes = np.array([len(b) // 2 for b in bags], np.int64)
    flat = np.frombuffer(b"".join(bags), "<u2")
    return np.bincount(np.repeat(np.arange(len(bags)), sizes), values[flat], len(bags)) / np.maximum(sizes, 1)


@dataclass
class Model:
    gain: np.ndarray
    bias: float
    meta: np.ndarray
    #: Of each view a scale and a shift; then the weights of the combined logits: constant, content, metadata.
    calibration: np.ndarray
    combine: np.ndarray

    def logits(self, bags: list[bytes], meta: np.ndarray) -> list[np.ndarray]:
        """The logits of the content view and of the metadata view, before calibration."""
        return [np.clip(x, -30, 30) for x in (means(self.gain, bags) + self.bias, meta @ self.meta)]

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibration[0] * content + self.calibration[1]
        b = self.calibration[2] * meta + self.calibration[3]
        return _logit(a), _logit(b), _logit(self.combine[0] + self.combine[1] * a + self.combine[2] * b)


def views(docs: DataFrame) -> DataFrame:
    """A stash of (doc_id, words, meta) for every row of docs: the features of all words of the whole text, two bytes each,
    and the metadata view. Null texts are empty, null sources and languages values of their own, ids longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, bytes] = {}
        pack = struct.Struct("<4H").pack
        for b in slices(batches, "text", 4_000_000):
            texts, bags = b.column("text").fill_null("").to_pylist(), []
            for words in (t.split() for t in texts):
                if len(memory) > REMEMBERED:
                    memory.clear()
                for w in words:
                    if w not in memory:
                        memory[w] = pack(*word_features(w))
                bags.append(b"".join(map(memory.__getitem__, words)))
            meta = [np.array(metadata(t, a, s), "<f4").tobytes() for t, a, s in zip(texts, b.column("lang").to_pylist(), b.column("source").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "words", "meta"])

    return stash(docs.select("doc_id", "text", "lang", "source").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary, meta binary"))


def _rows(b: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    meta = b.column("meta").to_pylist()
    return b.column("words").to_pylist(), np.frombuffer(b"".join(meta), "<f4").reshape(len(meta), -1).astype(float)


def _mapped(seen: DataFrame, model: Model, names: list[str], of: str) -> DataFrame:
    """(doc_id, names...) for every row of views: the model's logits, or its scores."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", 4_000_000):
            found = shared.value.logits(*_rows(b))
            if of == "scores":
                found = shared.value.scores(*found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.float64()) for x in found)], ["doc_id", *names])

    return seen.mapInArrow(run, ", ".join([f"doc_id {seen.schema['doc_id'].dataType.simpleString()}", *(f"{n} double" for n in names)]))


def cuts(counts: np.ndarray, part: float, share: float) -> tuple[int, int]:
    """(low, high) for one view's histogram: bins up to low are surely bad, from high on surely good.

    Together they hold about `part` of all, `share` of that good. The bin that reaches the number is taken whole, so equal scores
    stay together; bad ones lie below a logit of zero, good ones above. -1 and BINS where there are none.
    """
    total = counts.sum()
    low = int(np.searchsorted(counts.cumsum(), max(1, part * (1 - share) * total)))
    high = BINS - 1 - int(np.searchsorted(counts[::-1].cumsum(), max(1, part * share * total)))
    return (min(low, BINS // 2 - 1), max(high, BINS // 2)) if total else (-1, BINS)


def confident(pool: DataFrame, labels: DataFrame, model: Model, part: float, share: float, taught: int) -> DataFrame:
    """(doc_id, view, quality): what each view (0 content, 1 metadata) teaches the other, by the scores of all of `pool` that
    is not in labels; of those at most `taught` a view, by hash of the id, good ones `share` of it.

    Only the histograms, at most 2 * BINS numbers, reach the driver. Rows without an id are in none.
    """
    scored = stash(_mapped(pool, model, ["z0", "z1"], "logits").where("doc_id is not null").join(hinted(labels.select("doc_id").distinct()), "doc_id", "left_anti"))
    bins = [F.least(F.floor((F.col(z) + 30) * (BINS / 60)), F.lit(BINS - 1)).cast("int") for z in ("z0", "z1")]
    counts = np.zeros((2, BINS), np.int64)
    both = scored.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), b.alias("bin")) for v, b in enumerate(bins)))).alias("x"))
    for r in both.groupBy("x.view", "x.bin").count().collect():
        counts[r.view, r.bin] = r["count"]
    good = round(taught * share)
    found = []
    for v in (0, 1):
        low, high = cuts(counts[v], part, share)
        for quality, sure, most in ((0, bins[v] <= low, taught - good), (1, bins[v] >= high, good)):
            found.append(scored.where(sure).select("doc_id", F.lit(v).alias("view"), F.lit(quality).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    picked = stash(found[0].union(found[1]).union(found[2]).union(found[3]))
    discard(scored)
    return picked


def sample(seen: DataFrame, chosen: DataFrame, words_each: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """view, word features, metadata and quality of the chosen (doc_id, view, quality) on the driver, in order of ids. Of rows with
    the same id one counts."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", 4_000_000):
            # a word has four features of two bytes
            bags = [np.frombuffer(x, "<u8") for x in b.column("words").to_pylist()]
            few = [(w[np.arange(words_each) * len(w) // words_each] if len(w) > words_each else w).tobytes() for w in bags]
            yield b.set_column(b.schema.get_field_index("words"), "words", pa.array(few, pa.binary()))

    rows = seen.join(F.broadcast(chosen), "doc_id").select("doc_id", "view", "quality", "words", "meta")
    rows = rows.mapInArrow(thin, rows.schema).groupBy("doc_id", "view", "quality").agg(F.min(F.struct("words", "meta")).alias("x")).select("doc_id", "view", "quality", "x.*")
    found = rows.toArrow().combine_chunks().sort_by([(c, "ascending") for c in ("doc_id", "view", "quality")])
    if not found.num_rows:
        return np.zeros(0, int), [], np.zeros((0, len(metadata("", None, None)))), np.zeros(0, int)
    words, meta = _rows(found)
    return found.column("view").to_numpy(), [np.frombuffer(w, "<u2") for w in words], meta, found.column("quality").to_numpy()


def fit(seen: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT, words_each: int = WORDS, seed: int = 11) -> Model:
    """A model from views and labels(doc_id, quality), without held-out labels. With one class only, every document gets that
    class's share.

    The driver takes at most `labelled` labelled and, from each view, `taught` pseudo-labelled documents, `words_each` words of
    each. What is pseudo-labelled is found among all unlabelled documents, scored whole.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", F.lit(-1).alias("view"), "quality")
    _, rows, meta, y = sample(seen, chosen, words_each)
    share = float((y == 1).sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        z = float(np.log(share / (1 - share)))
        return Model(np.zeros(BUCKETS), z, np.eye(1, meta.shape[1])[0] * z, np.array([1.0, 0, 1, 0]), np.array([0, 0.5, 0.5]))
    order = np.random.default_rng(seed).permutation(len(y))
    apart, own = order[: len(y) // 4], np.sort(order[len(y) // 4 :])

    def train(taught: tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]) -> Model:
        by, more, more_meta, label = taught
        from_content, from_meta = np.flatnonzero(by == 0), np.flatnonzero(by == 1)
        gain, bias = fit_content([rows[i] for i in own] + [more[i] for i in from_meta], np.concatenate((y[own], label[from_meta])).astype(float), seed)
        w = newton(np.concatenate((meta[own], more_meta[from_content])), np.concatenate((y[own], label[from_content])).astype(float))
        return Model(gain, bias, w, np.array([1.0, 0, 1, 0]), np.array([0, 0.5, 0.5]))

    model = train((np.zeros(0, int), [], meta[:0], y[:0]))
    for turn in range(1, ROUNDS + 1):
        picked = confident(seen, labels, model, CONFIDENT * turn, share, taught)
        model = train(sample(seen, picked, words_each))
        discard(picked)
    test = y[apart].astype(float)
    z = model.logits([rows[i].tobytes() for i in apart], meta[apart])
    scaled = [newton(np.stack([x, np.ones(len(x))], axis=1), test, 0.01) for x in z]
    both = np.stack([np.ones(len(apart)), *(x * s[0] + s[1] for x, s in zip(z, scaled))], axis=1)
    return Model(model.gain, model.bias, model.meta, np.concatenate(scaled), newton(both, test, 0.01))


def score(seen: DataFrame, model: Model) -> DataFrame:
    """(doc_id, content_score, metadata_score, score) for every row of views, whole texts and repeated rows included."""
    return _mapped(seen, model, ["content_score", "metadata_score", "score"], "scores")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, content_score, metadata_score, score, predicted, kept) for every row of docs.

    Rows without an id are scored and never learnt from; repeated rows and equal texts of a source and language score alike;
    empty tables give no rows. Extra columns are ignored.
    """
    seen = views(docs)
    good = F.col("score") >= 0.5
    return score(seen, fit(seen, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", good.cast("int").alias("predicted"), good.alias("kept"))
