"""Secret scans: three base patterns, and a battery of randomness tests over the other long tokens.

For a token the smallest alphabet that holds its characters is inferred (hex, base 32, letters, base 64 and so on). Three
tests ask whether it may be uniform there: chi-squared over the alphabet, by pairs of equal characters; runs above and below
the middle; and serial correlation, by how much more often neighbours as these follow one another in written tokens. Their
means and variances under uniformity are exact at any length, and one that rejects clears the token.

False discoveries are controlled on how seldom what is written looks so random. Written tokens are a mixture of ways of
writing (words with and without capitals, with and without numbers, numbers alone, joined as in identifiers and paths),
each a chain in which a character depends on the one before and on the kind of the one before that. If a token has probability u as a uniform one and w as a written one, then by Markov's
inequality written tokens have a ratio of at least u / w with probability w / u at most: that is the p-value, an exact
bound under the mixture, which falls exponentially with the length. Benjamini and Hochberg's rule runs on it over all
candidates of the corpus, apart for each alphabet and class of length, as what is written fills some and hardly others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, slices, stash

#: The base kinds in their order, and the least length of group 2 or of the match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Tokens that the battery looks at.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
#: Base kinds that may be cut out of a longer key, and how that key goes on.
WITHIN = (1, 2)
GOES_ON = re.compile(r"[A-Za-z0-9+]*")
#: Alphabets from small to large; the first that holds all characters is the inferred encoding.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "signs": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: How often English uses each letter, in percent, from the commonest; vowels.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.1, 0.07)))
VOWELS = "aeiouy"
#: Simulated written tokens of each alphabet, from which the chains are counted, and their length.
SIMULATED = 20_000
SIMULATED_LENGTH = 64
#: Share of a written token's characters that may be anything.
ANYTHING = 0.02
#: Digits alone are amounts, dates and account numbers; written hex repeats little, so both need the base patterns.
UNTESTED = ("digits",)
#: Level under which the battery rejects uniformity, and the false discovery rate.
REJECT = 0.001
RATE = 0.01
MASK = "[secret]"
#: Least lengths of the length classes, and the bins of -10 log10 p that the corpus is counted in.
CLASSES = (20, 24, 32, 48, 96)
BINS = 400
#: Where an alphabet's classes begin: discoveries are controlled apart for each alphabet and class of length.
STRATA = {name: i * len(CLASSES) for i, name in enumerate(ALPHABETS)}


#: How often a number follows a word, in three ways of writing; a fourth is numbers alone.
NUMBERS = (0.05, 0.3, 0.6)


def written(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens as people write them in an alphabet, as rows of places, and the way each is written: words of letters by their
    frequency, vowels and consonants in turns more often than not, some with numbers behind, joined as in identifiers."""
    alphabet, rng, rows = ALPHABETS[name], np.random.default_rng(1), SIMULATED
    hexadecimal = name.lower() == "hex"
    letters = [c for c in LETTERS if not hexadecimal or c in "abcdef"]
    weight, vowel = np.array([LETTERS[c] for c in letters]), np.array([c in VOWELS for c in letters])
    within = np.where(vowel, weight / weight[vowel].sum(), weight / weight[~vowel].sum())
    after = np.cumsum([np.where(vowel, p, 1 - p) * within for p in (0.6, 0.15)], axis=1)  # after a consonant, after a vowel
    at = {c: i for i, c in enumerate(alphabet)}
    lower, upper = (np.array([at.get(f(c), -1) for c in letters]) for f in (str.lower, str.upper))
    number = np.array([at[c] for c in "0123456789" if c in at])
    signs = np.array([at[c] for c in alphabet if not c.isalnum() and c != "+"])
    # Of a token: its way of capitals (none, first letters, all), how often a number follows a word, and its sign.
    way = rng.integers(3, size=rows) if lower[0] >= 0 and upper[0] >= 0 else np.full(rows, 0 if lower[0] >= 0 else 2)
    numbers = rng.integers(len(NUMBERS), size=rows) if len(number) else np.zeros(rows, np.int64)
    often = np.array(NUMBERS)[numbers] if len(number) else np.zeros(rows)
    sign = rng.choice(signs, rows) if len(signs) else np.full(rows, -1)
    left, digits, new = rng.integers(2, 6 if hexadecimal else 11, rows), np.zeros(rows, np.int64), np.ones(rows, bool)
    last = rng.random(rows) < 0.5
    out = np.zeros((rows, SIMULATED_LENGTH), np.int64)
    for i in range(SIMULATED_LENGTH):
        start = (left == 0) & (digits == 0)
        left = np.where(start, rng.integers(2, 6 if hexadecimal else 11, rows), left)
        joins, counts = start & (sign >= 0), digits > 0
        new |= start
        pick = np.minimum((rng.random(rows)[:, None] > after[last.astype(int)]).sum(axis=1), len(letters) - 1)
        cased = np.where((way == 2) | ((way == 1) & new), upper[pick], lower[pick])
        out[:, i] = np.where(joins, sign, cased)
        if len(number):
            out[:, i] = np.where(counts, rng.choice(number, rows), out[:, i])
        letter = ~joins & ~counts
        left, last, new = left - letter, np.where(letter, vowel[pick], last), new & ~letter
        digits = np.where(letter & (left == 0) & (rng.random(rows) < often), rng.integers(1, 5, rows), np.maximum(digits - 1, 0))
    style = way * len(NUMBERS) + numbers
    if len(number):  # numbers alone, joined by the token's sign
        alone = rng.random(rows) < 0.15
        figures = np.where((rng.random(out.shape) < 0.15) & (sign >= 0)[:, None], sign[:, None], rng.choice(number, out.shape))
        out[alone], style[alone] = figures[alone], 3 * len(NUMBERS)
    return out.astype(np.int8), style


@cache
def kinds(name: str) -> np.ndarray:
    """Which of small letter, capital, digit and sign each character of an alphabet is."""
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in ALPHABETS[name]])


class Writing:
    """What is counted in an alphabet's written tokens.

    share, first, second, onward: of each way of writing, as logarithms, its share, the first character, the second after
    each, and the next after each that follows each kind. odds: how much more often two characters are neighbours in
    written tokens than in uniform ones, as logarithms; mean and variance over uniform pairs, and shared, the covariance
    of two pairs that share a character.
    """

    def __init__(self, name: str):
        k, (x, style), kind = len(ALPHABETS[name]), written(name), kinds(name)
        share, first, second, onward = [], [], [], []

        def counted(context: np.ndarray, after: np.ndarray, contexts: int) -> np.ndarray:
            return np.bincount((context.astype(np.int64) * k + after).ravel(), minlength=contexts * k).reshape(contexts, k)

        def follows(counts: np.ndarray, backed: np.ndarray) -> np.ndarray:
            return (counts + 20 * backed) / (counts.sum(axis=1, keepdims=True) + 20)

        every = np.zeros((k, k))
        for way in np.unique(style):
            own = x[style == way]
            once = np.bincount(own.ravel(), minlength=k) / own.size
            beside = counted(own[:, :-1], own[:, 1:], k)
            every += beside
            pairs = follows(beside, once)
            triples = follows(counted(kind[own[:, :-2]] * k + own[:, 1:-1], own[:, 2:], 4 * k), np.tile(pairs, (4, 1)))
            share.append(len(own) / len(x))
            for out, p in ((first, once), (second, pairs), (onward, triples)):
                out.append((1 - ANYTHING) * p + ANYTHING / k)
        self.share, self.first, self.second, self.onward = np.log(share), np.log(first), np.log(second), np.log(onward)
        self.odds = np.log((every + 2) / (every + 2).sum() * k * k)
        self.mean, self.variance = float(self.odds.mean()), float(self.odds.var())
        self.shared = float(((self.odds.mean(axis=0) - self.mean) * (self.odds.mean(axis=1) - self.mean)).mean())


@cache
def writing(name: str) -> Writing:
    """Worked out once a worker; the simulated tokens are not kept."""
    return Writing(name)


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniform_p(x: np.ndarray, name: str) -> float:
    """The least p-value of the three tests that places x are uniform in an alphabet, times three.

    Too many equal pairs (of m characters: mean m(m - 1) / 2k), runs of the alphabet's halves too few or too many (mean
    (m - 1) / 2), neighbours as in written tokens. All alphabets have an even number of characters, so halves are equal.
    """
    k, m = len(ALPHABETS[name]), len(x)
    counts = np.bincount(x, minlength=k).astype(float)
    pairs, all_pairs = float((counts * (counts - 1)).sum() / 2), m * (m - 1) / 2
    up = x >= k // 2
    runs = float(np.count_nonzero(up[1:] != up[:-1]))
    w = writing(name)
    follows = float(w.odds[x[:-1], x[1:]].sum())
    spread = math.sqrt((m - 1) * w.variance + 2 * (m - 2) * w.shared)
    return min(1.0, 3 * min(
        upper_tail((pairs - all_pairs / k) / math.sqrt(all_pairs / k * (1 - 1 / k))),
        2 * upper_tail(abs(runs - (m - 1) / 2) / math.sqrt((m - 1) / 4)),
        upper_tail((follows - (m - 1) * w.mean) / spread),
    ))


def written_p(x: np.ndarray, name: str) -> float:
    """log10 of the bound of how probable it is that a written token looks as random as places x."""
    w = writing(name)
    context = kinds(name)[x[:-2]] * len(ALPHABETS[name]) + x[1:-1]
    each = w.share + w.first[:, x[0]] + w.second[:, x[0], x[1]]
    for i in range(0, len(context), 100_000):
        each = each + w.onward[:, context[i : i + 100_000], x[2 + i : 100_002 + i]].sum(axis=1)
    most = each.max()
    likely = most + math.log(np.exp(each - most).sum())
    return min(0.0, (likely + len(x) * math.log(len(ALPHABETS[name]))) / math.log(10))


def encoding(token: str) -> str | None:
    seen = set(token.rstrip("="))
    return next((n for n, p in PLACES.items() if seen <= p.keys()), None)


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, p that it is uniform, p that what is written looks so random), or None if no alphabet holds it."""
    body, name = token.rstrip("="), encoding(token)
    if name is None or len(body) < 3:
        return None
    if name in UNTESTED:
        return name, 0.0, 1.0
    place = PLACES[name]
    x = np.fromiter((place[c] for c in body), np.int64, len(body))
    return name, uniform_p(x, name), 10 ** max(written_p(x, name), -300)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _tested(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> list[dict]:
    """The candidate text[start:end] with its tests, which stand for the spans; none if no alphabet holds it."""
    tested = battery(text[start:end])
    if not tested or tested[0] in UNTESTED:
        return []
    size = STRATA[tested[0]] + sum(end - start >= c for c in CLASSES) - 1
    return [{"spans": [{"start": s, "end": e} for s, e in spans], "encoding": tested[0], "class": size, "bin": min(BINS, int(-10 * math.log10(tested[2]))), "uniform": tested[1]}]


def text_spans(text: str) -> tuple[list[tuple[int, int, str]], list[dict]]:
    """The spans of a text that need no test, and its candidates with their tests.

    Of a token that overlaps base spans the parts outside them count: letters and digits that adjoin a hex or access
    key are the rest of it, other parts are tested, short ones by the test of the whole token.
    """
    base, rests, mine = base_spans(text), [], []
    first = 0
    for m in CANDIDATE.finditer(text):
        while first < len(base) and base[first][2] <= m.start() and base[first][0] <= m.start():
            first += 1
        inside = []
        for k in range(first, len(base)):
            if base[k][0] >= m.end():
                break
            if base[k][2] > m.start():
                inside.append(base[k])
        if not inside:
            mine += _tested(text, m.start(), m.end(), [(m.start(), m.end())])
            continue
        parts, at = [], m.start()
        for s, _, e in [*inside, (m.end(), 0, m.end())]:
            if at < s:
                parts.append((at, s))
            at = max(at, e)
        short = []
        for s, e in parts:
            left = any(rank in WITHIN and end == s for _, rank, end in inside)
            right = any(rank in WITHIN and start == e for start, rank, _ in inside)
            # A key that goes on as letters or digits was cut by the base pattern: the rest is of the same key.
            if left and (n := GOES_ON.match(text, s, e).end()) > s:
                rests.append((s, 3, n))
                s = n
            if right and (n := e - GOES_ON.match(text[s:e][::-1]).end()) < e:
                rests.append((n, 3, e))
                e = n
            if e - s >= CLASSES[0]:
                mine += _tested(text, s, e, [(s, e)])
            elif s < e:
                short.append((s, e))
        if short:
            mine += _tested(text, m.start(), m.end(), short)
    return sorted(base + rests), mine


SPANS = "array<struct<start:int,rank:int,end:int>>"
CANDIDATES = "array<struct<spans:array<struct<start:int,end:int>>,encoding:string,class:int,bin:int,uniform:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, candidates) of every whole text; null is empty. Offsets are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
        part = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kind = pa.list_(pa.struct([("spans", part), ("encoding", pa.string()), ("class", pa.int32()), ("bin", pa.int32()), ("uniform", pa.float64())]))
        for b in slices(batches, "text"):
            bases, others = [], []
            for text in b.column("text").fill_null("").to_pylist():
                base, mine = text_spans(text)
                bases.append([{"start": s, "rank": k, "end": e} for s, k, e in base])
                others.append(mine)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bases, base_type), pa.array(others, kind)], ["doc_id", "base", "candidates"])

    return in_tasks(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPANS}, candidates {CANDIDATES}")


def cutoffs(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """For each alphabet and class of length the least bin whose candidates are discoveries; BINS + 1 if none.

    The counts cover the whole corpus and come to the driver as at most len(ALPHABETS) * len(CLASSES) * (BINS + 1) rows.
    """
    rows = scanned.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").count().collect()
    out = []
    for k in range(len(ALPHABETS) * len(CLASSES)):
        mine = {r["bin"]: r["count"] for r in rows if r["class"] == k}
        total, above, least = sum(mine.values()), 0, BINS + 1
        for at in sorted(mine, reverse=True):
            above += mine[at]
            if 10 ** (-at / 10) * total <= rate * above:
                least = at
        out.append(least)
    return out


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, spans) for every row of docs(doc_id, text): an array of (kind, start, end) in code points, by start,
    then kind; kinds are assign, access, hex and random.

    Base spans stay as they are; random ones touch none of them. Texts that are null or empty, and tables without
    candidates, have none of the latter. Repeated rows stay; extra columns are ignored. A candidate has 20 characters
    or more, without an upper bound.
    """
    scanned = stash(scan(docs))
    least = F.array(*[F.lit(x) for x in cutoffs(scanned, rate)])
    found = F.filter("candidates", lambda c: (c["bin"] >= F.get(least, c["class"])) & (c["uniform"] >= REJECT))
    parts = F.flatten(F.transform(found, lambda c: c["spans"]))
    added = F.transform(parts, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
    ordered = F.sort_array(F.concat("base", added))
    return scanned.select("doc_id", F.transform(ordered, lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of find()."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return find(docs).select("doc_id", count("assign"), count("access"), count("hex"), count("random"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(text: str, least: list[int]) -> str:
    base, others = text_spans(text)
    spans = [(s, e) for s, _, e in base] + [(p["start"], p["end"]) for c in others if c["bin"] >= least[c["class"]] and c["uniform"] >= REJECT for p in c["spans"]]
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with every span of find() replaced by [secret], and n_chars, if there, set anew.

    All rows and columns stay, null texts too. Overlapping spans are replaced as one. The cutoffs come from a pass over
    all texts that leaves counts only, the spans from a second, so rows that share a doc_id need no matching.
    """
    least = cutoffs(scan(docs), rate)
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [None if t is None else redacted(t, least) for t in b.column("text").to_pylist()]
            new = {"text": pa.array(texts, b.schema.field("text").type)}
            if "n_chars" in fields:
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, b.column("n_chars").to_pylist())], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for i, c in enumerate(fields)], fields)

    return in_tasks(docs, run, docs.schema)
