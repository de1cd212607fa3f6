import hashlib
import random
import zlib

import numpy as np
import pytest

from waymark.llm import periodic


def brute(words, least=12):
    """All maximal stretches with smallest period q of at least max(least, 2q) words."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q - s), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def sample(r):
    kind = r.randrange(6)
    if kind == 0:
        return [r.randrange(2) for _ in range(r.randrange(120))]
    if kind == 1:
        return [r.randrange(40) for _ in range(r.randrange(300))]
    if kind == 2:
        p = [r.randrange(9) for _ in range(r.randrange(1, 30))]
        return [r.randrange(9) for _ in range(r.randrange(20))] + p * r.randrange(1, 9) + p[: r.randrange(len(p))] + [r.randrange(9) for _ in range(r.randrange(20))]
    if kind == 3:
        return [0] * r.randrange(90) + [1] + [0] * r.randrange(60)
    if kind == 4:
        a, b = [0], [0, 1]
        while len(b) < r.randrange(20, 200):
            a, b = b, b + a
        return b
    return (([1, 2] * r.randrange(1, 8) + [3]) * r.randrange(1, 8) + [4]) * r.randrange(1, 4)


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    docs = [sample(r) for _ in range(40)]
    assert periodic.find([np.array(d, np.int64) for d in docs]) == [brute(d) for d in docs]


def test_lag_counts_are_exact_for_frequent_and_rare_words():
    r = random.Random(5)
    docs = [[r.choice([0] * 30 + list(range(1, 60))) for _ in range(n)] for n in (700, 3, 0, 1500)]
    sizes = np.array([len(d) for d in docs])
    firsts = np.cumsum(sizes) - sizes
    got = periodic.lag_counts(np.array(sum(docs, []), np.int64), np.repeat(firsts, sizes), np.repeat(sizes, sizes))
    for d, low in zip(docs, firsts):
        for q in range(1, len(d) // 2 + 1):
            assert got[low + q] == sum(a == b for a, b in zip(d, d[q:])), q


def test_a_long_text_of_one_word_and_one_with_a_long_period():
    one = np.zeros(200_000, np.int64)
    r = np.random.default_rng(3)
    far = np.tile(r.integers(0, 5000, 60_000), 3)[:150_000]
    assert periodic.find([one, far]) == [[(0, 200_000, 1)], [(0, 150_000, 60_000)]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    return (
        doc_id, len(found), best[0], best[1], best[2], 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    )


def test_digests_of_planted_documents(docs, data, spark):
    more = [(i, " ".join("abcdefgh"[(i * j * j) % 8] for j in range(i % 90)), "en", "s", 0, None) for i in range(1000, 1200)]
    every = data + more + [(5000, "x y x y " * 9 + "\x0bz\x0c" * 12, None, None, None, None)]
    got = periodic.digests(periodic.planted(spark.createDataFrame(every, docs.schema))).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted((expected(x[0], x[1]) for x in every), key=key)
    assert any(r.n_runs for r in got) and all(r.start is None for r in got if not r.n_runs)


def test_nothing_of_an_empty_table(empty):
    assert periodic.digests(periodic.planted(empty)).collect() == []


def test_text_ids_and_collapsed_texts(spark):
    rows = [("a", "u v " * 10 + "w"), ("b", None), (None, "q " * 12), (None, "q " * 12)]
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic.runs(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "u v w"): [(0, 20, 2)], ("b", ""): [], (None, "q"): [(0, 12, 1)]}
