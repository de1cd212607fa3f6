import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def held(chosen, size):
    got = Counter()
    for config, times in chosen:
        assert times > 0 and sum(k * n for k, n in config.items()) <= size
        for k, n in config.items():
            got[k] += n * times
    return got


def fewest(histogram, size):
    """The smallest number of sequences, by trying all."""

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        best = len(left)

        def fill(rest, room, i, out):
            nonlocal best
            closed = True
            for j in range(i, len(rest)):
                if rest[j] <= room and (j == i or rest[j] != rest[j - 1]):
                    closed = False
                    fill(rest[:j] + rest[j + 1 :], room - rest[j], j, out)
            if closed:
                best = min(best, 1 + need(rest))

        fill(left[1:], size - left[0], 0, None)
        return best

    return need(tuple(sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True)))


@pytest.mark.parametrize("seed", range(25))
def test_small_plans_are_near_the_fewest(seed):
    r = random.Random(seed)
    size = r.choice([7, 10, 12])
    histogram = Counter(r.randrange(1, size + 1) for _ in range(r.randrange(1, 10)))
    chosen, bound = packing.plan(dict(histogram), size)
    best = fewest(histogram, size)
    assert held(chosen, size) == histogram
    assert bound <= best + 1e-9 and best <= sum(t for _, t in chosen) <= best + 1


def test_large_plans_hold_all_and_are_near_their_bound():
    r = np.random.default_rng(2)
    for lengths, share in ((r.integers(1, 2049, 20_000), 1.003), (np.minimum(r.geometric(0.002, 30_000), 2048), 1.001), (np.full(9_999, 1024), 1.001), (np.full(700, 1500), 1.001)):
        histogram = Counter(lengths.tolist())
        chosen, bound = packing.plan(dict(histogram))
        assert held(chosen, 2048) == histogram
        assert sum(t for _, t in chosen) <= np.ceil(bound) * share + 1, (bound, sum(t for _, t in chosen))


def test_knapsack_equals_brute_force():
    r = random.Random(4)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 20), 4)))
        prices = np.array([r.random() for _ in lengths])
        best, item, rest = packing.knapsack(lengths, prices, 24)
        worth = [0.0] * 25
        for room in range(1, 25):
            worth[room] = max([worth[room - 1], *(worth[room - k] + p for k, p in zip(lengths.tolist(), prices.tolist()) if k <= room)])
        assert np.allclose(best, worth)
        room, total = 24, 0.0
        while item[room] >= 0:
            total, room = total + prices[item[room]], rest[room]
        assert np.isclose(total, worth[24])


ODD = ["", " ", "\n\n  x", "<|endoftext|> and <|endof", "a" * 5000, " " * 300_000 + "x", "漢字 " * 700, "it's 12³ ﬁ \x85\x1c é́", "tab\t\tend  "]


def test_ids_equal_the_library():
    encoder = packing.Encoder.of(open(FILE, encoding="utf-8").read())
    assert encoder.fast
    library = Tokenizer.from_file(FILE)
    r = random.Random(1)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x2FFF), 32, 10, 39])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_another_vocabulary_goes_through_the_library():
    data = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder = packing.Encoder(data)
    assert encoder.fast is None and encoder.encode("Some words").tolist() == Tokenizer.from_str(data).encode("Some words", add_special_tokens=False).ids


def check(rows, got, size):
    library = Tokenizer.from_file(FILE)
    want = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    # No two pieces over half a sequence share one.
    return len(places), max(-(-sum(x.length for x in got) // size), sum(2 * x.length > size for x in got))


def test_pieces_lie_in_gapless_sequences(docs, data):
    got = packing.digests(docs, FILE, 256).collect()
    n, least = check([r[:2] for r in data], got, 256)
    assert n <= least + 2


def test_odd_texts_text_ids_and_whole_sequences(spark):
    rows = [(f"d{i}", t) for i, t in enumerate(ODD)] + [("d3", ODD[3]), (None, None), ("long", "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = packing.digests(df, FILE).collect()
    check(rows, got, 2048)
    pieces = packing.pieces(df, FILE)
    whole = packing.sequences(packing.place(pieces))
    assert whole.where(F.size("ids") > 2048).isEmpty()
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == sum(x.length for x in got) == pieces.agg(F.sum(F.size("ids"))).first()[0]


def test_nothing_of_an_empty_table(empty):
    assert packing.digests(empty, FILE).collect() == []
