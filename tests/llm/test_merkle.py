import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def up(nodes):
    return [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def brute(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows(doc_id, text, lang, source, n_chars)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0], leaf(r, r[1]), leaf(r, changed(r))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tiers = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        tiers[s] = [[x[2] for x in trees[s]]]
        while len(tiers[s][-1]) > 1:
            tiers[s].append(up(tiers[s][-1]))
    upper = [[tiers[s][-1][0] for s in order]]
    while len(upper[-1]) > 1:
        upper.append(up(upper[-1]))
    out = []
    for k, s in enumerate(order):
        for i, (_, doc_id, own, now) in enumerate(trees[s]):
            proof, folded = [], now
            for levels, at in ((tiers[s], i), (upper, k)):
                for tier in levels[:-1]:
                    low = at // 16 * 16
                    run = tier[low : low + 16]
                    proof += run[: at - low] + run[at - low + 1 :]
                    folded = h(*run[: at - low], folded, *run[at - low + 1 :])
                    at //= 16
            out.append((doc_id, own, tiers[s][-1][0], upper[-1][0], h(*proof), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def lowered(row):
    if row[0] is None or row[1] is None or zlib.crc32(str(row[0]).encode()) % 5:
        return row[1]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(n, sources):
    return [(i * 7 % n, f"Text {i} É" if i % 9 else None, "en" if i % 4 else None, None if i % sources == 3 else f"s{i % sources}é"[: 2 + i % 3], i if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("n,sources,levels,top", [(1, 1, 3, 16_384), (40, 50, 3, 16_384), (700, 2, 3, 16_384), (700, 2, 1, 4), (700, 2, 2, 1), (300, 45, 1, 2), (900, 1, 1, 3), (90, 70, 1, 1)])
def test_trees_of_every_shape_equal_brute_force(spark, n, sources, levels, top):
    rows = table(n, sources)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.expr("if(doc_id % 3 = 0, lower(text), text)"), levels, top)
    want = brute(rows, lambda r: r[1].lower() if r[1] and r[0] % 3 == 0 else r[1])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_digests_of_odd_rows(docs, data):
    got = sorted(map(tuple, merkle.digests(docs).collect()), key=str)
    assert got == brute([r[:5] for r in data], lowered)
    assert {r[-1] for r in got} == {True, False}


def test_nothing_of_an_empty_table(empty):
    assert merkle.digests(empty).collect() == []


def test_text_ids_and_a_source_that_holds_most_rows(spark):
    rows = [(f"d{i:04d}", f"T{i}", "en", "one" if i % 50 else "two", i) for i in range(500)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string")).repartition(4), levels=1, top=5).collect()
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2 and all(r.verified for r in got) and len(got) == 500
