"""Thousands of patterns in one pass, and the fragments that texts are searched for."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from waymark.functions import patterns
from waymark.operators import matching

SCHEMA = "id long, value string"
WORDS = ["alpha", "beta", "gamma", "delta", "Kilo", "SIGMA", "if", "x1", "née", "io_"]


def made(r):
    """A pattern of words, classes, groups, repeats, branches and anchors."""
    parts = []
    for _ in range(r.randrange(1, 4)):
        w = r.choice(WORDS)
        parts.append(r.choice([w, re.escape(w), f"({w})?", f"(?:{w}|{r.choice(WORDS)})", f"{w}+", f"(?:{w}){{2}}", f"[{w}]", rf"\b{w}\b", f"(?={w}){w[0]}", f"{w}.*", f"(?!{w})", "^", rf"\s{w}", f"(?i:{w})"]))
    return "".join(parts)


def text(r):
    return "".join(r.choice([r.choice(WORDS), r.choice(WORDS).upper(), r.choice(WORDS).lower().replace("s", "ſ").replace("k", "K").replace("i", "ı"), " ", "\n", "-"]) for _ in range(r.randrange(12)))


@pytest.mark.parametrize("seed", range(4))
def test_a_match_holds_a_fragment(seed):
    r = random.Random(seed)
    some = 0
    for _ in range(1500):
        p, t = made(r), text(r)
        with warnings.catch_warnings(action="ignore"):
            hit = re.search(p, t, re.IGNORECASE)
        found = patterns.fragments(p)
        some += bool(found)
        assert not hit or not found or any(f in patterns.folded(t) for f in found), (p, t)
    assert some > 500


def test_fragments():
    assert patterns.fragments(r"redis\.get\(") == ["redis.get("]
    assert patterns.fragments("(?:TODO|FIXME): x") == ["fixme", "todo"]
    assert patterns.fragments(r"a.b|c") == patterns.fragments("") == patterns.fragments(None) == patterns.fragments("(") == []
    assert patterns.fragments("sleep(?!ing)x{2,}y") == ["sleep"]


@pytest.mark.parametrize("literals", [(2, 1), (64, 1)])
def test_hits_equal_a_search_of_each(spark, monkeypatch, literals):
    monkeypatch.setattr(matching, "LITERALS", literals[0])
    monkeypatch.setattr(matching, "PASSES", literals[1])
    r = random.Random(7)
    rx = sorted({made(r) for _ in range(40)}) + ["(", "secret", "secret"]
    texts = [text(r) for _ in range(120)] + ["", None, "x" * 65_530 + "secret", "x" * 65_536 + "secret", "a SECRET"]
    rows = spark.createDataFrame(list(enumerate(rx)), SCHEMA)
    targets = spark.createDataFrame(list(enumerate(texts)), "ord long, content string").repartition(3)
    got = {(x.id, x.ord) for x in matching.rows_hit(rows, targets, "content").collect()}
    want = set()
    for i, p in enumerate(rx):
        if patterns.java(p) is not None:
            with warnings.catch_warnings(action="ignore"):
                c = re.compile(p, re.IGNORECASE)
            want |= {(i, n) for n, t in enumerate(texts) if t is not None and c.search(t[:65_536].replace("ı", "i").replace("ſ", "s"))}
    assert got == want


def test_five_thousand_patterns_are_one_scan_without_nested_loops(spark, tmp_path):
    r = random.Random(1)
    names = [f"call_{i:05d}" for i in range(5000)]
    rows = spark.createDataFrame([(i, rf"\b{n}\(") for i, n in enumerate(names)], SCHEMA)
    texts = [" ".join(f"{r.choice(names)}({k})" for k in range(5)) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "ord long, content string").write.parquet(str(tmp_path / "t"))
    targets = spark.read.parquet(str(tmp_path / "t"))
    hits = matching.rows_hit(rows, targets, "content")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(int(m[1]), n) for n, t in enumerate(texts) for m in re.finditer(r"call_(\d+)\(", t)}
    assert {(x.id, x.ord) for x in hits.collect()} == want


def test_more_patterns_than_the_driver_takes_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(matching, "PATTERNS_MOST", 7)
    rows = spark.createDataFrame([(i, f"word{i:03d}") for i in range(40)], SCHEMA)
    targets = spark.range(40).select(F.col("id").alias("ord"), F.concat(F.lit("a WORD"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("content"))
    assert {(x.id, x.ord) for x in matching.rows_hit(rows, targets, "content").collect()} == {(i, i) for i in range(40)}


def test_lines_without_words_are_found_in_one_pass(spark):
    from waymark.operators import reanchor

    lines = ["{ };  //--", "=> [[ ]]", "Σ", "ab {", "long_enough_word here now"]
    texts = ["x { };  //-- y", "=> [[ ]]", "ΑΣ", "Σα", "AB {", "cab {{", "z" * 70_000 + "=> [[ ]]", "a long_enough_word here now"]
    patches = spark.createDataFrame([(i, f"s{i}", f"f{i}", "+", t) for i, t in enumerate(texts)], "seq long, sha string, file string, sign string, text string")
    asked = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {(r.id, r.file) for r in reanchor.pickaxe(patches, asked, patches.selectExpr("file as path")).collect()}
    assert got == {(i, f"f{k}") for i, line in enumerate(lines) for k, t in enumerate(texts) if line in t}
