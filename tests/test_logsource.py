"""Logs read in ranges of bytes, as batches and as streams."""

import random

import pytest

from waymark.sources import logs, logsource


def written(folder, seed=1):
    r, want = random.Random(seed), []
    folder.mkdir()
    for repo in ("one", "two", "three"):
        data, at = b"", 0
        for i in range(r.randrange(5, 60)):
            line = ("é" * r.randrange(0, 9) + f" line {i} " + "x" * r.choice([0, 3, 200])).encode()
            want.append((repo, at, line.decode()))
            data += line + (b"\r\n" if i % 7 == 3 else b"\n")
            at = len(data)
        (folder / f"{repo}.log").write_bytes(data)
    (folder / "_other").write_text("no log")
    return sorted(want)


@pytest.mark.parametrize("most", [1, 2, 7, 64, 10_000])
@pytest.mark.parametrize("block", [3, 1 << 20])
def test_ranges_of_any_size_read_every_line_once(tmp_path, most, block, monkeypatch):
    monkeypatch.setattr(logsource, "BLOCK", block)
    folder = str(tmp_path / "l")
    want = written(tmp_path / "l", most)
    assert logsource.finished(folder) == logsource.sizes(folder)
    parts = logsource.ranges({}, logsource.sizes(folder), most)
    assert sorted((r["repo"], r["n"], r["line"]) for part in parts for b in logsource.batches(folder, part) for r in b.to_pylist()) == want


def test_a_batch_of_ranges(spark, tmp_path):
    want = written(tmp_path / "l")
    logsource.register(spark)
    got = spark.read.format("logs").option("rangeBytes", 700).load(str(tmp_path / "l"))
    assert got.rdd.getNumPartitions() > 5 and sorted(map(tuple, got.collect())) == want


def test_a_stream_reads_what_a_batch_reads(spark, tmp_path):
    folder = tmp_path / "l"
    want = written(folder)
    logsource.register(spark)
    stream = spark.readStream.format("logs").option("rangeBytes", 900).load(str(folder))
    q = stream.writeStream.format("memory").queryName("logged").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("logged").collect())) == want
        size = (folder / "one.log").stat().st_size
        with open(folder / "one.log", "ab") as f:
            f.write(b"more\nhalf")
        (folder / "four.log").write_bytes(b"new\n")
        q.processAllAvailable()
        want += [("one", size, "more"), ("four", 0, "new")]
        assert sorted(map(tuple, spark.table("logged").collect())) == sorted(want)
        with open(folder / "one.log", "ab") as f:
            f.write(b" done\n")
        q.processAllAvailable()
        want.append(("one", size + 5, "half done"))
        assert sorted(map(tuple, spark.table("logged").collect())) == sorted(want)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.read.format("logs").load(str(folder)).collect())) == sorted(want)


def test_a_history_from_files_and_an_empty_folder(spark, tmp_path):
    folder = tmp_path / "l"
    folder.mkdir()
    logsource.register(spark)
    assert spark.read.format("logs").load(str(folder)).count() == 0
    (folder / "r.log").write_text("\x02aaa\x012024-02-01\x01Remove it\n\napps/x/a\n\x02bbb\x012024-01-01\x01Start\n")
    log = logs.git_log(spark.read.format("logs").option("rangeBytes", 9).load(str(folder)))
    assert [(r.repo, r.sha, r.path) for r in logs.git_deletions(log).collect()] == [("r", "aaa", "apps/x/a")]
    assert log.select("sha").distinct().count() == 2
