"""Payloads, tracked files, free names, contexts and orphans from birth."""

import json


from waymark.operators import health, matching
from waymark.sources import logs, records


def test_payloads(spark):
    lines = [
        {"tool_input": {"file_path": "a.py", "new_string": "x"}, "session_id": "s", "cwd": "/r"},
        {"tool_input": {"file_path": "", "notebook_path": "n.ipynb", "new_source": "y"}},
        {"tool_input": {"file_path": "m.py", "edits": [{"new_string": "one"}, {"old_string": "z"}, 7, {"new_string": "two"}]}},
        {"tool_input": {"file_path": "b.py", "edits": "no list", "content": "c"}},
        {"tool_input": {"command": "ls -l"}, "cwd": "/r"}, {"tool_input": {}}, {"tool_input": 5}, [], 3,
    ]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(90, "{broken"), (91, ""), (92, None)], "ord long, value string")
    got = {r.ord: (r.session, r.folder, r.path, r.command, r.content) for r in logs.payloads(rows).collect()}
    assert got == {
        0: ("s", "/r", "a.py", None, "x"), 1: (None, None, "n.ipynb", None, "y"), 2: (None, None, "m.py", None, "one two"),
        3: (None, None, "b.py", None, "c"), 4: (None, "/r", None, "ls -l", ""),
    }


def test_only_tracked_files_count(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, data in (("src/a.py", b"text"), ("src/b.bin", b"\xff\xfe\x00"), ("src/new.py", b"untracked"), ("src/big", b"x" * (logs.MAX_FILE + 1))):
        (tmp_path / name).write_bytes(data)
    tracked = spark.createDataFrame([("src/a.py",), ("src/b.bin",), ("src/gone.py",), ("src/big",)], "path string")
    got = {r.path: r.content for r in logs.tracked_files(spark, str(tmp_path), tracked).collect()}
    assert got == {"src/a.py": "text", "src/b.bin": None, "src/gone.py": None, "src/big": None}


def test_names_are_free_and_in_order(spark):
    drafts = [(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "a-2"), (6, "c"), (7, "a"), (8, "a-2"), (9, "d-x")]
    taken = spark.createDataFrame([("b",), ("a-4",), ("c-2",), ("d",), ("c",)], "name string")
    got = {r.ord: r.name for r in records.free_names(spark.createDataFrame(drafts, "ord long, stem string"), taken).collect()}
    assert got == {1: "a", 2: "b-2", 3: "a-3", 4: "a-5", 5: "a-2", 6: "c-3", 7: "a-6", 8: "a-2-2", 9: "d-x"}


HEAD = "---\nid: {i}\ntype: fence\ntitle: T{i}\nseverity: high\nconfidence: 0.5\nanchors:\n  - path: {p}\nevidence:\n  - pr: 1\nstatus: candidate\n---\n\nBody {i}. More.\n"


def parsed(spark, rows):
    return records.parse(spark.createDataFrame(rows, "source string, text string"))


def test_promotion_tells_of_records_without_anything_to_point_at(spark):
    candidates = parsed(spark, [(f"c{i}.md", HEAD.format(i=i, p=p)) for i, p in enumerate(("src/", "gone/", "src/a.py"))])
    none = parsed(spark, [("r.md", HEAD.format(i=40, p="src/"))])
    promoted = records.promote(candidates, none, "lee", "2026-01-01")
    files = spark.createDataFrame([("src/a.py", "x")], "path string, content string")
    assert sorted(r.id for r in promoted.collect()) == [41, 42, 43]
    assert [(r.id, r.source) for r in health.born_orphans(promoted, files).collect()] == [(42, "c1.md")]


def test_one_context_for_each_target(spark):
    r = parsed(spark, [(f"r{i}.md", HEAD.format(i=i, p="src/").replace("candidate", "active" if i else "challenged")) for i in range(3)])
    shown = spark.createDataFrame([(1, "a", 0, 2, True, None), (1, "a", 1, 1, False, "path-only match"), (1, "a", 2, 3, True, None), (2, "b", 1, 1, False, "shown in full lately")], "ord long, path string, id long, pos int, full boolean, reason string")
    fields = r.select("id", "type", "status", "severity", "confidence", "title", "body")
    broken = spark.createDataFrame([("z.md",), ("y.md",)], "source string")
    got = {x.ord: x.context.split("\n\n") for x in matching.contexts(shown, fields, broken).collect()}
    assert got[1][0].startswith("3 record(s)") and got[2][0].startswith("1 record(s)")
    assert got[1][1:4] == ["[challenged fence #0 | severity: high | confidence: 0.5] T0\nBody 0. More.", "[fence #2 | severity: high | confidence: 0.5] T2\nBody 2. More.", "[fence #1 | severity: high | confidence: 0.5] T1 - path-only match"]
    assert got[1][4] == got[2][2] == "2 record file(s) cannot be read and never apply: y.md, z.md"
    clean = matching.contexts(shown, fields, broken.limit(0)).where("ord = 2").first().context
    assert clean.count("\n\n") == 1
