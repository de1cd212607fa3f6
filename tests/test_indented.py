"""Definitions of sources with errors, against the tree of the same sources without."""

import ast
import glob
import os
import random

import pytest

from waymark.sources import indented, logs

GOOD = '''import os


@decorated
class Outer(Base):
    """Text with def no(): pass
    def neither(): pass
    """

    value = {"a": 1,
  "b": [2,
3]}

    async def first(self, x,
                    y="def not_me():"):
        def inner():
            return x \\
    + 1
        # a comment at the margin
        return inner()

    class Nested:
        def deep(self): return "#" + \'\'\'
def quoted(): pass
\'\'\'


def last(): pass
if True:
\tdef tabbed():
\t\tpass
'''


def whole(text):
    return list(indented.parsed(ast.parse(text)))


def test_a_sound_source_reads_the_same_both_ways():
    names = [d[0] for d in whole(GOOD)]
    assert names == ["Outer", "Outer.first", "Outer.first.inner", "Outer.Nested", "Outer.Nested.deep", "last", "tabbed"]
    assert list(indented.recovered(GOOD)) == whole(GOOD) == indented.definitions(GOOD)


def test_sources_of_the_standard_library_read_the_same_both_ways():
    files = sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py")))
    checked = 0
    for f in random.Random(1).sample(files, 40):
        with open(f, encoding="utf-8") as x:
            text = x.read()
        want = {(n, a, b): tuple(s) for n, a, b, s in whole(text)}
        got = {(n, a, b): tuple(s) for n, a, b, s in indented.recovered(text)}
        assert got == want, f
        checked += len(want)
    assert checked > 500


ERRORS = ["x = = 1", "call(1, 2", "if x", "}", "print 'old'", "return)"]


@pytest.mark.parametrize("error", ERRORS)
def test_an_error_costs_no_definition(error):
    text = f"def before(a):\n    return a\n\n\ndef broken(b):\n    y = 2\n    {error}\n\n\nclass After:\n    def method(self, c):\n        return c\n"
    with pytest.raises(SyntaxError):
        ast.parse(text)
    found = {d[0]: d for d in indented.definitions(text)}
    assert list(found) == ["before", "broken", "After", "After.method"]
    sound = {d[0]: d for d in whole(text.replace(error, "pass"))}
    assert all(found[n] == sound[n] for n in ("before", "After", "After.method"))
    assert found["broken"][1] == 5 and found["broken"][3]


@pytest.mark.parametrize("text", ["", "\n\n", "def", "def f(", "class :", "    def f():", "\tdef f():\n x", "'''", '"""\ndef f(): pass', "(" * 50, "\\", "\x00", "def f():\n" * 30, "é = 'ü'\ndef ä(: pass"])
def test_odd_sources_raise_nothing(text):
    indented.definitions(text)


def test_broken_files_in_a_table(spark):
    rows = [("a.py", "def f(:\n    pass\n\ndef g(x):\n    return x\n"), ("b.py", "def h():\n    pass\n"), ("c.js", "function k() { return 1 }"), ("d.py", None), ("e.txt", "def no(): pass")]
    got = sorted((r.path, r.name) for r in logs.definitions(spark.createDataFrame(rows, "path string, content string")).collect())
    assert got == [("a.py", "f"), ("a.py", "g"), ("b.py", "h"), ("c.js", "k")]
