from hypothesis import given
from hypothesis import strategies as st

from lodestone.operators import chunking

PYTHON = '''"""Doc."""
import os
from x import y


def alone(a):
    return a


@decorated
class Holder:
    limit = 3

    def method(self):
        return "é" * self.limit

    async def other(self):
        return {}
'''
GO = "package main\n\nimport \"fmt\"\n\ntype Shape struct {\n\tname string\n}\n\nfunc (s Shape) Area(x int) int {\n\tif x > 1 {\n\t\treturn 2 // }\n\t}\n\treturn 1\n}\n"
JS = "import x from 'y';\n\nclass Foo extends Bar {\n  run(a) {\n    return `}`;\n  }\n}\n\nconst add = (a, b) => {\n  return a + b;\n};\n\nfunction last() { }\n"


@given(st.text(st.sampled_from("ab\n "), max_size=300), st.integers(-1, 40))
def test_lines_tile(text, size):
    cuts = chunking.line_cuts(text, size)
    assert "".join(text[s:e] for s, e in cuts) == text
    assert all(e - s <= max(1, size) for s, e in cuts)


def test_lines_end_at_newlines():
    text = "".join(f"line{i}\n" for i in range(100))
    cuts = chunking.line_cuts(text, 50)
    assert all(text[e - 1] == "\n" for _, e in cuts) and chunking.line_cuts("", 50) == []


def test_python_symbols():
    found = {(n, k): PYTHON[s:e] for s, _, e, n, k in chunking.definitions(PYTHON, "python")}
    assert set(found) == {("alone", "function"), ("Holder", "class"), ("method", "function"), ("other", "function")}
    assert found["Holder", "class"].startswith("@decorated\nclass Holder")
    for size in (40, 90, 1024):
        rows = chunking.chunk_file(PYTHON, "/src/a.py", size)
        assert "".join(r["content"] for r in rows) == PYTHON and max(len(r["content"]) for r in rows) <= size
        assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows[0]["prev_id"] == rows[-1]["next_id"] == -1
        assert rows[0]["start_line"] == 1 and all(a["end_line"] == b["start_line"] for a, b in zip(rows, rows[1:], strict=False))
        assert rows[0]["has_file_header"] and not rows[-1]["has_file_header"] or len(rows) == 1
    kinds = {r["symbol_type"] for r in chunking.chunk_file(PYTHON, "a.py", 90)}
    assert {"function", "method"} <= kinds


def test_other_languages():
    assert {(n, k) for *_, n, k in chunking.definitions(GO, "go")} == {("Shape", "class"), ("Area", "function")}
    assert {(n, k) for *_, n, k in chunking.definitions(JS, "javascript")} == {("Foo", "class"), ("run", "function"), ("add", "function"), ("last", "function")}
    for text, path in ((GO, "a.go"), (JS, "b.js"), ("def broken(:\n  pass\n" * 9, "c.py"), ("text only " * 50, "d.txt")):
        rows = chunking.chunk_file(text, path, 60)
        assert "".join(r["content"] for r in rows) == text and all(0 < len(r["content"]) <= 60 for r in rows)
    assert chunking.chunk_file("", "a.py") == []


def test_repeated_text_keeps_its_place(spark):
    df = spark.createDataFrame([("a.txt", "same\n" * 40), ("b.txt", ""), ("c.txt", None)], "file_path string, content string")
    rows = chunking.chunk_lines(df, 20).orderBy("chunk_index").collect()
    assert [r.start_char for r in rows] == list(range(0, 200, 20)) and {r.file_path for r in rows} == {"a.txt"}


def test_overlapping_pairs_once(spark):
    a = spark.createDataFrame([("f", 0, 2500), ("f", 2500, 2600), ("g", 0, 10)], "k string, start int, end int")
    b = spark.createDataFrame([("f", 100, 2501), ("f", 2600, 2700), ("g", 10, 20), ("f", 0, 1)], "k string, other_start int, other_end int")
    got = sorted((r.start, r.other_start) for r in chunking.overlapping(a, b, "k", 1000).collect())
    assert got == [(0, 0), (0, 100), (2500, 100)]


def test_continuations_carry_the_signature():
    body = "".join(f"    x{i} = compute({i}, 'some text that takes room')\n" for i in range(60))
    text = f"import os\n\n\n@cached\ndef long(a, b):\n    \"\"\"What it does.\"\"\"\n{body}    return a\n\n\ndef short():\n    return 1\n"
    rows = chunking.chunk_file(text, "a.py", 600)
    assert "".join(text[r["start_char"] : r["end_char"]] for r in rows) == text
    later = [r for r in rows if r["is_continuation"]]
    assert len(later) > 3 and all(r["has_signature_context"] and r["content"].startswith('# [continued from above]\n@cached\ndef long(a, b):\n    """What it does."""\n') for r in later)
    assert all(r["content"].endswith(text[r["start_char"] : r["end_char"]]) and len(r["content"]) <= 600 + 40 for r in rows)
    java = "class Big {\n  int sum(int n) {\n" + "    n += 1; // }\n" * 80 + "    return n;\n  }\n}\n"
    rows = chunking.chunk_file(java, "Big.java", 400)
    assert "".join(java[r["start_char"] : r["end_char"]] for r in rows) == java
    assert all("int sum(int n) {\n    # ..." in r["content"] for r in rows[2:-1]) and not rows[0]["has_signature_context"]
    # no room for it
    assert not any(r["has_signature_context"] for r in chunking.chunk_file(text, "a.py", 210))


def test_statements_stay_whole():
    text = "".join(f"if a{i}:\n    call(\n        {i},\n    )\nelse:\n    other({i})\n" for i in range(20))
    rows = chunking.chunk_file(text, "a.py", 150)
    assert all(r["content"].startswith("if a") and r["content"].endswith(")\n") for r in rows)
    go = "package main\n\nimport (\n\t\"fmt\"\n\t\"os\"\n)\n\nfunc main() {\n}\n"
    assert chunking.header_end(go) == go.index(")\n") + 2
    assert chunking.header_end("#!/bin/x\nx = 1\nimport os\nimport re\ny = 2\nimport z\n") == len("#!/bin/x\nx = 1\nimport os\nimport re\n")


def test_form_feeds_are_no_lines():
    text = "def a():\n    return 1\n\f\ndef b():\n    return 2\n"
    assert [text[s:e] for s, _, e, *_ in chunking.definitions(text, "python")] == ["def a():\n    return 1\n", "def b():\n    return 2\n"]


def test_clashing_names(spark):
    a = spark.createDataFrame([("f", 0, 10, 7)], "k string, start int, end int, bin int")
    b = spark.createDataFrame([("f", 5, 20, 8)], "k string, other_start int, other_end int, bin_ int")
    assert [(r.bin, r.bin_) for r in chunking.overlapping(a, b, "k").collect()] == [(7, 8)]
