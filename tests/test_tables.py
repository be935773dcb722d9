import pytest

from lodestone.functions import tables
from lodestone.operators import chunking

FILES = [("a.py", "import os\n\n\ndef one():\n    return 1\n\n\nclass Two:\n    def three(self):\n        return 3\n"), ("b.rs", "fn f(x: &'a str) { g::<'a>() }\n"), ("c.txt", "text\n" * 50), ("d.py", "def broken(:\n"), ("e.go", ""), ("f.go", None), (None, "x\n" * 9)]


@pytest.fixture(scope="module")
def files(spark):
    tables.register(spark)
    df = spark.createDataFrame(FILES, "file_path string, content string")
    df.createOrReplaceTempView("some_files")
    return df


def test_table_functions_equal_operators(spark, files):
    named = files.where("file_path is not null")
    got = spark.sql("SELECT f.file_path, c.* FROM some_files f, LATERAL line_chunks(f.content, 20) c WHERE f.file_path IS NOT NULL")
    want = chunking.chunk_lines(named, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    got = spark.sql("SELECT f.file_path, c.* FROM some_files f, LATERAL syntax_chunks(f.content, f.file_path, 60) c WHERE f.file_path IS NOT NULL")
    want = chunking.chunk_files(named, 60).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    got = spark.sql("SELECT f.file_path, n.* FROM some_files f, LATERAL syntax_nodes(f.content, f.file_path) n")
    want = chunking.syntax_nodes(files)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and got.columns == want.columns
    assert [(r[0], r[1], r[2], r[3], r[4], r[8]) for r in rows] == [("a.py", 0, -1, "function", "one", 0), ("a.py", 1, -1, "class", "Two", 0), ("a.py", 2, 1, "function", "three", 1), ("b.rs", 0, -1, "function", "f", 0)]


def test_usual_sizes_and_nulls(spark, files):
    assert spark.sql("SELECT count(*) FROM some_files f, LATERAL line_chunks(f.content) c WHERE f.file_path = 'c.txt'").head()[0] == 1
    assert spark.sql("SELECT count(*) FROM some_files f, LATERAL line_chunks(f.content, NULL) c WHERE f.content IS NULL OR f.content = ''").head()[0] == 0
    assert spark.sql("SELECT * FROM line_chunks('ab\ncd', 3)").columns[-1] == "content"
    assert [r.content for r in spark.sql("SELECT * FROM line_chunks('ab\ncd', 3) ORDER BY chunk_index").collect()] == ["ab\n", "cd"]


def test_arguments_are_checked_when_planned(spark, files):
    for call in ("line_chunks(1, 2)", "line_chunks('x', 'y')", "syntax_nodes('x', 1)", "syntax_chunks('x', 'y', 1.5)", "line_chunks()"):
        with pytest.raises(Exception, match="must be|missing|argument"):
            spark.sql(f"SELECT * FROM {call}")
