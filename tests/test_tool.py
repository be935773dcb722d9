import pytest

from lodestone import config
from lodestone.operators import search
from lodestone.plans.tool import search_codebase


def test_settings(tmp_path):
    path = tmp_path / "settings"
    path.write_text("# comment\nchunk_size = 0\nEXCLUDE_TESTS=Yes\nresults=seven\nadditional_ignored=*.x, y\n")
    got = config.load([str(tmp_path / "none"), str(path)], {"LODESTONE_BATCH_SIZE": "8", "OTHER": "1", "LODESTONE_DEBOUNCE_MINUTES": "0"})
    assert (got.chunk_size, got.exclude_tests, got.results, got.additional_ignored, got.batch_size, got.debounce_minutes) == (1, True, 5, ("*.x", "y"), 8, 0)
    config.write_file(str(path), got)
    assert config.load([str(path)], {}) == got


def test_search_codebase(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src/auth.py").write_text("def check_login(user):\n    return user.password\n")
    (root / "src/store.py").write_text("class TokenStore:\n    def put(self, token):\n        self.items.append(token)\n")
    (root / "docs.md").write_text("how tokens are stored and users checked\n")
    settings = config.Settings(store_path=str(tmp_path / "db"), results=2)
    login, store, nothing = search_codebase(spark, str(root), ["where is check_login", "put a token into TokenStore", "?!"], settings=settings)
    assert login.split(" ")[0].endswith("auth.py:1-3") and "check_login()" in login
    assert "store.py" in store.splitlines()[0] and "put() | TokenStore" in store
    assert nothing == "No results."
    (only,) = search_codebase(spark, str(root), "check_login", n=50, settings=settings, file_types=[".md"])
    assert only.count("---") == 1 and "docs.md" in only
    with pytest.raises(ValueError, match="not a folder"):
        search_codebase(spark, str(root / "none"), "x", settings=settings)


def test_rerank_with_model(spark):
    hits = spark.createDataFrame([(1, 1, "a", "f.py", "one", 0.1, "q"), (1, 2, "b", "g.py", "three", 0.2, "q")], "query_id int, rank int, id string, file_path string, content string, distance double, query string")
    longest = lambda: lambda pairs: [float(len(c)) for _, c in pairs]
    assert [r.id for r in search.rerank_with(hits, longest, 2).orderBy("rank").collect()] == ["b", "a"]
    silent = lambda: lambda pairs: []
    got = search.rerank_with(hits, silent, 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].similarity == pytest.approx(0.9)


def test_failing_models(spark):
    hits = spark.createDataFrame([(1, 1, "a", "f.py", "one", 0.1, "q", "u", 7), (1, 2, "b", "g.py", "three", 0.2, "q", "v", 8)], "query_id int, rank int, id string, file_path string, content string, distance double, query string, context string, score int")

    def broken():
        def score(pairs):
            raise RuntimeError("no model")

        return score

    def missing():
        raise OSError("no file")

    for load in (broken, missing):
        got = search.rerank_with(hits, load, 2).orderBy("rank").collect()
        assert [(r.id, r.context, r.score) for r in got] == [("a", "u", 7), ("b", "v", 8)] and got[0].similarity == pytest.approx(0.9)


def test_search_with_a_model(spark, tmp_path):
    class Letters:
        dimension, query_prefix = 26, ""

        def embed_batch(self, texts):
            assert len(texts) <= 2
            return [[float(t.lower().count(chr(97 + i))) + 0.01 for i in range(26)] for t in texts]

    root = tmp_path / "code"
    root.mkdir()
    for name in ("aaaa", "bbbb", "cccc", "dddd", "eeee"):
        (root / f"{name}.py").write_text(f"{name} = '{name * 9}'\n")
    settings = config.Settings(store_path=str(tmp_path / "db"), results=1, batch_size=2)
    (found,) = search_codebase(spark, str(root), "dddd", settings=settings, model=Letters, model_name="letters")
    assert "dddd.py" in found
