import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import changes, embedding, search
from lodestone.operators.store import ModelMismatch, Store
from lodestone.plans.indexing import CHUNKS, METADATA, Index, collection_of
from lodestone.sources import files, filters
from lodestone.streaming import maintenance


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    write(root, "src/auth.py", "def check_login(user):\n    return user.ok\n")
    write(root, "src/Store.java", "class Store {\n  int size() { return 1; }\n}\n")
    write(root, "src/old.txt", "caf\xe9\r\nline\rend".encode("latin-1"))
    write(root, "Makefile", "all:\n")
    write(root, "src/__init__.py", "")
    write(root, ".github/flow.yml", "on: push\n")
    write(root, "node_modules/x/index.js", "ignored")
    write(root, "out/gen.py", "ignored by gitignore")
    write(root, "a.log", "x")
    write(root, ".py", "no suffix")
    write(root, "pic.png", b"\x89PNG")
    write(root, "tests/test_auth.py", "def test(): pass\n")
    write(root, ".gitignore", "# comment\n\nout/\n")
    return root


def test_discovery(spark, tree):
    found = {r.rel_path: r for r in files.with_content(files.discover_files(spark, str(tree)), str(tree)).withColumn("text", files.decoded(F.col("content"))).collect()}
    assert set(found) == {"src/auth.py", "src/Store.java", "src/old.txt", "Makefile", "tests/test_auth.py", "src/__init__.py", ".github/flow.yml"}
    assert found["src/old.txt"].text == "café\nline\nend" and found["src/auth.py"].size == os.path.getsize(tree / "src/auth.py")
    assert {r.rel_path for r in files.discover_files(spark, str(tree), exclude_tests=True, additional_ignored=("*.java",)).collect()} == {"src/auth.py", "src/old.txt", "Makefile", "src/__init__.py", ".github/flow.yml"}
    assert files.looks_like_codebase(spark, str(tree))


def test_path_filters(spark):
    paths = ["foo.egg-info/a.py", "a/.egg-info/b.py", "x/Specs/y.go", "TestA.java", "lib/a_spec.rb", "X.PY", "a.b/c", "deep/dist/z.js"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", filters.ignored(F.col("p")).alias("i"), filters.is_test_file(F.col("p")).alias("t"), filters.is_source_file(F.col("p")).alias("s")).collect()
    got = {r.p: (r.i, r.t, r.s) for r in rows}
    assert got["foo.egg-info/a.py"] == (False, False, True) and got["a/.egg-info/b.py"][0] and got["deep/dist/z.js"][0]
    assert got["x/Specs/y.go"][1] and got["TestA.java"][1] and got["lib/a_spec.rb"][1] and not got["X.PY"][1]
    assert got["X.PY"][2] and not got["a.b/c"][2]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "id string, file_path string, n int"
    assert store.count("c") == 0 and not store.is_processed("c")
    with pytest.raises(RuntimeError):
        store.table("c")
    store.open("c", schema, dimension=3, model_name="m")
    store.add("c", spark.createDataFrame([("a", "f", 1), ("b", "f", 2)], schema))
    store.add("c", spark.createDataFrame([("b", "f", 3), ("c", "g", 4)], schema))
    store.add("c", spark.createDataFrame([("c", "g", 9), ("d", "g", 5)], schema), update=False)
    assert {r.id: r.n for r in store.table("c").collect()} == {"a": 1, "b": 3, "c": 4, "d": 5}
    assert {r.id for r in store.ids_of_file("c", "g").collect()} == {"c", "d"} and store.ids("c").count() == 4
    store.delete_ids("c", spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert store.count("c") == 3 and store.model_name("c") == "m"
    assert Store(spark, str(tmp_path / "store")).open("c", schema, dimension=3)["model_name"] == "m"
    with pytest.raises(ValueError, match="model m"):
        store.open("c", schema, dimension=4)
    with pytest.raises(ModelMismatch):
        store.open("c", schema, dimension=3, model_name="other")
    store.add("c", spark.createDataFrame([("x", "f", 1), ("x", "f", 2)], schema), order=F.col("n"))
    assert [r.n for r in store.table("c").where("id = 'x'").collect()] == [2]
    store.delete_ids("c", spark.createDataFrame([("x",)], "id string"))
    before = store._read("c")["buckets"]
    store.add("c", spark.createDataFrame([("p:chunk_0", "p", 1), ("p:chunk_1", "p", 2)], schema))
    after = store._read("c")["buckets"]
    assert sum(before.get(b) != v for b, v in after.items()) == 1  # chunks of a file share a bucket, others are not written
    store.change_files("c", spark.createDataFrame([("p",)], "file_path string"), spark.createDataFrame([], schema))
    store.delete_collection("c")
    store.delete_collection("c")
    assert store.count("c") == 0


def test_index_follows_its_tree(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "db"), str(tree))
    first = index.ensure(now=1000.0)
    assert first["status"] == "indexed" and first["chunks"] == index.store.count(CHUNKS) == 6
    assert index.ensure(now=1000.0 + 599)["status"] == "recent"
    row = index.store.table(CHUNKS).where("file_path like '%auth.py' and function_name = 'check_login'").head()
    assert row.symbol_type == "function" and len(row.embedding) == embedding.DIMENSION
    assert index.update(now=2000.0) == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 7}
    (tree / "src/old.txt").unlink()
    write(tree, "src/new.py", "x = 1\n")
    write(tree, "src/auth.py", "def check_login(user):\n    return user.fine\n")
    os.utime(tree / "Makefile", (time.time() + 5, time.time() + 5))
    got = index.ensure(now=1000.0 + 6000)
    assert got == {"status": "updated", "added": 1, "modified": 1, "deleted": 1, "unchanged": 5}
    assert {r.file_path.rsplit("/", 1)[1] for r in index.store.table(METADATA).collect()} == {"auth.py", "Store.java", "Makefile", "test_auth.py", "new.py", "__init__.py", "flow.yml"}
    assert index.store.table(CHUNKS).where("content like '%fine%'").count() == 1 and index.store.table(CHUNKS).where("file_path like '%old.txt'").isEmpty()
    assert len(collection_of(str(tree))) == len("codebase_") + 16


def test_pluggable_embedder(spark):
    class Lengths:
        dimension, query_prefix = 1, "query: "

        def embed_batch(self, texts):
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a", "one\ntwo"), ("b", None)], "id string, content string")
    assert {r.id: r.embedding for r in embedding.embed(df, Lengths).collect()} == {"a": [7.0], "b": None}
    assert {r.id: r.embedding for r in embedding.embed(df, Lengths, query=True).collect()}["a"] == [14.0]


def test_streams(spark, tree, tmp_path):
    calls = []
    maintenance.follow_files(spark, str(tree), str(tmp_path / "ck1"), lambda: calls.append(1)).awaitTermination(60)
    assert calls == [1]
    store = Store(spark, str(tmp_path / "s"))
    schema = "id string, n int"
    store.open("c", schema)
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    maintenance.upsert_stream(stream, store, "c", str(tmp_path / "ck2")).awaitTermination(60)
    assert store.count("c") == 2
    times = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:01:00"), ("x", "2024-01-01 00:10:00"), ("y", "2024-01-01 00:00:30")], "client string, t string").select("client", F.col("t").cast("timestamp").alias("ts"))
    assert sorted((r.client, r.calls) for r in maintenance.active_windows(times).collect()) == [("x", 1), ("x", 2), ("y", 1)]
    assert schemas.CHUNKS.names[0] == "id"


def test_repeated_ids_of_a_batch(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("c", 5), ("c", 4)], "id string, n int")
    assert sorted(map(tuple, changes.upsert(old, new, order=F.col("n")).collect())) == [("a", 3), ("b", 1), ("c", 5)]
    assert sorted(map(tuple, changes.insert_new(old, new, order=-F.col("n")).collect())) == [("a", 1), ("b", 1), ("c", 4)]
    assert changes.upsert(old, new).count() == 3


def test_another_model_is_noticed(spark, tree, tmp_path):
    seen = []
    index = Index(spark, str(tmp_path / "db"), str(tree), progress=lambda step, counts: seen.append((step, counts)))
    index.build(now=1.0)
    assert [s for s, _ in seen] == ["listed", "chunked", "stored"] and seen[0][1] == {"files": 7} and seen[1][1]["chunks"] == 6
    other = lambda rows: embedding.with_hash_embedding(rows, dimension=8)
    for kw in ({"dimension": 8}, {"model_name": "m8"}):
        with pytest.raises(ModelMismatch):
            Index(spark, str(tmp_path / "db"), str(tree), embed=other, **kw)
    stored = []
    again = Index(spark, str(tmp_path / "db"), str(tree), embed=other, model_name="m8", dimension=8, load=lambda name: stored.append(name) or embedding.with_hash_embedding)
    write(tree, "src/more.py", "y = 2\n")
    assert stored == ["hash"] and again.update(now=2.0)["added"] == 1
    assert {len(r.embedding) for r in again.store.table(CHUNKS).collect()} == {embedding.DIMENSION}
    with pytest.raises(Exception, match="holds vectors of 64"):
        again.store.add(CHUNKS, other(again.store.table(CHUNKS).drop("embedding")))
    fresh = Index(spark, str(tmp_path / "db"), str(tree), embed=other, model_name="m8", dimension=8, force=True)
    assert fresh.build(now=3.0) == 7 and fresh.store.model_name(CHUNKS) == "m8"


def test_only_changed_files_are_read(spark, tree, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "db"), str(tree))
    index.build(now=1.0)
    os.utime(tree / "Makefile", (time.time() + 5, time.time() + 5))
    read = []
    own = files.with_content
    monkeypatch.setattr(files, "with_content", lambda found, root: (read.append(sorted(r.rel_path for r in found.collect())), own(found, root))[1])
    assert index.update(now=2.0) == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 7}
    assert read == [["Makefile"]]


def test_order_and_walks(spark, tmp_path, monkeypatch):
    for i in (3, 1, 2):
        write(tmp_path, f"a/b{i}/c/d{i}/x{i}.py", "x = 1\n")
    got = [r.rel_path for r in files.discover_files(spark, str(tmp_path)).collect()]
    assert got == [f"a/b{i}/c/d{i}/x{i}.py" for i in (1, 2, 3)]
    monkeypatch.setattr(files, "DRIVER_LEVELS", 9)
    assert [r.rel_path for r in files.discover_files(spark, str(tmp_path)).collect()] == got
    folder = tmp_path / "plain"
    write(folder, "notes.xyz", "no source")
    index = Index(spark, str(tmp_path / "db"), str(folder))
    assert index.ensure(now=1.0)["status"] == "not_a_codebase" and index.ensure(now=1.0, validate=lambda root: True) == {"status": "indexed", "chunks": 0}


def test_vectors_of_other_lengths(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, float("nan")])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, [2.0]), (10, None)], "query_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.id) for r in search.vector_topk(chunks, asked, 3).collect())
    assert (9, 1, 3) in found and len(found) == 11 and {i for _, _, i in found} == {1, 2, 3}
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(search, "PRODUCT", 1)
    assert sorted((r.query_id, r["rank"], r.id) for r in search.vector_topk(chunks, asked, 3).collect()) == found
