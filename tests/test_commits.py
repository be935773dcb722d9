import threading
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import commits
from lodestone.operators.store import Conflict, Store
from lodestone.plans.indexing import CHUNKS, Index
from lodestone.sources import collection

SCHEMA = "id string, file_path string, n int"


def rows(spark, *some):
    return spark.createDataFrame([(i, i.split(":")[0], n) for i, n in some], SCHEMA)


def held(table):
    return {r.id: r.n for r in table.collect()}


def apart(n_buckets):
    """Two names in different buckets."""
    names = [f"f{k}" for k in range(50)]
    return "f0", next(n for n in names if collection.bucket_of(n, n_buckets) != collection.bucket_of("f0", n_buckets))


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"), keep=3)
    made.open("c", SCHEMA, buckets=4)
    return made


def overtaken(monkeypatch, store, by):
    """The next commit of ``store`` comes after ``by`` has run once."""
    own, todo = Store._put, [by]

    def put(self, name, state):
        if self is store and todo:
            todo.pop()()
        return own(self, name, state)

    monkeypatch.setattr(Store, "_put", put)


def test_two_writers_of_different_buckets(spark, store, monkeypatch):
    one, other = apart(4)
    second, seen = Store(spark, store.root, keep=3), []
    own = Store._rows
    monkeypatch.setattr(Store, "_rows", lambda self, *a: (seen.append(self), own(self, *a))[1])
    overtaken(monkeypatch, store, lambda: second.add("c", rows(spark, (other, 2))))
    store.add("c", rows(spark, (one, 1)))
    assert seen.count(store) == 1  # moved on top, not done again
    assert held(store.table("c")) == {one: 1, other: 2}
    assert store.versions("c") == [2, 1, 0] and held(store.table("c", version=1)) == {other: 2} and held(store.table("c", version=0)) == {}


def test_two_writers_of_one_bucket(spark, store, monkeypatch):
    second = Store(spark, store.root, keep=3)
    overtaken(monkeypatch, store, lambda: second.add("c", rows(spark, ("a", 2), ("a:chunk_1", 3))))
    store.add("c", rows(spark, ("a", 1), ("a:chunk_2", 4)))
    assert held(store.table("c")) == {"a": 1, "a:chunk_1": 3, "a:chunk_2": 4}
    overtaken(monkeypatch, store, lambda: second.add("c", rows(spark, ("a", 9))))
    store.delete_ids("c", spark.createDataFrame([("a:chunk_1",)], "id string"))
    assert held(store.table("c")) == {"a": 9, "a:chunk_2": 4}


def test_a_writer_is_told(spark, store, monkeypatch):
    second = Store(spark, store.root, keep=3)
    store.add("c", rows(spark, ("a", 1)))
    overtaken(monkeypatch, store, lambda: second.add("c", rows(spark, ("b", 2))))
    with pytest.raises(Conflict):
        store.replace("c", rows(spark, ("z", 0)))
    assert held(store.table("c")) == {"a": 1, "b": 2}
    store.retries = 0
    overtaken(monkeypatch, store, lambda: second.add("c", rows(spark, ("a", 7))))
    with pytest.raises(Conflict, match="buckets"):
        store.add("c", rows(spark, ("a", 8)))
    assert held(store.table("c")) == {"a": 7, "b": 2}
    store.replace("c", rows(spark, ("z", 0)))
    assert held(store.table("c")) == {"z": 0}
    with pytest.raises(ValueError, match="not kept"):
        store.table("c", version=0)


def test_many_writers_at_once(spark, store):
    failed = []

    def work(k):
        try:
            own = Store(spark, store.root, retries=30)
            for j in range(3):
                own.add("c", rows(spark, (f"w{k}_{j}", k), (f"shared_{j}", k)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    found = held(store.table("c"))
    assert set(found) == {f"w{k}_{j}" for k in range(4) for j in range(3)} | {f"shared_{j}" for j in range(3)}
    assert store.versions("c")[0] == 12


def test_a_failed_write_leaves_the_old_state(spark, store, tmp_path):
    store.add("c", rows(spark, ("a", 1)))
    before, folders = store._read("c"), sorted(p.name for p in (tmp_path / "store/c").iterdir())
    with pytest.raises(Exception, match="no good"):
        store.add("c", rows(spark, ("b", 2)).withColumn("n", F.raise_error(F.lit("no good")).cast("int")))
    assert store._read("c") == before and sorted(p.name for p in (tmp_path / "store/c").iterdir()) == folders


def test_proposals():
    base = {"version": 3, "schema": "s", "n_buckets": 4, "key": "id", "dimension": None, "model_name": None, "buckets": {"0": "1-a", "1": "2-b"}}
    newest = base | {"version": 4, "buckets": {"0": "1-a", "1": "4-c", "2": "4-c"}}
    assert commits.proposed(base, newest, {"0"}, {"0": "4-d"})["buckets"] == {"0": "4-d", "1": "4-c", "2": "4-c"}
    assert commits.proposed(base, newest, {"0"}, {})["buckets"] == {"1": "4-c", "2": "4-c"}
    assert commits.proposed(base, newest, set(), {"0": "4-d", "3": "4-d"}, added=True)["buckets"] == {"0": ["1-a", "4-d"], "1": "4-c", "2": "4-c", "3": ["4-d"]}
    for touched in ({"1"}, {"2"}, {"0", "2"}):
        with pytest.raises(Conflict):
            commits.proposed(base, newest, touched, {})
    with pytest.raises(Conflict, match="dimension"):
        commits.proposed(base, newest | {"dimension": 3}, {"0"}, {})


def test_hash_is_spark_s(spark):
    keys = ["", "a", "src/é.py", "x:chunk_12", "x" * 100, "日本:chunk_", None, *(uuid.UUID(int=k).hex for k in range(40))]
    state = {"key": "k", "n_buckets": 7}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.b for r in df.select("k", Store(spark, "/")._bucket(state).alias("b")).collect()}
    assert got == {k: collection.bucket_of(k, 7) for k in keys}


def test_source(spark, store, tmp_path):
    collection.register(spark)
    path = str(tmp_path / "store/c")
    store.add("c", rows(spark, *((f"f{k}:chunk_{j}", k) for k in range(30) for j in range(2))))
    table = spark.read.format("lodestone").load(path)
    assert table.schema == store.table("c").schema and held(table) == held(store.table("c"))
    one = table.where("file_path = 'f3'")
    assert held(one) == {"f3:chunk_0": 3, "f3:chunk_1": 3} and one.rdd.getNumPartitions() < table.rdd.getNumPartitions() == 4
    assert one.rdd.getNumPartitions() == 1 and held(table.where("id = 'f3:chunk_1'")) == {"f3:chunk_1": 3}
    assert held(table.where("file_path IN ('f1', 'none') AND n > 0")) == {"f1:chunk_0": 1, "f1:chunk_1": 1}
    rows(spark, ("new", 1), ("f3:chunk_9", 2)).repartition(3).write.format("lodestone").mode("append").save(path)
    assert len(held(store.table("c"))) == 62 and held(table.where("file_path = 'f3'")) == {"f3:chunk_0": 3, "f3:chunk_1": 3, "f3:chunk_9": 2}  # the newest state
    store.add("c", rows(spark, ("new", 5)))
    assert held(store.table("c").where("id = 'new'")) == {"new": 5} and store.count("c") == 62
    rows(spark, ("only", 1)).write.format("lodestone").mode("overwrite").save(path)
    assert held(store.table("c")) == {"only": 1}
    old = spark.read.format("lodestone").option("version", store.versions("c")[1]).load(path)
    assert old.count() == 62


def test_a_failed_job_of_the_source(spark, store, tmp_path):
    collection.register(spark)
    store.open("v", "id string, embedding array<float>", dimension=2, buckets=4)
    path = str(tmp_path / "store/v")
    good = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    good.write.format("lodestone").mode("append").save(path)
    before = sorted(p.name for p in (tmp_path / "store/v").iterdir())
    with pytest.raises(Exception, match="holds vectors of 2"):
        good.unionByName(spark.createDataFrame([("b", [1.0])], "id string, embedding array<float>")).write.format("lodestone").mode("append").save(path)
    with pytest.raises(Exception, match="has struct"):
        rows(spark, ("a", 1)).write.format("lodestone").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "store/v").iterdir()) == before and store.count("v") == 1
    with pytest.raises(Exception, match="no collection"):
        spark.read.format("lodestone").load(str(tmp_path / "nothing"))


def test_an_index_takes_another_store(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1\n")

    class Counted(Store):
        calls = []

        def replace(self, name, table):
            self.calls.append(name)
            super().replace(name, table)

    index = Index(spark, str(tmp_path / "db"), str(root), storage=Counted)
    assert index.build(now=1.0) == 1 and Counted.calls == ["chunks", "files"] and index.store.count(CHUNKS) == 1
