import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes
from lodestone.streaming import keyed

SCHEMA = "ts timestamp, file_path string, mtime double, size long, content_hash string"


def stream(spark, tmp_path, name, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"b{k}"))
        for f in (tmp_path / name / f"b{k}").glob("part-*"):
            f.rename(tmp_path / name / f"{k:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*.parquet"))


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.mark.parametrize("cut", [1, 3])
def test_expiries(spark, tmp_path, cut):
    calls = [("a", at(0)), ("a", at(1)), ("b", at(1)), ("a", at(2)), ("c", at(5)), ("a", at(6)), ("b", at(6)), (None, at(6)), ("d", None), ("c", at(9)), ("c", at(9))]
    batches = [calls[k::cut] if cut == 1 else calls[k * 4 : k * 4 + 4] for k in range(cut)]
    s = stream(spark, tmp_path, "calls", "client string, ts timestamp", batches)
    got = keyed.replay(keyed.expiries(s, 120), str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    epoch = int(at(0).timestamp()) * 1_000_000
    rows = sorted((r.client, (r.last_seen - epoch) // 60_000_000) for r in got)
    want = sorted([("a", 2), ("b", 1), ("c", 5), ("a", 6), ("b", 6)])
    assert [(c, m - rows[0][1] + 2) for c, m in rows] == want


def test_changes_equal_the_batch_operator(spark, tmp_path):
    def listing(k):
        rows = []
        for i in range(120):
            if (i + k) % 7 and i % 11 != k:
                mtime = None if (i + k) % 29 == 0 else float(i + (k if i % 3 == 0 else 0))
                rows.append((at(10 * k), f"f{i}", mtime, i + (k if i % 6 == 0 else 0), None if i % 13 == 0 else f"h{i}{k if i % 6 == 0 else ''}"))
        return rows

    listings = [listing(k) for k in range(4)]
    s = stream(spark, tmp_path, "lists", SCHEMA, listings)
    made = keyed.file_changes(s, groups=5)
    got = keyed.replay(made, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    base = min(r["at"] for r in got)
    found = [sorted((r.file_path, r.status) for r in got if (r["at"] - base) // 600_000_000 == k and r.status != "deleted") for k in range(4)]
    gone = sorted(r.file_path for r in got if r.status == "deleted")
    known = spark.createDataFrame([], SCHEMA)
    want_gone = []
    for k, rows in enumerate(listings):
        now = spark.createDataFrame(rows, SCHEMA)
        diff = changes.detect_changes(known, now).collect()
        assert found[k] == sorted((r.file_path, r.status) for r in diff if r.status != "deleted")
        want_gone += [r.file_path for r in diff if r.status == "deleted"]
        dead = {r.file_path for r in diff if r.status == "deleted"}
        stands = {r.file_path for r in diff if r.status == "unchanged"}
        old = {r.file_path: r for r in known.collect()}
        keep = [(*r[:4], old[r[1]].content_hash if r[1] in stands and (old[r[1]].mtime, old[r[1]].size) == (r[2], r[3]) else r[4]) for r in rows if r[1] not in dead]
        known = spark.createDataFrame(keep, SCHEMA)
    assert gone == sorted(want_gone) and len(gone) > 20
    # the stream goes on from its checkpoint
    spark.createDataFrame([(at(50), "f1", 1.0, 1, "h1"), (None, "x", 1.0, 1, "h"), (at(50), None, 1.0, 1, "h")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "more"))
    for f in (tmp_path / "more").glob("part-*"):
        f.rename(tmp_path / "lists" / "900.parquet")
    later = keyed.replay(made, str(tmp_path / "out"), str(tmp_path / "ck")).where(F.col("at") > base + 1_800_000_000)
    assert {r.status for r in later.where("file_path <> 'f1'").collect()} == {"deleted"} and later.count() == known.select("file_path").union(spark.createDataFrame([("f1",)], "file_path string")).distinct().count()


def test_states_of_files():
    assert keyed.file_status(None, None, 1, None) == "added" and keyed.file_status((1.0, 2, "h"), 1.0, 2, "other") == "unchanged"
    assert keyed.file_status((1.0, 2, "h"), 2.0, 2, "h") == "unchanged" and keyed.file_status((1.0, 2, None), 2.0, 2, "h") == "modified"
    assert keyed.file_status((1.0, 2, "h"), 2.0, 2, None) == "unchanged" and keyed.file_status((1.0, 2, "h"), 2.0, 2, None, False) == "modified"
    assert keyed.file_status((1.0, 2, "h"), None, 2, "h") == "deleted"


def test_the_setting_comes_back(spark):
    before = spark.conf.get(keyed._PROVIDER, None)
    with keyed.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(keyed._PROVIDER)
    assert spark.conf.get(keyed._PROVIDER, None) == before
