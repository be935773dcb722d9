import itertools
import re

import duckdb
import regex

from lodestone.llm import decontaminate as dc

WORD = regex.compile(r"[\p{L}\p{N}]+")


def brute(docs, items):
    """Ids of documents and the items of which a window matches, by comparing every diagonal."""
    import numpy as np

    number, out = {}, []
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in WORD.findall((t or "").lower())], np.int64)
    things = [(i, coded(t)) for i, t in items]
    for i, t in docs:
        d, found = coded(t), set()
        for item, g in things:
            size = min(13, len(g))
            if not size or len(d) < size:
                continue
            allowed = 2 if len(g) >= 13 else len(g) // 5
            for shift in range(-len(g) + size, len(d) - size + 1):
                low, high = max(0, -shift), min(len(g), len(d) - shift)
                same = np.concatenate(([0], np.cumsum(g[low:high] == d[low + shift : high + shift])))
                if high - low >= size and (same[size:] - same[:-size]).max() >= size - allowed:
                    found.add(item)
                    break
        out.append((i, sorted(found)))
    return out


def test_masks_miss_nothing():
    places = [{s + k for k in m} for m in dc.MASKS for s in range(dc.WINDOW - m[-1])]
    for n in range(dc.SUBSTITUTIONS + 1):
        for gone in itertools.combinations(range(dc.WINDOW), n):
            assert any(not p & set(gone) for p in places)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = dc.op8_decontaminate(spark, sf)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in df.collect()}
    true = brute(docs, items)
    assert any(x for _, x in true)
    assert got == {i: (bool(x), x) for i, x in true}


def rows(spark):
    p = [f"word{i}" for i in range(20)]
    sub = lambda *k: " ".join("zz" if i in k else w for i, w in enumerate(p))
    docs = [(1, "before " + " ".join(p).upper() + "! after"), (2, "a, b, " + sub(4, 9, 14)), (3, sub(1, 3, 5, 7, 9, 11, 13, 15, 17, 19)), (None, " ".join(p[:13])), (5, None), (6, ""), (7, " ".join(p[:12])),
            (1, "clean"), (8, "one two three four five six seven eight nine ten"), (9, "one two three four XX six seven eight nine yy zz")]
    items = [(10, " ".join(p)), (11, "one two three four five six seven eight nine ten"), (12, "too short"), (13, None), (10, " ".join(p))]
    return docs, items


def test_odd_rows(spark):
    docs, items = rows(spark)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = dc.contamination(d, b).collect()
    assert len(got) == len(docs)
    by_id = {i: x for i, x in brute(docs, items)}
    by_id[1] = [10]
    assert {r.doc_id: list(r.item_ids) for r in got} == by_id
    assert by_id[2] == [10] and by_id[3] == [] and by_id[None] == [10] and by_id[8] == [11] and by_id[7] == []
    assert {r.doc_id for r in dc.without_contaminated(d, b).collect()} == {i for i, x in by_id.items() if not x}
    assert dc.contamination(d.limit(0), b).count() == 0
    assert {r.contaminated for r in dc.contamination(d, b.limit(0)).collect()} == {False}


def test_large_benchmark_is_shuffled(spark, monkeypatch):
    docs, items = rows(spark)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    some = sorted(map(tuple, dc.overlaps(d, b).collect()), key=repr)
    monkeypatch.setattr(dc, "BROADCAST_HASHES", 0)
    assert sorted(map(tuple, dc.overlaps(d, b).collect()), key=repr) == some


def test_short_items(spark):
    items, docs, true = [], [], {}
    for n in range(1, 16):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        allowed = 2 if n >= 13 else n // 5
        for m in range(min(n, allowed + 1) + 1):
            for gone in itertools.combinations(range(n), m):
                some = ["zz" if k in gone else w for k, w in enumerate(words)]
                # as long as the item, and with words around it
                for t in (some, ["a", *some, "b", "c"]):
                    # two windows of 13 words in longer items
                    ok = m <= allowed or any(sum(s <= k < s + 13 for k in gone) <= 2 for s in range(n - 12))
                    true[len(docs)] = [n] if ok else []
                    docs.append((len(docs), " ".join(t)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: list(r.item_ids) for r in dc.contamination(d, b).collect()} == true


def test_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    cur = con.execute(dc.ORACLE)
    assert [c[0] for c in cur.description] == ["doc_id", "contaminated", "n_items", "item_ids"]
    true = sorted((i, c, n, list(x)) for i, c, n, x in cur.fetchall())
    assert true == sorted((r.doc_id, r.contaminated, r.n_items, list(r.item_ids)) for r in dc.op8_decontaminate(spark, "/root/testdata/sf0.01").collect())
    assert any(r[1] for r in true)
