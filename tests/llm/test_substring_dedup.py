import hashlib
import re
from collections import defaultdict

import duckdb

from lodestone.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = defaultdict(lambda: float("inf"))
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - 12):
                first[tuple(w[k : k + 13])] = min(first[tuple(w[k : k + 13])], i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(df, **kw).collect()), key=repr)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    true = brute(rows)
    assert sum(r[2] for r in true) > 100
    assert got(docs) == true


def test_many_batches_compact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs, batches=6) == brute([(r.doc_id, r.text) for r in docs.collect()])
    index = sd.FingerprintIndex(spark, fan_out=2)
    parts = [spark.createDataFrame([(k, 10 * k + j) for k in range(j, j + 5)], "fp long, t1 long") for j in range(4)]
    seen = [sorted(r.fp for s in index.add(p) for r in s.collect()) for p in parts]
    assert [level for level, _ in index.runs] == [2]
    assert spark.table(index.runs[0][1]).count() == 8
    assert seen[0] == [] and set(seen[1]) == {1, 2, 3, 4} and set(seen[3]) == {3, 4, 5, 6}


def test_odd_rows(spark):
    p = " ".join(f"w{i}" for i in range(20))
    q = " ".join(f"v{i}" for i in range(13))
    same = "a " * 40
    rows = [(5, p), (1, "x " + p + "\ny"), (5, p), (None, p), (2, None), (3, ""), (4, q), (6, q + " " + p), (7, same), (8, same + "b"), (9, " \t\n"), (10, "v0 " * 12), (-3, q.replace(" ", "\x0b")),
            (11, "naïve 日本 " * 3 + p + " é")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, t1 int, first_id string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sd.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert {r.doc_id: r.text for r in kept.collect()}[1] == "x " + p + "\ny"


def test_query_merges_runs(spark, monkeypatch):
    levels = []
    own = sd.FingerprintIndex.add
    monkeypatch.setattr(sd.FingerprintIndex, "add", lambda index, found: (own(index, found), levels.append([level for level, _ in index.runs]))[0])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert levels == [[0], [1], [1, 0]]


def test_index_is_reopened(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, new = docs.where("doc_id < 140"), docs.where("doc_id >= 140")
    empty = docs.limit(0)
    folder = str(tmp_path / "index")
    sd.remove_repeats_of_batch(old, empty, sd.FingerprintIndex(spark, folder)).count()
    first = sd.FingerprintIndex(spark, folder)
    for _, name in first.runs:
        spark.sql(f"DROP TABLE {name}")  # as in another session, whose catalog does not have it
    index = sd.FingerprintIndex(spark, folder)
    assert index.runs == first.runs and len(index.runs) == 1
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats_of_batch(new, old, index).collect()), key=repr)
    assert found == [r for r in brute(rows) if r[0] >= 140] and any(r[2] for r in found)
    index.drop()


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cur = con.execute(sd.ORACLE)
    assert [c[0] for c in cur.description] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, cur.fetchall()), key=repr) == sorted((tuple(r) for r in sd.op5_substring_dedup(spark, "/root/testdata/sf0.01").collect()), key=repr)


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_whose_polynomials_agree_are_different(spark):
    one = thue_morse(2_048)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest])), (3, " ".join([*rest, one])), (4, " ".join(["x", *rest, one]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert [r[2] for r in brute(rows)] == [0, 0, 0, 13]


def test_a_batch_reads_what_it_shares(spark, tmp_path, monkeypatch):
    read = []
    own = sd._history_rows

    def counted(*tables):
        rows = own(*tables)
        read.append(sorted(r.doc_id for r in rows.select("doc_id").collect()))
        return rows

    monkeypatch.setattr(sd, "_history_rows", counted)
    text = lambda k: " ".join(f"w{k}_{i}" for i in range(40))
    old = [(i, text(i)) for i in range(60)] + [(60, text(7)), (61, None), (62, text(8) + " and more")]
    new = [(100, "x " + text(3)), (101, text(3)), (102, text(1_000)), (103, None), (104, text(5)[:-4] + " y " + text(9))]
    later = [(200, "z " + text(1_000)), (201, text(2_000)), (202, text(9) + " q")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "index")
    sd.remove_repeats_of_batch(frame(old), frame([]), sd.FingerprintIndex(spark, folder)).count()
    for before, batch in ((old, new), (old + new, later)):
        rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats_of_batch(frame(batch), frame(before), sd.FingerprintIndex(spark, folder)).collect()), key=repr)
        assert rows == [r for r in brute(before + batch) if r[0] in {i for i, _ in batch}]
    assert read == [[], [3, 5, 9], [9, 102, 104]]
    sd.FingerprintIndex(spark, folder).drop()
