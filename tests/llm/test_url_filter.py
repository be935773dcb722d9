import math
import re

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import url_filter as uf

SF = "/root/testdata/sf0.001"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    best = None
    for action, h, p in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return best or (None, None)


def test_equals_sql_and_stays_native(spark):
    df = uf.op9_url_filter(spark, SF)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    true = con.execute(uf.ORACLE).fetchall()
    assert sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == sorted(true, key=repr)


def test_odd_urls_and_reputation(spark):
    urls = ["http://A.Example.COM/en/7?x", "https://a.example.com/en/6", "http://x.net/de/8", "http://b.example.net/de/8/#t", "http://b.example.net/de/7", "org/es/", "http://org/es/1", "http://borg/es/", None, "",
            "x://", "http://ÄB.com/p", "http://h.com", "ftp://u@h.com:80/p?q#f", "http://a/b://c/d", "http://bad.co.uk\n/x"]
    rows = [(i, u, "z") for i, u in enumerate(urls)] + [(100 + i, "http://spam.farm.io/a", "z") for i in range(40)] + [(200 + i, "http://good.io/a", "z") for i in range(40)] + [(0, urls[0], "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(200, None, None), (None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = uf.filter_urls(pages, labels).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host, path = split(u)
        rule, action = rule_of(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict == action if action else by[i].verdict in ("allow", "block")
    assert by[100].verdict == "block" and by[200].verdict == "allow"
    assert {r.verdict for r in uf.filter_urls(pages, labels.limit(0)).collect() if r.rule is None} == {"allow"}
    assert uf.filter_urls(pages.limit(0), labels).count() == 0


def test_shrinkage(spark):
    """A host with one bad page is pulled to its domain, one with many is not."""
    outcomes = spark.createDataFrame([("a.one.com", 1, 1), ("b.one.com", 200, 2), ("c.one.com", 200, 4), ("x.two.com", 100, 95), ("y.two.com", 0, 0)], "host string, n long, bad long")
    got = {r.host: r for r in uf.host_reputation(outcomes).collect()}
    assert got["a.one.com"].mean < 0.6 < got["x.two.com"].mean and got["y.two.com"].mean > got["b.one.com"].mean
    assert all(math.isfinite(r.bound) and r.bound < r.mean for r in got.values())


def test_ports_and_user_names(spark):
    hosts = ["www.example.co.uk:8080", "me:pw@shop.example.com", "example.com:", "localhost", "", "a.b.c.site.github.io"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", uf.domain_of(F.col("h")).alias("d"), uf.suffix_of(F.col("h")).alias("s"), uf.domain_of(F.col("h"), ("github.io",)).alias("g")).collect()
    got = {r.h: (r.d, r.s, r.g) for r in rows}
    assert got["www.example.co.uk:8080"] == ("example.co.uk", "co.uk", "co.uk") and got["me:pw@shop.example.com"] == ("example.com", "com", "example.com")
    assert got["example.com:"][0] == "example.com" and got["localhost"][:2] == ("localhost", "localhost") and got[""][:2] == ("", "") and got["a.b.c.site.github.io"][2] == "site.github.io"


def test_many_hosts_are_shuffled(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://{'hot' if i % 3 else f'h{i}'}.example.com/") for i in range(1_000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 else 1, 0) for i in range(1_000)], "doc_id long, quality int, toxic int")
    true = sorted(map(tuple, uf.filter_urls(pages, labels).collect()), key=repr)
    monkeypatch.setattr(uf, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, uf.filter_urls(pages, labels).collect()), key=repr) == true and {r[4] for r in true} == {"allow", "block"}
