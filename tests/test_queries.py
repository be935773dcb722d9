"""Every registered query of the library against its SQL."""

import math
import os

import duckdb
import pytest

from lodestone.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = db.execute(queries.ORACLE_SQL[name])
    order = [[c[0] for c in cur.description].index(c) for c in columns]
    assert len(order) == len(cur.description)
    true = sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == true


def test_chunk_syntax_tiles(spark):
    files = {}
    for r in queries.chunk_syntax(spark, SF).collect():
        files.setdefault(r.id.rsplit(":", 1)[0], []).append(r)
    assert len(files) > 150
    whole = 0
    for path, rows in files.items():
        rows.sort(key=lambda r: r.start_char)
        assert rows[0].start_char == 0 and all(a.end_char == b.start_char for a, b in zip(rows, rows[1:], strict=False)) and len(rows) == rows[0].total_chunks
        assert all(r.end_char - r.start_char <= 400 for r in rows) and rows[0].has_file_header
        assert all(r.is_continuation for r in rows if r.has_signature_context)
        whole += any(r.has_signature_context for r in rows)
    assert whole > 20 and {r.symbol_type for rows in files.values() for r in rows} <= {"function", None}


def test_plans(spark):
    plan = lambda name: queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("hash_embed") and "SortMergeJoin" not in plan("boost_score")
