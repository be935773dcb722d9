"""The registered queries over the driver's tables, and the same in SQL.

``documents`` stand for files (path = source/lang/doc_id.txt), ``embeddings`` for stored chunk vectors and,
where the id is divisible by 20, for queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ident
from ..functions import tables
from ..functions import text as tx
from ..functions.vectors import dot
from ..operators import changes, chunking, embedding, graph_index, interaction, postings, render, search
from ..operators.store import Store
from ..sources import collection, files, filters
from ..sources.scratch import materialize, shared_dir
from ..streaming import keyed, maintenance


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c) -> Column:
    return F.round(c, 6) + 0.0  # no negative zero


# -- inputs ----------------------------------------------------------------------------------------------------
def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.col("text").alias("content"))


DOCS = "docs AS (SELECT doc_id, lang, source, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS content FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_neighbours(chunking.chunk_lines(docs(spark, sf_dir)))


_CUT = """CASE WHEN length(content) - {s} <= 1024 THEN length(content)
  WHEN contains(substring(content, {s} + 513, 512), chr(10)) THEN {s} + 1024 - strpos(reverse(substring(content, {s} + 513, 512)), chr(10)) + 1
  ELSE {s} + 1024 END"""
_LINE = "length(substring(content, 1, {0})) - length(replace(substring(content, 1, {0}), chr(10), '')) + 1"
CHUNKS = f"""{DOCS},
cuts AS (
  SELECT file_path, content, 0 AS i, 0::BIGINT AS s, ({_CUT.format(s='0')})::BIGINT AS e FROM docs WHERE length(content) > 0
  UNION ALL
  SELECT file_path, content, i + 1, e, ({_CUT.format(s='e')})::BIGINT FROM cuts WHERE e < length(content)),
chunks AS (
  SELECT file_path, i AS chunk_index, count(*) OVER (PARTITION BY file_path) AS total_chunks, s AS start_char, e AS end_char,
    {_LINE.format('s')} AS start_line, {_LINE.format('e')} AS end_line, substring(content, s + 1, e - s) AS content,
    file_path || ':chunk_' || i AS id, CASE WHEN i > 0 THEN i - 1 ELSE -1 END AS prev_id,
    CASE WHEN e < length(content) THEN i + 1 ELSE -1 END AS next_id
  FROM cuts)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text begins with identifiers of every style."""
    d = docs(spark, sf_dir)
    head = F.concat(F.lit("find read"), F.initcap("source"), F.lit(" in Doc"), F.initcap("lang"), F.lit("Reader by load_"), "source", F.lit("_"), "lang", F.lit(" and MAX_"), F.upper("source"), F.lit(" "))
    return d.withColumn("content", F.concat(head, "content"))


def _init(c: str) -> str:
    return f"upper({c}[1]) || lower({c}[2:])"


CODED = f"""{DOCS},
coded AS (SELECT doc_id, file_path, 'find read' || {_init('source')} || ' in Doc' || {_init('lang')} || 'Reader by load_' || source || '_' || lang || ' and MAX_' || upper(source) || ' ' || content AS content FROM docs)"""


def _words(c: str) -> str:
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


_STYLES = ("[a-z]+(?:[A-Z][a-z0-9]*)+", "[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)+", "[a-z][a-z0-9]*(?:_[a-z0-9]+)+", "[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_STOP = ", ".join(f"'{w}'" for w in ident.STOP_WORDS)


def _idents(c: str) -> str:
    return f"list_distinct(list_filter({_words(c)}, lambda w: regexp_full_match(w, '{'|'.join(_STYLES)}')))"


def _significant(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


ASKED = ("readSrc1 load_src2_en", "DocFrReader MAX_SRC3 getThing", "the and that for with", "thing of the reader", "eau und para Documents")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "query_id int, query string")


_ASKED = "asked(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED)) + ")"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks: a path, a content and a vector."""
    e = table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, (".py", ".md", ".txt"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), kind).alias("file_path"),
                    F.concat(F.lit("def load_label_"), F.col("label").cast("string"), F.lit("(): return VecItem"), (F.col("vec_id") % 10).cast("string")).alias("content"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).where("id % 20 = 0")
    return v.select(F.col("id").alias("query_id"), F.concat(F.lit("where is load_label_"), (F.col("id") % 10).cast("string"), F.lit(" or VecItem"), (F.col("id") % 7).cast("string")).alias("query"), "embedding")


VECTORS = """vectors AS (
  SELECT vec_id AS id, 'label_' || label || '/' || vec_id || ['.py', '.md', '.txt'][(vec_id % 3 + 1)::INT] AS file_path,
    'def load_label_' || label || '(): return VecItem' || (vec_id % 10) AS content, embedding::DOUBLE[] AS v FROM embeddings),
queries AS (SELECT id AS query_id, 'where is load_label_' || (id % 10) || ' or VecItem' || (id % 7) AS query, v AS q FROM vectors WHERE id % 20 = 0),
scored AS (SELECT query_id, query, q, id, file_path, content, v, 1 - list_cosine_similarity(v, q) AS distance FROM vectors, queries)"""


def _ranked(k: int, source: str = "scored") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM {source} QUALIFY rank <= {k})"


def hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = search.vector_topk(v, vector_queries(spark, sf_dir), k)
    return found.join(v.drop("embedding"), "id")


# -- queries ---------------------------------------------------------------------------------------------------
def vector_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    one = v.orderBy("id").limit(1).select(F.col("id").alias("query_id"), "embedding")
    return search.vector_topk(v, one, 10).select("rank", "id", rounded("distance").alias("distance"))


def vector_topk_batch(spark, sf_dir):
    return search.vector_topk(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "rank", "id", rounded("distance").alias("distance"))


TYPES, PARTS = (".PY", ".md"), ("label_1", "label_2", "/7")


def graph_search(spark, sf_dir):
    """As ``vector_topk_batch``, by a stored graph that a third of the vectors were put into later, and some taken out and in."""
    index, v = graph_index.GraphIndex(spark, shared_dir(spark)), vectors(spark, sf_dir).select("id", "embedding")
    later = F.xxhash64("id") % 3 == 0
    index.build(v.where(~later))
    index.change(v.where(later), delete=v.where(F.xxhash64("id") % 5 == 1).select("id"))
    index.change(v.where(F.xxhash64("id") % 5 == 1))
    return index.search(vector_queries(spark, sf_dir), 10).select("query_id", "rank", "id", rounded("distance").alias("distance"))


def filtered_topk_post(spark, sf_dir):
    found = search.filter_hits(hits(spark, sf_dir, search.fetch_size(5, filtered=True)), TYPES, PARTS)
    return found.select("query_id", "rank", "id", "file_path", rounded("distance").alias("distance"))


def filtered_topk_pre(spark, sf_dir):
    v = search.filter_hits(vectors(spark, sf_dir), TYPES, PARTS)
    return search.vector_topk(v, vector_queries(spark, sf_dir), 5).select("query_id", "rank", "id", rounded("distance").alias("distance"))


def rerank_topk(spark, sf_dir):
    found = hits(spark, sf_dir, search.fetch_size(5, rerank_multiplier=4))
    v = vectors(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    q = vector_queries(spark, sf_dir).select("query_id", F.col("embedding").alias("q"))
    found = found.join(v, "id").join(q, "query_id")
    score = rounded(dot(F.reverse("v"), F.col("q")))  # a second opinion that is not the first one
    return search.rerank(found, score, 5).select("query_id", "rank", "id", "similarity")


def identifier_extract(spark, sf_dir):
    return coded(spark, sf_dir).select("doc_id", F.array_sort(ident.identifiers(F.col("content"))).alias("identifiers"))


def significant_words(spark, sf_dir):
    words = ident.significant_words(F.col("content"))
    return docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("words_md5"))


def _texts(spark, sf_dir) -> DataFrame:
    return coded(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "content")


def _met(spark, sf_dir) -> DataFrame:
    """(doc_id, q, own, lower): every document with each of the stated five queries and those of its words that any of them
    has; the queries are constants, so each text is taken apart once, in one projection without a join."""
    asked_ = asked(spark).select("query_id", ident.identifiers(F.col("query")).alias("names"), ident.significant_words(F.col("query")).alias("words")).collect()
    constants = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    every = [constants(sorted({w for r in asked_ for w in r[c]})) for c in ("names", "words")]
    each = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), constants(r.names).alias("names"), constants(r.words).alias("words")) for r in asked_])
    d = coded(spark, sf_dir).select("doc_id", F.array_intersect(every[0], ident.words_of(F.col("content"))).alias("own"), F.array_intersect(every[1], ident.words_of(F.lower("content"))).alias("lower"))
    return d.select("doc_id", F.explode(each).alias("q"), "own", "lower")


def boost_score(spark, sf_dir):
    own, lower, names, words = F.col("own"), F.col("lower"), F.col("q.names"), F.col("q.words")
    return _met(spark, sf_dir).select("doc_id", "q.query_id", ident.identifier_matches(names, own).cast("long").alias("matches"), ident.has_significant_word(words, lower).alias("has_word"),
                                      ident.boost(names, words, F.lit(""), text_words=own, lower_text_words=lower).alias("boost"))


def exact_match(spark, sf_dir):
    """For each document the stated queries of which it has an identifier."""
    found = F.when(ident.has_exact_match(F.col("q.names"), F.col("own")), F.col("q.query_id"))
    return _met(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(found)).alias("queries"))


def _lists(spark, sf_dir) -> DataFrame:
    path = shared_dir(spark)
    postings.write(postings.build(_texts(spark, sf_dir)), path)
    return spark.read.parquet(path)


def posting_lists(spark, sf_dir):
    """The posting lists of all documents, each as its length and the checksum of its numbers."""
    each = _lists(spark, sf_dir)
    return each.groupBy("lower", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def posting_scores(spark, sf_dir):
    """Every benchmark item's words looked up in written posting lists, and the documents that have any of them scored."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("MAX_WEB load_web_en "), "text").alias("query"))
    found = postings.score_lists(_lists(spark, sf_dir), q)
    # few factors a query, so pairs are counted where they are made
    each = found.groupBy("query_id", "boost").agg(F.count(F.lit(1)).alias("texts"), F.sum("matches").alias("matches"), F.min("text_id").alias("first"))
    return each.groupBy("query_id").agg(F.sum("texts").alias("texts"), F.sum("matches").alias("matches"), F.sum(F.col("boost") * F.col("texts")).alias("boost"), F.max(F.struct("boost", -F.col("first"))).alias("best")).select(
        "query_id", "texts", "matches", rounded("boost").alias("boost"), (-F.col("best.col2")).alias("best_doc"))


def boosted_search(spark, sf_dir):
    found = hits(spark, sf_dir, 20).withColumn("similarity", rounded(1 - F.col("distance")))
    found = found.join(vector_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    return search.boost_hits(found, F.col("query"), 5).select("query_id", "rank", "id", rounded("similarity").alias("similarity"), "boosted")


def boosted_uncut(spark, sf_dir):
    """As ``boosted_search``, where every second query has no identifiers and is not cut."""
    found = hits(spark, sf_dir, 20).withColumn("similarity", rounded(1 - F.col("distance")))
    q = vector_queries(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 40 == 0, F.lit("plain words alone")).otherwise(F.col("query")).alias("query"))
    return search.boost_hits(found.join(q, "query_id"), F.col("query"), 5, strict_limit=False).select("query_id", "rank", "id", rounded("similarity").alias("similarity"), "boosted")


def chunk_lines(spark, sf_dir):
    c = chunking.chunk_lines(docs(spark, sf_dir))
    return c.select("file_path", "chunk_index", "total_chunks", "start_char", "end_char", "start_line", "end_line", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def chunk_adjacency(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "prev_id", "next_id", "total_chunks")


def expand_context(spark, sf_dir):
    c = chunking.expanded(chunks(spark, sf_dir))
    return c.select("id", "expanded_start_line", "expanded_end_line", F.md5(F.encode("expanded_content", "UTF-8")).alias("expanded_md5"))


def expand_hits(spark, sf_dir):
    """The last chunk of every file, with its neighbour, by join instead of windows."""
    c = chunks(spark, sf_dir)
    last = c.where("next_id = -1").select("file_path", "chunk_index", "id")
    found = chunking.expand_hits(last, c)
    return found.select("id", "expanded_start_line", "expanded_end_line", F.md5(F.encode("expanded_content", "UTF-8")).alias("expanded_md5"))


def chunk_syntax(spark, sf_dir):
    """Documents dressed as Python and JavaScript sources, a function for every three lines, in chunks of 400."""
    d = docs(spark, sf_dir)
    line = F.regexp_replace("content", r"[^\p{L}\p{N} \n]", "")
    lines = F.filter(F.split(line, "\n"), lambda x: F.length(F.trim(x)) > 0)
    python, script = F.col("doc_id") % 2 == 0, lambda i, x: F.when(F.col("doc_id") % 2 == 0, F.concat(F.when(i % 3 == 0, F.concat(F.lit("def part_"), i.cast("string"), F.lit("():\n"))).otherwise(F.lit("")), F.lit('    say("'), x, F.lit('")\n'))).otherwise(
        F.concat(F.when(i % 3 == 0, F.concat(F.when(i > 0, "}\n").otherwise(""), F.lit("function part_"), i.cast("string"), F.lit("() {\n"))).otherwise(F.lit("")), F.lit('  say("'), x, F.lit('");\n')))
    body = F.array_join(F.transform(lines, lambda x, i: script(i, x)), "")
    text = F.when(python, F.concat(F.lit("import os\n\n"), body)).otherwise(F.concat(F.lit("import x from 'y';\n"), body, F.when(F.size(lines) > 0, "}\n").otherwise("")))
    path = F.concat(F.regexp_replace("file_path", r"\.txt$", ""), F.when(python, ".py").otherwise(".js"))
    c = chunking.chunk_files(d.select(path.alias("file_path"), text.alias("content")), 400)
    return c.select("id", "total_chunks", "start_char", "end_char", "start_line", "end_line", "function_name", "symbol_type", "has_file_header", "is_continuation", "has_signature_context", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


def _programs(spark, sf_dir) -> DataFrame:
    """Every document as a program: a function for each of its lines, with the line in a comment."""
    line = F.regexp_replace("content", "\r", "")
    lines = F.filter(F.split(line, "\n"), lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))) > 0)
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("    fn f"), i, F.lit("(x: &'a str) { // "), x, F.lit("\n        g::<'a>(\"}\");\n    }\n"))), "")
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file_path"), F.concat(F.lit("impl<'a> Doc<'a> {\n"), F.coalesce(body, F.lit("")), F.lit("}\n")).alias("content"))


def syntax_nodes(spark, sf_dir):
    """The tree of definitions of every document's program."""
    return chunking.syntax_nodes(_programs(spark, sf_dir)).select("file_path", "node", "parent", "kind", "name", "start_char", "end_char", "depth")


def chunk_udtf(spark, sf_dir):
    """As ``chunk_lines``, by a table function in SQL."""
    tables.register(spark)
    return spark.sql("""SELECT d.file_path, c.chunk_index, c.total_chunks, c.start_char, c.end_char, c.start_line, c.end_line, md5(encode(c.content, 'UTF-8')) AS content_md5
        FROM {docs} d, LATERAL line_chunks(d.content, 1024) c""", docs=docs(spark, sf_dir))


def syntax_udtf(spark, sf_dir):
    """How many definitions every document's program has at each depth, by a table function in SQL."""
    tables.register(spark)
    return spark.sql("""SELECT p.doc_id, n.depth, n.kind, count(*) AS definitions, min(n.start_char) AS first, max(n.end_char) AS last
        FROM {programs} p, LATERAL syntax_nodes(p.content, p.file_path) n GROUP BY ALL""", programs=_programs(spark, sf_dir))


def file_ids(spark, sf_dir):
    """How many chunk ids each file has, by its path alone, and whether it has any."""
    c = chunks(spark, sf_dir).select("file_path", "id").distinct().groupBy("file_path").agg(F.count("id").alias("n"))
    d = docs(spark, sf_dir).select("file_path").join(c, "file_path", "left")
    return d.select("file_path", F.coalesce("n", F.lit(0)).alias("ids"), F.col("n").isNotNull().alias("processed"))


def get_chunk(spark, sf_dir):
    wanted = docs(spark, sf_dir).select("file_path", (F.col("doc_id") % 3).cast("int").alias("chunk_index"))
    return chunks(spark, sf_dir).join(wanted, ["file_path", "chunk_index"]).select("id", "start_line", "end_line", F.length("content").alias("n_chars"))


def _then_and_now(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir)
    i, digest = F.col("doc_id"), F.sha2("content", 256)
    size, mtime = F.length("content").cast("long"), (F.col("doc_id") * 7).cast("double")
    then = d.where(i % 10 != 0).select("file_path", mtime.alias("mtime"), size.alias("size"), F.when(i % 17 != 0, digest).alias("content_hash"))
    now = d.where(i % 11 != 0).select("file_path", F.when(i % 13 != 0, mtime + F.when(i % 4 == 0, 1).otherwise(0)).alias("mtime"), (size + F.when(i % 8 == 0, 3).otherwise(0)).alias("size"),
                                      F.when(i % 8 == 0, F.sha2(F.concat("content", F.lit("...")), 256)).otherwise(digest).alias("content_hash"))
    return then, now


_STATES = f"""{DOCS},
then_ AS (SELECT file_path, (doc_id * 7)::DOUBLE AS mtime, length(content) AS size, CASE WHEN doc_id % 17 != 0 THEN sha256(content) END AS content_hash FROM docs WHERE doc_id % 10 != 0),
now_ AS (SELECT file_path, CASE WHEN doc_id % 13 != 0 THEN (doc_id * 7)::DOUBLE + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END END AS mtime,
  length(content) + CASE WHEN doc_id % 8 = 0 THEN 3 ELSE 0 END AS size, sha256(CASE WHEN doc_id % 8 = 0 THEN content || '...' ELSE content END) AS content_hash FROM docs WHERE doc_id % 11 != 0),
changes AS (SELECT coalesce(t.file_path, n.file_path) AS file_path,
  CASE WHEN t.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL OR n.mtime IS NULL OR n.size IS NULL THEN 'deleted'
    WHEN t.mtime = n.mtime AND t.size = n.size THEN 'unchanged' WHEN n.content_hash IS NOT NULL AND n.content_hash IS DISTINCT FROM t.content_hash THEN 'modified' ELSE 'unchanged' END AS status
  FROM then_ t FULL JOIN now_ n ON t.file_path = n.file_path)"""


def detect_changes(spark, sf_dir):
    return changes.detect_changes(*_then_and_now(spark, sf_dir))


def stream_changes(spark, sf_dir):
    """As ``detect_changes``, told by a stream of the two listings from what its state store knows."""
    root, told = shared_dir(spark), None
    for k, listing in enumerate(_then_and_now(spark, sf_dir)):
        listing.withColumn("ts", F.timestamp_micros(F.lit((k + 1) * 60_000_000))).write.mode("append").parquet(f"{root}/listings")
        stream = spark.readStream.schema("file_path string, mtime double, size long, content_hash string, ts timestamp").parquet(f"{root}/listings")
        told = keyed.replay(keyed.file_changes(stream), f"{root}/told", f"{root}/checkpoint")
    return told.where("at > 60000000").select("file_path", "status")


def stream_expiry(spark, sf_dir):
    """Each time a user has made no call for longer than five hours, told by a stream that forgets them then."""
    root, at = shared_dir(spark), F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.timestamp_micros(at).alias("ts")).write.parquet(f"{root}/calls")
    calls = spark.readStream.schema(spark.read.parquet(f"{root}/calls").schema).parquet(f"{root}/calls")
    return keyed.replay(keyed.expiries(calls, 5 * 3_600), f"{root}/told", f"{root}/checkpoint")


def change_summary(spark, sf_dir):
    return changes.change_summary(detect_changes(spark, sf_dir))


def delete_by_file(spark, sf_dir):
    return changes.delete_of_files(chunks(spark, sf_dir), detect_changes(spark, sf_dir)).select("id", "start_char", "end_char")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir)
    old = d.where("doc_id % 3 != 0").select(F.col("file_path").alias("id"), F.length("content").cast("long").alias("size"), F.lit("old").alias("state"))
    new = d.where("doc_id % 2 = 0").select(F.col("file_path").alias("id"), (F.length("content") + 1).cast("long").alias("size"), F.lit("new").alias("state"))
    return old, new


_OLD_NEW = f"""{DOCS},
old AS (SELECT file_path AS id, length(content) AS size, 'old' AS state FROM docs WHERE doc_id % 3 != 0),
new AS (SELECT file_path AS id, length(content) + 1 AS size, 'new' AS state FROM docs WHERE doc_id % 2 = 0)"""


def upsert(spark, sf_dir):
    return changes.upsert(*_versions(spark, sf_dir))


def insert_ignore(spark, sf_dir):
    return changes.insert_new(*_versions(spark, sf_dir))


def delete_ids(spark, sf_dir):
    return changes.delete_keys(*_versions(spark, sf_dir))


def store_changes(spark, sf_dir):
    """What a stored collection holds after an insert, an upsert, one that leaves known ids, and a deletion."""
    old, new = _versions(spark, sf_dir)
    store = Store(spark, shared_dir(spark))
    store.open("files", old.schema, model_name="none")
    store.add("files", old)
    store.add("files", new)
    store.add("files", new.withColumn("state", F.lit("late")).unionByName(docs(spark, sf_dir).where("doc_id % 7 = 3").select(F.concat("file_path", F.lit("+")).alias("id"), F.lit(0).cast("long").alias("size"), F.lit("more").alias("state"))), update=False)
    store.delete_ids("files", docs(spark, sf_dir).where("doc_id % 5 = 0").select(F.col("file_path").alias("id")))
    return store.table("files").select("id", "size", "state")


def store_source(spark, sf_dir):
    """What a collection holds that was written over, added to and read again as a data source."""
    collection.register(spark)
    old, new = _versions(spark, sf_dir)
    root = shared_dir(spark)
    Store(spark, root).open("files", old.schema, model_name="none")
    path = f"{root}/files"
    new.write.format("lodestone").mode("append").save(path)
    old.write.format("lodestone").mode("overwrite").save(path)
    new.join(old, "id", "left_anti").write.format("lodestone").mode("append").save(path)
    return spark.read.format("lodestone").load(path)


def decode_content(spark, sf_dir):
    """Texts as bytes, in Latin-1 or with other line ends, decoded, and the hash of the bytes."""
    d, odd = docs(spark, sf_dir), F.col("doc_id") % 2 == 1
    latin = F.encode(F.regexp_replace("content", "[^\\x{00}-\\x{FF}]", "?"), "ISO-8859-1")
    raw = d.select("doc_id", F.when(odd, latin).otherwise(F.encode(F.regexp_replace("content", "\n", "\r\n"), "UTF-8")).alias("content"))
    return files.with_hash(raw).select("doc_id", F.md5(F.encode(files.decoded(F.col("content")), "UTF-8")).alias("text_md5"), F.when(~odd, F.col("content_hash")).alias("content_hash"))


class LetterCounts:
    """Stands for an embedding model: counts of four letters, and the length."""

    dimension, query_prefix = 5, ""

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[*(float(t.count(c)) for c in "aens"), float(len(t))] for t in texts]


def model_embed(spark, sf_dir):
    e = embedding.embed(docs(spark, sf_dir), LetterCounts)
    return e.select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _by_context(pairs: list[tuple[str, str]]) -> list[float]:
    return [float((7 * len(q) + 13 * c.count("1") + len(c)) % 11) for q, c in pairs]


def rerank_model(spark, sf_dir):
    found = hits(spark, sf_dir, 15).join(vector_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    return search.rerank_with(found.drop("v"), lambda: _by_context, 5).select("query_id", "rank", "id", "similarity")


def rerank_words(spark, sf_dir):
    """Rerank by the library's own scorer."""
    q = vector_queries(spark, sf_dir).select("query_id", F.concat("query", F.lit(" labels")).alias("query"))
    found = interaction.with_interaction(hits(spark, sf_dir, 15), interaction.word_weights(vectors(spark, sf_dir), q))
    return search.rerank(found, rounded("score"), 5).select("query_id", "rank", "id", "similarity")


def collection_stats(spark, sf_dir):
    c = chunks(spark, sf_dir).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("id").alias("ids"), F.max("end_line").alias("lines"), F.sum(F.length("content")).alias("n_chars"))
    d = docs(spark, sf_dir).select("file_path").join(c, "file_path", "left")
    return d.select("file_path", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("chunk_count", "ids", "lines", "n_chars")])


def collection_name(spark, sf_dir):
    return docs(spark, sf_dir).select("file_path", tx.collection_name(F.col("file_path")).alias("collection"))


def _page_paths(spark, sf_dir) -> DataFrame:
    p = F.regexp_replace(F.regexp_extract("url", r"^[^:]*://[^/]*/([^?#]*)", 1), r"/$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(p, F.element_at(F.array(*map(F.lit, ("/setup.py", "/tests/a.go", "/build/x.c", "/app.min.js", "/a.spec.ts", "/Makefile", ".png"))), (F.col("page_id") % 7 + 1).cast("int"))).alias("path"))


def ignore_filter(spark, sf_dir):
    path = F.col("path")
    return _page_paths(spark, sf_dir).select("page_id", "path", filters.ignored(path, ("*.html", "fr/", "# comment")).alias("ignored"), filters.is_test_file(path).alias("is_test"), filters.is_source_file(path).alias("is_source"))


def rerank_context(spark, sf_dir):
    d = docs(spark, sf_dir)
    named = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("read_"), "source")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    text = tx.rerank_context(F.col("file_path"), F.when(F.col("doc_id") % 2 == 0, F.initcap("source")), named, F.col("content"))
    return d.select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("context_md5"))


def format_results(spark, sf_dir):
    """All chunks of each file, as if they were its search results in order."""
    c = chunks(spark, sf_dir).withColumns({"query_id": F.col("file_path"), "rank": F.col("chunk_index"), "function_name": F.when(F.col("chunk_index") % 2 == 0, F.lit("load")), "class_name": F.when(F.col("chunk_index") % 3 == 0, F.lit("Doc"))})
    return render.render(c).select("query_id", F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def hash_embed(spark, sf_dir):
    e = embedding.hash_embed(docs(spark, sf_dir), "doc_id", "content")
    return e.select("doc_id", F.transform("embedding", rounded).alias("embedding"))


def _calls(spark, sf_dir) -> tuple[DataFrame, Column]:
    """(client, at) of all events, in microseconds, and the last of them as now."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"))
    return e, F.lit(e.agg(F.max("at")).head()[0])


def debounce(spark, sf_dir):
    return maintenance.debounced(*_calls(spark, sf_dir), 60).select("client", "due")


def client_expiry(spark, sf_dir):
    return maintenance.expired_clients(*_calls(spark, sf_dir), 3600)


def active_windows(spark, sf_dir):
    """Every user's runs of events with less than five hours between two, in microseconds."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts")
    at = lambda c: F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(c))
    w = maintenance.active_windows(e, gap="5 hours")
    return w.select("client", at("start").alias("start"), at("end").alias("end"), "calls")


def interval_overlap(spark, sf_dir):
    """Every chunk with how many of its file's stretches of 300 characters it overlaps, and the first of them."""
    c = chunks(spark, sf_dir).select("file_path", "chunk_index", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    spans = docs(spark, sf_dir).select("file_path", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 300).cast("int"))).alias("ord"), F.length("content").alias("n")).where("n > 0")
    others = spans.select("file_path", "ord", (F.col("ord") * 300).alias("other_start"), F.least(F.col("ord") * 300 + 300, "n").alias("other_end"))
    found = chunking.overlapping(c, others, "file_path")
    return found.groupBy("file_path", "chunk_index").agg(F.count(F.lit(1)).alias("overlaps"), F.min("ord").cast("long").alias("first"))


def conversation_context(spark, sf_dir):
    """Every turn with its neighbours' text and roles."""
    t = table(spark, sf_dir, "conversations")
    c = t.select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"))
    e = chunking.expanded(c)
    return e.select("file_path", "chunk_index", "expanded_start_line", "expanded_end_line", F.md5(F.encode("expanded_content", "UTF-8")).alias("expanded_md5"))


def query_features(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.size(ident.identifiers(F.col("text"))).cast("long").alias("n_identifiers"), (F.size(ident.identifiers(F.col("text"))) > 0).alias("has_identifiers"),
                    F.array_sort(ident.significant_words(F.col("text"))).alias("words"))


def indexed_search(spark, sf_dir):
    """The whole way: chunk all documents and embed the chunks by hash in one pass, written out as an index is; take
    benchmark items as queries, search, lift, expand, and render."""
    c = embedding.with_hash_embedding(chunks(spark, sf_dir)).where("embedding is not null")
    c = materialize(c.withColumns({"function_name": F.lit(None).cast("string"), "class_name": F.lit(None).cast("string")}))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    q = embedding.with_hash_embedding(b, "query").where("embedding is not null")
    found = search.search(c, q, n=search.RESULTS, expand=True)
    return render.or_no_results(render.render(found), b)


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_batch, graph_search, filtered_topk_post, filtered_topk_pre, rerank_topk, identifier_extract, significant_words, boost_score, exact_match, posting_lists, posting_scores, boosted_search, boosted_uncut, chunk_lines,
    chunk_syntax, syntax_nodes, chunk_udtf, syntax_udtf, chunk_adjacency, expand_context, expand_hits, get_chunk, file_ids, detect_changes, stream_changes, stream_expiry, change_summary, delete_by_file, store_changes, store_source, decode_content, model_embed, rerank_model, rerank_words, active_windows, upsert, insert_ignore, delete_ids, collection_stats, collection_name, ignore_filter, rerank_context,
    format_results, hash_embed, debounce, client_expiry, interval_overlap, conversation_context, query_features, indexed_search)}

_DISTANCE = "round(distance, 6) + 0.0 AS distance"
_FILTER = "(ends_with(lower(file_path), '.py') OR ends_with(lower(file_path), '.md')) AND (contains(file_path, 'label_1') OR contains(file_path, 'label_2') OR contains(file_path, '/7'))"
_MATCHES = f"len(list_filter({_idents('query')}, lambda i: list_contains({_words('content')}, i)))"


def _expanded(source: str) -> str:
    w = "OVER (PARTITION BY file_path ORDER BY chunk_index)"
    return f"""SELECT *, concat_ws(chr(10), lag(content) {w}, content, lead(content) {w}) AS expanded_content,
    coalesce(lag(start_line) {w}, start_line) AS expanded_start_line, coalesce(lead(end_line) {w}, end_line) AS expanded_end_line FROM {source}"""


def _glob(patterns) -> str:
    return filters.glob_regex(patterns).replace("'", "''")


_IGNORED = f"^(?:{_glob([*filters.IGNORED, '*.html'])})"

_NODES = """lines AS (SELECT doc_id, list_filter(string_split(replace(content, chr(13), ''), chr(10)), lambda x: length(replace(x, ' ', '')) > 0) AS lines FROM docs),
  functions AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(list_transform(lines, lambda x, i: '    fn f' || (i - 1) || '(x: &''a str) { // ' || x || chr(10) || '        g::<''a>("}");' || chr(10) || '    }' || chr(10))) AS code FROM lines),
  placed AS (SELECT doc_id, i, (19 + sum(length(code)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS stop, length(code)::INT AS n FROM functions),
  nodes AS (SELECT doc_id, 'src/' || doc_id || '.rs' AS file_path, (i + 1)::INT AS node, 0 AS parent, 'function' AS kind, 'f' || i AS name, stop - n + 4 AS start_char, stop - 1 AS end_char, 1 AS depth FROM placed
    UNION ALL SELECT d.doc_id, 'src/' || d.doc_id || '.rs', 0, -1, 'class', 'Doc', 0, coalesce(max(stop), 19) + 1, 0 FROM docs d LEFT JOIN placed p ON p.doc_id = d.doc_id GROUP BY d.doc_id)"""

ORACLE_SQL = {
    "syntax_nodes": f"WITH {DOCS}, {_NODES} SELECT file_path, node, parent, kind, name, start_char, end_char, depth FROM nodes",
    "syntax_udtf": f"WITH {DOCS}, {_NODES} SELECT doc_id, depth, kind, count(*) AS definitions, min(start_char) AS first, max(end_char) AS last FROM nodes GROUP BY ALL",
    "chunk_udtf": f"WITH RECURSIVE {CHUNKS} SELECT file_path, chunk_index, total_chunks, start_char, end_char, start_line, end_line, md5(content) AS content_md5 FROM chunks",
    "vector_topk": f"WITH {VECTORS} SELECT rank, id, {_DISTANCE} FROM {_ranked(10, '(SELECT min(query_id) OVER () AS first, * FROM (SELECT v.id, 1 - list_cosine_similarity(v.v, f.v) AS distance, f.id AS query_id FROM vectors v, (SELECT * FROM vectors ORDER BY id LIMIT 1) f))')}",
    "vector_topk_batch": f"WITH {VECTORS} SELECT query_id, rank, id, {_DISTANCE} FROM {_ranked(10)}",
    "filtered_topk_post": f"WITH {VECTORS} SELECT query_id, rank, id, file_path, {_DISTANCE} FROM {_ranked(50)} WHERE {_FILTER}",
    "filtered_topk_pre": f"WITH {VECTORS} SELECT query_id, rank, id, {_DISTANCE} FROM {_ranked(5, f'(SELECT * FROM scored WHERE {_FILTER})')}",
    "rerank_topk": f"""WITH {VECTORS}, top AS {_ranked(20)}, again AS (SELECT query_id, id, rank AS old, round(list_dot_product(list_reverse(v), q), 6) + 0.0 AS similarity FROM top)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, old) AS rank, id, similarity FROM again QUALIFY rank <= 5""",
    "identifier_extract": f"WITH {CODED} SELECT doc_id, list_sort({_idents('content')}) AS identifiers FROM coded",
    "significant_words": f"WITH {DOCS} SELECT doc_id, len({_significant('content')}) AS n_words, md5(array_to_string(list_sort({_significant('content')}), ' ')) AS words_md5 FROM docs",
    "boost_score": f"""WITH {CODED}, {_ASKED},
      met AS (SELECT doc_id, query_id, {_MATCHES} AS matches, len({_idents('query')}) AS named, len(list_filter({_significant('query')}, lambda i: list_contains({_words('lower(content)')}, i))) > 0 AS has_word FROM coded, asked)
      SELECT doc_id, query_id, matches, has_word, CASE WHEN named > 0 THEN CASE WHEN matches = 0 THEN 1.0 ELSE 3.0 * (1 + (matches - 1) * 0.5) END WHEN has_word THEN 1.2 ELSE 1.0 END::DOUBLE AS boost FROM met""",
    "posting_lists": f"""WITH {CODED}, w AS (SELECT DISTINCT doc_id, false AS lower, unnest({_words('content')}) AS word FROM coded UNION SELECT DISTINCT doc_id, true, unnest({_words('lower(content)')}) FROM coded)
      SELECT lower, word, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM w GROUP BY ALL""",
    "posting_scores": f"""WITH {CODED}, q AS (SELECT item_id AS query_id, 'MAX_WEB load_web_en ' || text AS query FROM benchmark),
      w AS (SELECT DISTINCT doc_id, false AS lower, unnest({_words('content')}) AS word FROM coded UNION SELECT DISTINCT doc_id, true, unnest({_words('lower(content)')}) FROM coded),
      a AS (SELECT DISTINCT query_id, false AS lower, unnest({_idents('query')}) AS word FROM q UNION SELECT DISTINCT query_id, true, unnest({_significant('query')}) FROM q),
      met AS (SELECT query_id, doc_id, count(*) FILTER (NOT lower) AS matches FROM a JOIN w USING (lower, word) GROUP BY ALL),
      s AS (SELECT *, CASE WHEN matches = 0 THEN 1.0 ELSE 3.0 * (1 + (matches - 1) * 0.5) END::DOUBLE AS boost FROM met)
      SELECT query_id, count(*) AS texts, sum(matches)::BIGINT AS matches, round(sum(boost), 6) + 0.0 AS boost, arg_max(doc_id, (boost, -doc_id)) AS best_doc FROM s GROUP BY query_id""",
    "boosted_search": f"""WITH {VECTORS}, top AS {_ranked(20)},
      met AS (SELECT query_id, id, rank AS old, round(1 - distance, 6) + 0.0 AS s, {_MATCHES} AS matches FROM top),
      lifted AS (SELECT query_id, id, old, s * CASE WHEN matches = 0 THEN 1.0 ELSE 3.0 * (1 + (matches - 1) * 0.5) END::DOUBLE AS s, matches > 0 AS boosted FROM met)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, old) AS rank, id, round(s, 6) + 0.0 AS similarity, boosted FROM lifted QUALIFY rank <= 5""",
    "boosted_uncut": f"""WITH {VECTORS}, asked AS (SELECT * REPLACE (CASE WHEN query_id % 40 = 0 THEN 'plain words alone' ELSE query END AS query) FROM {_ranked(20)}),
      met AS (SELECT query_id, id, rank AS old, len({_idents('query')}) AS named, round(1 - distance, 6) + 0.0 AS s, {_MATCHES} AS matches FROM asked),
      lifted AS (SELECT query_id, id, old, named, s * CASE WHEN matches = 0 THEN 1.0 ELSE 3.0 * (1 + (matches - 1) * 0.5) END::DOUBLE AS s, matches > 0 AS boosted FROM met)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN named > 0 THEN s ELSE 0 END DESC, old) AS rank, id, round(s, 6) + 0.0 AS similarity, boosted FROM lifted QUALIFY rank <= 5 OR named = 0""",
    "exact_match": f"""WITH {CODED}, {_ASKED},
      met AS (SELECT doc_id, query_id FROM coded, asked WHERE {_MATCHES} > 0),
      lists AS (SELECT doc_id, list(query_id ORDER BY query_id) AS queries FROM met GROUP BY doc_id)
      SELECT doc_id, coalesce(queries, []) AS queries FROM coded LEFT JOIN lists USING (doc_id)""",
    "file_ids": f"""WITH RECURSIVE {CHUNKS} SELECT d.file_path, count(DISTINCT c.id) AS ids, count(c.id) > 0 AS processed FROM docs d LEFT JOIN chunks c ON d.file_path = c.file_path GROUP BY d.file_path""",
    "indexed_search": f"""WITH RECURSIVE {CHUNKS},
      cw AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM chunks),
      qw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark),
      cb AS (SELECT id, ('0x' || md5(word)[1:8])::UBIGINT % 64 AS b, count(*)::DOUBLE AS n FROM cw GROUP BY ALL),
      qb AS (SELECT item_id, ('0x' || md5(word)[1:8])::UBIGINT % 64 AS b, count(*)::DOUBLE AS n FROM qw GROUP BY ALL),
      cn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM cb GROUP BY id), qn AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM qb GROUP BY item_id),
      dots AS (SELECT item_id AS query_id, cb.id, sum(cb.n * qb.n) AS dot FROM cb JOIN qb ON cb.b = qb.b GROUP BY ALL),
      near AS (SELECT query_id, d.id, round(1 - dot / (cn.norm * qn.norm), 12) AS distance FROM dots d JOIN cn ON cn.id = d.id JOIN qn ON qn.item_id = d.query_id),
      top AS (SELECT n.*, b.text AS query, c.content, c.file_path, c.chunk_index FROM {_ranked(5, 'near')} n JOIN benchmark b ON b.item_id = n.query_id JOIN chunks c ON c.id = n.id),
      met AS (SELECT *, len({_idents('query')}) AS named, {_MATCHES} AS matches FROM top),
      sorted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN named > 0 THEN (1 - distance) * CASE WHEN matches = 0 THEN 1.0 ELSE 3.0 * (1 + (matches - 1) * 0.5) END::DOUBLE ELSE 0 END DESC, rank) AS place FROM met),
      shown AS (SELECT s.query_id, place, s.file_path || ':' || expanded_start_line || '-' || expanded_end_line || chr(10)
        || CASE WHEN length(expanded_content) > 600 THEN substring(expanded_content, 1, 600) || '…' ELSE expanded_content END || chr(10) || '---' AS block
        FROM sorted s JOIN ({_expanded('chunks')}) e ON e.id = s.id),
      texts AS (SELECT query_id, string_agg(block, chr(10) ORDER BY place) AS text FROM shown GROUP BY query_id)
      SELECT b.item_id AS query_id, coalesce(t.text, 'No results.') AS text FROM benchmark b LEFT JOIN texts t ON t.query_id = b.item_id""",
    "chunk_lines": f"WITH RECURSIVE {CHUNKS} SELECT file_path, chunk_index, total_chunks, start_char, end_char, start_line, end_line, md5(content) AS content_md5 FROM chunks",
    "chunk_adjacency": f"WITH RECURSIVE {CHUNKS} SELECT id, prev_id, next_id, total_chunks FROM chunks",
    "expand_context": f"WITH RECURSIVE {CHUNKS} SELECT id, expanded_start_line, expanded_end_line, md5(expanded_content) AS expanded_md5 FROM ({_expanded('chunks')})",
    "expand_hits": f"WITH RECURSIVE {CHUNKS} SELECT id, expanded_start_line, expanded_end_line, md5(expanded_content) AS expanded_md5 FROM ({_expanded('chunks')}) WHERE next_id = -1",
    "get_chunk": f"WITH RECURSIVE {CHUNKS} SELECT c.id, c.start_line, c.end_line, length(c.content) AS n_chars FROM chunks c JOIN docs d ON c.file_path = d.file_path AND c.chunk_index = d.doc_id % 3",
    "detect_changes": f"WITH {_STATES} SELECT file_path, status FROM changes",
    "stream_changes": f"WITH {_STATES} SELECT file_path, status FROM changes",
    "stream_expiry": """WITH e AS (SELECT user_id AS client, epoch_us(ts) AS t FROM events)
      SELECT client, t AS last_seen FROM e QUALIFY coalesce(lead(t) OVER (PARTITION BY client ORDER BY t), max(t) OVER ()) - t > 18000000000""",
    "change_summary": f"WITH {_STATES} SELECT status, count(*) AS files FROM changes GROUP BY status",
    "delete_by_file": f"WITH RECURSIVE {CHUNKS}, {_STATES.replace(DOCS + ',', '')} SELECT id, start_char, end_char FROM chunks WHERE file_path NOT IN (SELECT file_path FROM changes WHERE status IN ('deleted', 'modified'))",
    "store_changes": f"""WITH {_OLD_NEW},
      held AS (SELECT id, size, state FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, size, state FROM new),
      more AS (SELECT * FROM held UNION ALL SELECT file_path || '+', 0, 'more' FROM docs WHERE doc_id % 7 = 3)
      SELECT id, size, state FROM more WHERE id NOT IN (SELECT file_path FROM docs WHERE doc_id % 5 = 0)""",
    "store_source": f"WITH {_OLD_NEW} SELECT id, size, state FROM old UNION ALL SELECT id, size, state FROM new WHERE id NOT IN (SELECT id FROM old)",
    "decode_content": f"""WITH {DOCS} SELECT doc_id, md5(CASE WHEN doc_id % 2 = 1 THEN regexp_replace(content, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') ELSE content END) AS text_md5,
      CASE WHEN doc_id % 2 = 0 THEN sha256(replace(content, chr(10), chr(13) || chr(10))) END AS content_hash FROM docs""",
    "model_embed": f"""WITH {DOCS} SELECT doc_id, [{', '.join(f"(length(content) - length(replace(content, '{c}', '')))::DOUBLE" for c in 'aens')}, length(content)::DOUBLE] AS embedding FROM docs""",
    "rerank_model": f"""WITH {VECTORS}, top AS (SELECT *, 'File: ' || file_path || ' | Code: ' || content AS c FROM {_ranked(15)}),
      again AS (SELECT query_id, id, rank AS old, ((7 * length(query) + 13 * (length(c) - length(replace(c, '1', ''))) + length(c)) % 11)::DOUBLE AS similarity FROM top)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, old) AS rank, id, similarity FROM again QUALIFY rank <= 5""",
    "rerank_words": f"""WITH {VECTORS}, asked AS (SELECT query_id, unnest({_significant("query || ' labels'")}) AS word FROM queries),
      triples AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS t FROM (SELECT word FROM asked UNION SELECT unnest({_words('lower(content)')}) FROM vectors)),
      known AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest({_words('lower(content)')}) AS word FROM vectors) GROUP BY word),
      weights AS (SELECT query_id, a.word, t, ln(1 + (SELECT count(*) FROM vectors) / coalesce(n, 1)) AS weight FROM asked a JOIN triples USING (word) LEFT JOIN known USING (word)),
      top AS {_ranked(15)}, texts AS (SELECT DISTINCT query_id, id, rank AS old, unnest({_words('lower(content)')}) AS word FROM top),
      best AS (SELECT x.query_id, x.id, x.old, w.word, w.weight, max(len(list_intersect(w.t, b.t)) / sqrt(len(w.t) * len(b.t))) AS s FROM texts x JOIN triples b USING (word) JOIN weights w ON w.query_id = x.query_id GROUP BY ALL),
      scored_ AS (SELECT query_id, id, old, round(sum(weight * s) / sum(weight), 6) + 0.0 AS similarity FROM best GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, old) AS rank, id, similarity FROM scored_ QUALIFY rank <= 5""",
    "active_windows": """WITH e AS (SELECT user_id AS client, epoch_us(ts) AS t FROM events),
      marked AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 18000000000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY client ORDER BY t)),
      runs AS (SELECT *, sum(opens) OVER (PARTITION BY client ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM marked)
      SELECT client, min(t) AS start, max(t) + 18000000000 AS "end", count(*) AS calls FROM runs GROUP BY client, run""",
    "upsert": f"WITH {_OLD_NEW} SELECT id, size, state FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, size, state FROM new",
    "insert_ignore": f"WITH {_OLD_NEW} SELECT id, size, state FROM old UNION ALL SELECT id, size, state FROM new WHERE id NOT IN (SELECT id FROM old)",
    "delete_ids": f"WITH {_OLD_NEW} SELECT id, size, state FROM old WHERE id NOT IN (SELECT id FROM new)",
    "collection_stats": f"""WITH RECURSIVE {CHUNKS} SELECT d.file_path, count(c.id) AS chunk_count, count(DISTINCT c.id) AS ids, coalesce(max(c.end_line), 0) AS lines, coalesce(sum(length(c.content)), 0)::BIGINT AS n_chars
      FROM docs d LEFT JOIN chunks c ON d.file_path = c.file_path GROUP BY d.file_path""",
    "collection_name": f"WITH {DOCS} SELECT file_path, 'codebase_' || sha256(file_path)[1:16] AS collection FROM docs",
    "ignore_filter": f"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1), '/$', '') || ['/setup.py', '/tests/a.go', '/build/x.c', '/app.min.js', '/a.spec.ts', '/Makefile', '.png'][(page_id % 7 + 1)::INT] AS path FROM pages),
      q AS (SELECT *, string_split(path, '/') AS parts FROM p)
      SELECT page_id, path, len(list_filter(parts, lambda x: regexp_matches(x, '{_IGNORED}') OR x = 'fr')) > 0 OR regexp_matches(path, '{_IGNORED}') AS ignored,
        regexp_matches(parts[-1], '^(?:{_glob(filters.TEST_FILES)})') OR list_has_any(list_transform(parts, lambda x: lower(x)), {list(filters.TEST_FOLDERS)}) AS is_test,
        list_contains({filters.SOURCE_SUFFIXES}, regexp_extract(lower(parts[-1]), '.(\\.[^.]+)$', 1)) OR list_contains({list(filters.SOURCE_NAMES)}, lower(parts[-1])) AS is_source FROM q""",
    "rerank_context": f"""WITH {DOCS} SELECT doc_id, md5(concat_ws(' | ', 'File: ' || file_path, CASE WHEN doc_id % 2 = 0 THEN 'Class: ' || {_init('source')} END,
      CASE WHEN doc_id % 3 = 0 THEN 'Function: read_' || source END, 'Code: ' || content)) AS context_md5 FROM docs""",
    "format_results": f"""WITH RECURSIVE {CHUNKS},
      blocks AS (SELECT file_path AS query_id, chunk_index, file_path || ':' || start_line || '-' || end_line
        || coalesce(' ' || nullif(concat_ws(' | ', CASE WHEN chunk_index % 2 = 0 THEN 'load()' END, CASE WHEN chunk_index % 3 = 0 THEN 'Doc' END), ''), '') || chr(10)
        || CASE WHEN length(content) > 600 THEN substring(content, 1, 600) || '…' ELSE content END || chr(10) || '---' AS block FROM chunks),
      texts AS (SELECT query_id, string_agg(block, chr(10) ORDER BY chunk_index) AS text FROM blocks GROUP BY query_id)
      SELECT query_id, length(text) AS n_chars, md5(text) AS text_md5 FROM texts""",
    "hash_embed": f"""WITH {DOCS},
      words AS (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM docs),
      buckets AS (SELECT doc_id, ('0x' || md5(word)[1:8])::UBIGINT % 64 AS b, count(*)::DOUBLE AS n FROM words GROUP BY ALL),
      norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm, map_from_entries(list((b, n))) AS m FROM buckets GROUP BY doc_id)
      SELECT doc_id, list_transform(range(64), lambda k: round(coalesce(m[k::UBIGINT], 0) / norm, 6) + 0.0) AS embedding FROM norms""",
    "debounce": "SELECT user_id AS client, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) >= 3600000000::BIGINT AS due FROM events GROUP BY user_id",
    "client_expiry": "SELECT user_id AS client, epoch_us(max(ts)) AS last_seen, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 3600000000::BIGINT AS expired FROM events GROUP BY user_id",
    "interval_overlap": f"""WITH RECURSIVE {CHUNKS}, spans AS (SELECT file_path, unnest(range(0, (length(content) + 299) // 300)) AS ord, length(content) AS n FROM docs WHERE length(content) > 0)
      SELECT c.file_path, c.chunk_index, count(*) AS overlaps, min(s.ord) AS first FROM chunks c JOIN spans s ON c.file_path = s.file_path AND s.ord * 300 < c.end_char AND c.start_char < least(s.ord * 300 + 300, s.n) GROUP BY ALL""",
    "conversation_context": f"""WITH turns AS (SELECT conv_id::VARCHAR AS file_path, turn AS chunk_index, text AS content, turn AS start_line, turn AS end_line FROM conversations)
      SELECT file_path, chunk_index, expanded_start_line, expanded_end_line, md5(expanded_content) AS expanded_md5 FROM ({_expanded('turns')})""",
    "query_features": f"SELECT item_id, len({_idents('text')}) AS n_identifiers, len({_idents('text')}) > 0 AS has_identifiers, list_sort({_significant('text')}) AS words FROM benchmark",
}
