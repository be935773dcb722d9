"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Words of documents and of benchmark items are hashed. Fixed masks pick some of the words of a short span, so
that a substituted word under a gap does not change the hash. The hashes of all masks at all places are
joined, and around each hit the two texts are compared word by word: an overlap is a window of 13 words,
or the whole of a shorter item, with at most two, or a fifth, substituted. The masks are chosen such that
every window of 13 words with up to two substitutions has a hit. A shorter item is cut into one run more than it
may have substitutions, so that one of them is left whole, and found by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, unused

WINDOW = 13
#: Substitutions in a full window; shorter items may have a fifth of their words substituted.
SUBSTITUTIONS = 2
#: Word offsets that each mask reads. With 13 words and any two of them substituted, one of these at one
#: place reads only words that are not.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
#: Up to this many benchmark hashes are broadcast (under 32 bytes each); more are joined by shuffling.
BROADCAST_HASHES = 200_000


def span(masks=MASKS) -> int:
    return max(m[-1] for m in masks) + 1


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased; a null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(n: int) -> list[tuple[int, int]]:
    """Place and length of the runs that a short item of ``n`` words is cut into, one more than may be substituted."""
    parts = n // 5 + 1
    return [(n * k // parts, n * (k + 1) // parts - n * k // parts) for k in range(parts)]


def _seed(name: int, mask, at: Column) -> Column:
    # Plain element access keeps this inside generated code.
    return F.xxhash64(F.lit(name), *(F.get("words", at + k) for k in mask))


def _places(rows: DataFrame, masks: dict, *keep: str) -> DataFrame:
    """One row for each place of each mask (by name): ``keep``, place, seed."""
    spans = {name: m[-1] + 1 for name, m in masks.items()}
    least = min(spans.values())
    at = rows.where(F.size("words") >= least).select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("place"))
    seeds = [_seed(i, m, F.col("place")) if spans[i] == least else F.when(F.col("place") + spans[i] <= F.size("words"), _seed(i, m, F.col("place"))) for i, m in masks.items()]
    found = at.select(*keep, "place", F.explode(F.array(*seeds)).alias("seed"))
    return found if max(spans.values()) == least else found.where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, matched, length): overlapping windows around seed hits.

    Words are lower-cased runs of letters and digits. Items without words and nulls have no overlaps. Rows of one doc_id, or one item_id, are judged each. One row for each
    document, item and diagonal: its best window, of equals the first.
    """
    d = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "words")).withColumnRenamed("words", "item_words"))
    full = dict(enumerate(masks))
    seeds = _places(items.where(F.size("item_words") >= window).withColumnRenamed("item_words", "words"), full, "item").select("item", F.col("place").alias("item_place"), F.lit(span(masks)).alias("reach"), "seed")
    lengths = [r.n for r in items.where(F.size("item_words") < window).select(F.size("item_words").alias("n")).distinct().collect()]  # fewer than window
    wanted = full
    if lengths:
        cut = [F.when(F.size("words") == n, F.array(*(F.struct(F.lit(at).alias("item_place"), F.lit(k).alias("reach"), _seed(-k, range(k), F.lit(at)).alias("seed")) for at, k in runs(n)))) for n in lengths]
        short = items.where(F.size("item_words") < window).withColumnRenamed("item_words", "words").select("item", F.explode(F.coalesce(*cut)).alias("s"))
        seeds = seeds.unionByName(short.select("item", "s.item_place", "s.reach", "s.seed"))
        wanted = full | {-k: tuple(range(k)) for n in lengths for _, k in runs(n)}
    seeds = materialize(seeds.distinct())
    small = seeds.count() <= BROADCAST_HASHES
    near = F.broadcast if small else (lambda x: x)
    hits = _places(d, wanted, "doc_id", "words").join(near(seeds), "seed") if small else None
    if hits is None:  # only hashes and places travel; texts are met again by id
        d = materialize(d.withColumn("row", F.xxhash64("doc_id", "words")))
        found = _places(d, wanted, "row").join(seeds, "seed").select("row", "item", "item_place", "reach", "place").distinct()
        hits = found.join(d.dropDuplicates(["row"]), "row")
    hits = hits.select("doc_id", "words", "item", "place", "item_place", "reach").join(near(items), "item")
    size = F.least(F.lit(window), F.size("item_words"))
    allowed = F.when(F.size("item_words") >= window, F.lit(substitutions)).otherwise(F.floor(F.size("item_words") / 5).cast("int"))
    shift = F.col("place") - F.col("item_place")
    low = F.greatest(F.lit(0), -shift, F.col("item_place") - size + F.col("reach"))
    high = F.least(F.col("item_place"), F.size("item_words") - size, F.size("words") - shift - size)
    hits = hits.select("doc_id", "item_id", "words", "item_words", shift.alias("shift"), size.alias("length"), allowed.alias("allowed"), low.alias("low"), high.alias("high")).where("low <= high")
    matched = lambda a: F.aggregate(F.sequence(F.lit(0), F.col("length") - 1), F.lit(0), lambda n, k: n + F.when(F.get("item_words", a + k) == F.get("words", a + k + F.col("shift")), 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence("low", "high"), lambda a: F.struct(matched(a).alias("matched"), (-a).alias("back"))))
    hits = hits.withColumn("best", best).where(F.col("best.matched") >= F.col("length") - F.col("allowed"))
    return (hits.groupBy("doc_id", "item_id", "shift").agg(F.max(F.struct("best.matched", "best.back", "length")).alias("b"))
            .select("doc_id", "item_id", (F.col("shift") - F.col("b.back")).alias("doc_start"), (-F.col("b.back")).alias("item_start"), F.col("b.matched").alias("matched"), F.col("b.length").alias("length")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) for every row of ``docs``; item ids ascend.

    Rows with one id, null among them, share what any of them has. Other columns are ignored.
    """
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(F.col("doc_id").alias("hit_id"), "item_ids")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    ids = F.coalesce("item_ids", F.array().cast(f"array<{kind}>"))
    return (docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
            .select("doc_id", F.col("hit_id").isNotNull() | F.col("item_ids").isNotNull(), ids)
            .toDF("doc_id", "contaminated", "item_ids").select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), "item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id no overlap names, with all columns.

    Rows of one id, null among them, stay or go together; null texts and those without words stay.
    """
    (hit,) = unused(docs, "hit_id")
    found = materialize(overlaps(docs, benchmark).select(F.col("doc_id").alias(hit)).distinct())
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(hit)), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of every document; see ``contamination``."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same without seeds: all places where a document and an item have a word in common, by diagonals.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS dn, unnest(w) AS word, unnest(range(len(w))) AS dp FROM d),
bw AS (SELECT item_id, len(w) AS bn, unnest(w) AS word, unnest(range(len(w))) AS bp FROM b),
met AS (SELECT doc_id, item_id, dp - bp AS shift, bp, bn, dn FROM dw JOIN bw USING (word)),
counted AS (SELECT *, least(13, bn) AS size, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY bp RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM met),
found AS (SELECT DISTINCT doc_id, item_id FROM counted WHERE n >= size - CASE WHEN bn >= 13 THEN 2 ELSE bn // 5 END AND least(bn, dn - shift) - greatest(0, -shift) >= size),
lists AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids FROM found GROUP BY doc_id)
SELECT d.doc_id, item_ids IS NOT NULL AS contaminated, coalesce(len(item_ids), 0) AS n_items, coalesce(item_ids, []) AS item_ids FROM d LEFT JOIN lists USING (doc_id)
"""
