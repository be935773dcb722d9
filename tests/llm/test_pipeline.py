"""The stages of the pipeline against plain-Python statements of what they do, each on its own input."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from lodestone.llm import near_dedup, sentencepieces

from .test_decontaminate import brute as overlaps_of
from .test_substring_dedup import WORD

SF = "/root/testdata/sf0.001"


def kept_words(rows):
    texts = [(i, WORD.findall(t)) for i, t in sorted(rows)]
    first, out = {}, {}
    for i, w in texts:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in texts:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = docs.collect()
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    last = docs.collect()

    # language: only what has no letters, or no known language, goes
    kept = {r.doc_id for r in inputs["near_dedup"]}
    assert all(r.doc_id in kept for r in inputs["language_id"] if r.lang and sum(map(str.isalpha, r.text)) > 40)
    # near duplicates: the smallest id of each class
    classes = {r.doc_id: r.class_id for r in near_dedup.near_groups(spark.read.parquet(f"{tmp_path}/0")).collect()}
    assert {r.doc_id for r in inputs["substring_dedup"]} == set(classes.values())
    # repeated passages
    true = kept_words([(r.doc_id, r.text) for r in inputs["substring_dedup"]])
    assert {r.doc_id: WORD.findall(r.text) for r in inputs["decontaminate"]} == true
    assert all(r.n_chars == len(r.text) for r in inputs["decontaminate"])
    # benchmark passages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, found in overlaps_of([(r.doc_id, r.text) for r in inputs["decontaminate"]], items) if not found}
    assert {r.doc_id for r in inputs["sentencepiece"]} == clean
    # ids
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepieces.MODEL))
    texts = {r.doc_id: r.text for r in inputs["sentencepiece"]}
    assert len(last) == len(texts)
    for r in last:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.text == texts[r.doc_id]
