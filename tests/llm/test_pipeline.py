"""The pipeline against a brute-force version of each stage."""

import zlib

import numpy as np
from tests.llm.test_decontamination import brute
from tests.llm.test_simhash import all_similar, nearly
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import language_id
from corpusmill.llm.common import tokenizer_file


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "x", 0), (10_002, "12345", None, "x", 5), (10_003, docs.first().text, "en", None, None)], docs.schema)
    docs = docs.union(extra)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns
    model = language_id.fit(docs)
    want = {r.doc_id for r in language_id.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.35}
    got = kept.collect()
    assert {r.doc_id for r in got} == want and not want & {10_001, 10_002} and len(want) > 195

    rows = sorted(got, key=lambda r: r.doc_id)
    root = all_similar([r.text for r in rows])
    one = {rows[i].doc_id for i in set(root)}  # rows are in order, so a root is the smallest doc_id
    unique = corpus_pipeline.near_duplicates(spark, kept, sf)
    kept = {r.doc_id for r in unique.collect()}
    assert unique.columns == docs.columns and len(kept) < len(rows)
    assert nearly({(False, d) for d in kept}, {(False, d) for d in one}, {r.doc_id: r.text for r in rows})
    one = kept

    bad = {d for d, _ in brute([(r.doc_id, r.text) for r in rows if r.doc_id in one and len(r.text) < 3000], bench)}
    clean = corpus_pipeline.decontaminated(spark, unique, sf)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and bad and not bad & left
    assert {r.doc_id for r in rows if r.doc_id in one and len(r.text) < 3000} - bad <= left

    pieces = corpus_pipeline.packed(spark, clean, sf).collect()
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in clean.collect()}
    assert {p.doc_id for p in pieces} == left
    for p in pieces:
        ids = np.array([*tok.encode(text[p.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in text.values())


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= rows[0].asDict().keys()
