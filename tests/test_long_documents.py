"""Pages beyond the 999th of a document are its own, not the next document's."""

from corpusmill import catalog


def test_pages_of_a_long_document(spark, tmp_path):
    long = "\n".join(["filler"] * 4000 + ["zebra"])  # 1001 pages of four lines
    spark.createDataFrame([(1, long), (2, "apple")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zebra"), (2, "apple")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(v, [float(i == v % 20 or v == 20 * i) for i in (1, 2)], 0) for v in (1, 2, 20, 40)]  # a vector for each question and document
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.qid, r.doc_id, r.norm) for r in run("bm25_doc_max_norm")} == {(1, 1, 1.0), (2, 2, 1.0)}
    assert {(r.qid, r.doc_id) for r in run("doc_fusion")} == {(1, 1), (2, 2)}
    weight = {r.token: (r.df, r.cf, r.max_weight) for r in run("bm25_postings")}
    assert weight["filler"][:2] == (1000, 4000) and weight["zebra"] == weight["apple"] and weight["zebra"][:2] == (1, 1)
