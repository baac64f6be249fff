"""Pages with equal texts and questions that are alike are looked at once; what is found is the same."""

import random

from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.operators import lexical
from corpusmill.plans import law_queries as Q
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.retrieval_queries import index_of
from tests.compare import differences


def test_pages_of_equal_texts(spark, monkeypatch):
    """The best pages are those of an index of single pages, ties and counts included, for small and large sets of questions."""
    rng = random.Random(8)
    texts = ["a b", "a", "b b c", "a c", "", None, "c"]
    pages = [(d, p, rng.choice(texts)) for d in range(60) for p in (1, 2, 3)] + [(99, 1, "only here a")]
    df = spark.createDataFrame(pages, "doc_id long, page int, text string").repartition(3)
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "b"]), (3, ["c", "only"]), (4, ["zebra"]), (5, [])], "qid long, toks array<string>")
    each = lexical.LexicalIndex.write(df.select(F.struct("doc_id", "page").alias("unit"), tokens(F.col("text")).alias("toks")), "unit", "toks")
    once = lexical.TextIndex.write(df, tokens, 4)
    assert once.texts.count() <= 3 * len(texts) + 1 and once.index.totals() == each.totals()
    assert {tuple(r) for r in once.index.weights().withColumn("w", F.round("max_weight", 9)).drop("max_weight").collect()} == {tuple(r) for r in each.weights().withColumn("w", F.round("max_weight", 9)).drop("max_weight").collect()}
    for rows in (200_000, 0):
        monkeypatch.setattr(lexical, "QUERY_ROWS", rows)
        for k in (1, 4, 50, 500):
            got, want = ({(r.qid, r.unit.doc_id, r.unit.page, round(r.score, 9), r.rank) for r in index.best(asked, "qid", "toks", k).collect()} for index in (once, each))
            assert got == want and want


def test_questions_that_are_alike(spark, tmp_path):
    """Of equal questions one is searched for, and every one of them gets its pages."""
    spark.createDataFrame([(i, ("large ring", "hot bolt", "old plate")[i % 3], ("SMALL", "TIN")[i % 2], 3) for i in range(130)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i,) for i in range(120)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, timestamp'1995-01-01' AS o_orderdate FROM range(120)").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("retrieve_pages", "retrieval_analysis", "lowconf_merge", "weakest_retrievals"):
        assert differences(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], str(tmp_path)) == "", name
    t = Inputs(spark, str(tmp_path))
    assert Q._retrieved(t).select("qid").distinct().count() < Q.retrieve_pages(t).select("qid").distinct().count() == 120
    assert index_of(t, "statutes").texts.count() < t.fx("statutes").count() / 2
