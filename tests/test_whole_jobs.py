"""Steps that once did less than their whole job: names of any length, both rankings of a fusion, whole texts for the second scorer."""

import random

from corpusmill import catalog
from corpusmill.operators import laws as W
from corpusmill.operators import matching
from tests.compare import differences


def test_names_of_any_length(spark):
    rng = random.Random(4)
    word = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    names = [word(rng.choice([1, 7, 8, 9, 12, 20])) for _ in range(60)] + ["x1 x2 x3 x4 x5 x6 x7 x8 x9", "x1 x2 x3 x4 x5 x6 x7 x8 x90", "x1 x2 x3 x4 x5 x6 x7 x8"]
    asked = [(i, f"{word(rng.randrange(6))} {rng.choice(names)} {word(rng.randrange(6))}") for i in range(40)] + [(90, "X1-x2 x3 x4 x5 x6 x7 x8 x9"), (91, "x1 x2 x3 x4 x5 x6 x7 x8 y"), (92, "x1 x2 x3 x4 x5 x6 x7 x8 x91"), (93, None)]
    want = set()
    for q, text in asked:
        w = (text or "").lower().replace("-", " ").split()
        hits = {(n, s, len(n.split())) for n in names for s in range(len(w)) if w[s : s + len(n.split())] == n.split()}
        want |= {(q, *h) for h in hits if not any(o[1] <= h[1] and o[1] + o[2] >= h[1] + h[2] and o[2] > h[2] for o in hits)}
    got = matching.named(spark.createDataFrame(asked, "qid long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "qid", "text", "name", None)
    assert {tuple(r) for r in got.collect()} == want and {s for *_, s in want} >= {9, 12, 20}


def test_laws_with_long_names(spark, tmp_path):
    """A name of eleven words counts in full, in short and in quotation marks."""
    long = "law on the recognition of foreign trusts and their trustees law"
    laws = spark.createDataFrame([(1, long, "r f t l", 1, 2019), (2, "tax law", "ta law", 2, 2019)], "doc_id long, name string, abbreviation string, number int, year int")
    asked = [(1, f"Does the {long.title()} apply?"), (2, f"What of the {long.removesuffix(' law')}?"), (3, f'Who signed "{long}"?')]
    got = {(r.qid, r.name) for r in W.asked_laws(spark.createDataFrame(asked, "qid long, question string"), laws).collect()}
    assert got == {(1, long), (2, long), (3, long)}
    # and as a query, against its SQL
    names = ["one two three four five six seven eight", "large ring", "one two"]
    spark.createDataFrame([(i, names[i % 3], ("SMALL", "TIN")[i % 2], i) for i in range(12)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i,) for i in range(12)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, timestamp'1995-01-01' AS o_orderdate FROM range(12)").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.queries()["extract_law_names"](spark, str(tmp_path))
    assert differences(found, catalog.oracle_sql()["extract_law_names"], str(tmp_path)) == ""
    assert any(len(r.name.split()) > matching.NAME_WORDS for r in found.collect())


def tables(spark, folder, docs, asked, near):
    """Tables of documents and benchmark texts; ``near``: the vector of each document, texts have (1, 0)."""
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(20 * i, [1.0, 0.0], 0) for i, _ in asked] + [(d, v, 0) for d, v in near.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def test_passages_of_both_rankings(spark, tmp_path):
    """The nearest vector alone brings a passage in, one without a text goes, and the second scorer reads a text to its end."""
    docs = [(d, f"common filler {d}") for d in range(1, 13)] + [(13, "x" * 3000 + " common words here"), (14, "nothing alike"), (15, "  "), (16, None)]
    near = {d: [0.1 / d, 0.0] for d in range(1, 14)} | {14: [0.9, 0.0], 15: [0.95, 0.0], 16: [0.99, 0.0]}
    tables(spark, str(tmp_path), docs, [(5, "common words here"), (6, "unheard")], near)
    found = catalog.queries()["passage_rrf"](spark, str(tmp_path))
    assert differences(found, catalog.oracle_sql()["passage_rrf"], str(tmp_path)) == ""
    rank = {(r.qid, r.unit): r.rank for r in found.collect()}
    assert rank[5, 13] == 1 and rank[6, 14] == 1 and not {15, 16} & {u for _, u in rank} and len(rank) == 20


def test_accuracy_reads_whole_documents(spark, tmp_path):
    """A gold document that holds the text behind its 2,000th character is kept before ones that have some of its words at their beginning."""
    docs = [(d, "the prison governor gave") for d in range(1, 6)] + [(9, "filler " * 500 + "the prison governor gave evidence")]
    tables(spark, str(tmp_path), docs, [(1, "the prison governor gave evidence")], {})
    found = catalog.queries()["retrieval_accuracy"](spark, str(tmp_path))
    assert differences(found, catalog.oracle_sql()["retrieval_accuracy"], str(tmp_path)) == ""
    assert [(r.qid, r.accuracy) for r in found.collect()] == [(1, 1.0)]
