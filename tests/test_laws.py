"""Known outcomes of the law operators, and the stored index against plain scores."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.operators import laws as W
from corpusmill.operators import lexical
from corpusmill.operators import pages as G

LAWS = [(1, "trust law", "tr law", 4, 2005), (2, "trust law", "tr law", 4, 2018), (3, "general partnership law", "gp law", 11, 2004), (4, "employment law", "em law", 2, 2019), (5, "leasing law", "le law", 2, 2019)]


def laws(spark):
    return spark.createDataFrame(LAWS, "doc_id long, name string, abbreviation string, number int, year int")


def test_asked_laws(spark):
    asked = {
        1: ("Does the DIFC Trust Law 2018 or the General Partnership Law apply?", {"trust law", "general partnership law"}),
        2: ("What does 'the Trust Law' say?", {"trust law"}),  # quoted only
        3: ("Is the Leasing Law older than \"the Trust Law\"?", {"leasing law"}),
        4: ("What does a general partnership owe?", {"general partnership law"}),  # short, as nothing is named in full
        5: ("Does the Trust Law cover a general partnership?", {"trust law"}),  # short names do not count beside full ones
        6: ("See GP Law Art 3 and DIFC Law No. 2 of 2019", {"general partnership law", "employment law"}),
        7: ("Who is the judge?", set()),
        8: (None, set()),
    }
    questions = spark.createDataFrame([(q, t) for q, (t, _) in asked.items()], "qid long, question string")
    got = {}
    for r in W.asked_laws(questions, laws(spark)).collect():
        got.setdefault(r.qid, set()).add(r.name)
    assert got == {q: names for q, (_, names) in asked.items() if names}
    docs = {(r.qid, r.doc_id) for r in W.law_documents(W.asked_laws(questions, laws(spark)), laws(spark)).collect()}
    assert (2, 2) in docs and (2, 1) not in docs  # the latest edition


def test_heading_pages(spark):
    case = "Claimant and Defendant; judgment. The respondent appeals.\n3. The claimant seeks costs.\nArticle 9 is cited"
    pages = [(1, 1, "Article 1 ..... 2\nArticle 2 ..... 3\nArticle 3 ..... 4"), (1, 2, "  ARTICLE 12A Scope\ntext about Article 7\n13.\n\n Powers"), (1, 3, "14. Duties of all persons who are registered under the present law of the land\n15. Listed ........ 9\n301. Too Large\n300.\nLast"), (1, 4, "Part IV\nSchedule 2\nRegulation 3.1\nAPPENDIX 1\nRule 5\nSection 6"),
             (2, 1, case), (3, 1, None), (4, 1, "")]
    got = {(r.doc_id, r.key, r.page) for r in W.heading_pages(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()}
    own = {(1, k, 4) for k in ("part_IV", "schedule_2", "regulation_3.1", "appendix_1", "rule_5", "section_6")}
    assert got == own | {(1, "article_12A", 2), (1, "article_13", 2), (1, "article_14", 3), (1, "article_300", 3), (2, "article_9", 1)}


def test_asked_orders(spark):
    orders = spark.createDataFrame([("court", 1, 2020, 10), ("sct", 1, 2020, 11), ("rules_of_court", 2, 2020, 12), ("dra", 1, 2020, 13), ("sct", 3, 2020, 14)], "kind string, number int, year int, doc long")
    asked = spark.createDataFrame([(1, "DIFC Courts Small Claims Tribunal Order No. 1 of 2020"), (2, "Courts Order No 1 of 2020"), (3, "under the Rules of Court, Court Order No. 2 of 2020"), (4, "Court Order No. 3 of 2020 and DRA Order No. 1 of 2020"), (5, "Court Order No. 9 of 2020"), (6, None)], "qid long, question string")
    assert {tuple(r) for r in W.asked_orders(asked, orders).collect()} == {(1, "sct", 11), (2, "court", 10), (3, "rules_of_court", 12), (4, "sct", 14), (4, "dra", 13)}


def test_assembled(spark):
    first = spark.createDataFrame([(1, 2, 20), (1, 1, 10), (2, 1, 30)], "qid long, ord int, doc long")
    second = spark.createDataFrame([(1, 1, 40), (1, 2, 10)], "qid long, ord int, doc long")
    pages = spark.createDataFrame([(1, 10, 3), (1, 40, 1)], "qid long, doc long, page int")
    got = {r.qid: (r.docs, [tuple(p) for p in r.pages]) for r in W.assembled([(first, None), (second, pages)]).collect()}
    assert got == {1: ([10, 20, 40], [(10, 3), (40, 1)]), 2: ([30], [])}


def test_second_step_only_for_weak_questions(spark):
    targeted = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 1, 0.1), (2, 3, 1, 0.2)], "qid long, doc_id long, page int, score double")
    limits = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "qid long, most int")
    asked = []

    def search(weak):
        asked.extend(r.qid for r in weak.collect())
        return weak.select("qid", F.lit(7).cast("long").alias("doc_id"), F.lit(5).alias("page"), F.lit(0.5).alias("score"))

    got = {(r.qid, r.doc_id, r.rank) for r in G.retrieved(targeted, limits, search).collect()}
    assert sorted(asked) == [2, 3] and got == {(1, 1, 1), (1, 2, 2), (2, 7, 1), (2, 3, 2), (3, 7, 1)}


def test_stored_index(spark, monkeypatch):
    units = {1: ["a", "b", "a"], 2: ["b"], 3: [], 4: ["c", "a"], 5: None}
    asked = {1: ["a", "a", "c"], 2: ["zebra"], 3: []}
    n, avg = 5, sum(len(t or []) for t in units.values()) / 5
    df = Counter(w for t in units.values() for w in set(t or []))
    weight = lambda w, t: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (t.count(w) / (t.count(w) + 1.5 * (1 - 0.75 + 0.75 * len(t) / avg)))
    want = {(q, u): round(sum(weight(w, t) for w in ws if w in t), 9) for q, ws in asked.items() for u, t in units.items() if t and set(ws) & set(t)}
    index = lexical.LexicalIndex.write(spark.createDataFrame(list(units.items()), "u long, toks array<string>"), "u", "toks")
    queries = spark.createDataFrame(list(asked.items()), "qid long, toks array<string>")
    for rows in (200_000, 0):
        monkeypatch.setattr(lexical, "QUERY_ROWS", rows)
        assert {(r.qid, r.unit): round(r.score, 9) for r in index.search(queries, "qid", "toks").collect()} == want
    assert {r.token: (r.df, r.cf) for r in index.weights().collect()} == {"a": (2, 3), "b": (2, 2), "c": (1, 1)}
    assert {r.unit for r in index.where("unit > 1").search(queries, "qid", "toks").collect()} == {4}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_sets_move_no_postings(spark):
    index = lexical.LexicalIndex.write(spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["b"])], "u long, toks array<string>"), "u", "toks")
    asked = spark.createDataFrame([(1, ["b"]), (2, ["b"]), (3, ["a", "b"])], "qid long, toks array<string>")
    found = index.search(asked, "qid", "toks")
    assert "Exchange hashpartitioning" not in plan(found) and found.count() == 9
    assert {(r.qid, r.unit, r.rank) for r in index.best(asked, "qid", "toks", 1).collect()} == {(1, 2, 1), (2, 2, 1), (3, 1, 1)}  # the smaller unit on ties
    assert {(r.qid, r.unit, r.n) for r in index.shared(asked, "qid", "toks").collect()} == {(q, u, 2 if (q, u) == (3, 1) else 1) for q in (1, 2, 3) for u in (1, 2, 3)}


def test_names_are_looked_up_at_their_own_sizes(spark):
    """No run of words of a size that no name has becomes a row, and every question is read once."""
    from corpusmill.operators import matching as M

    names = spark.createDataFrame([("trust law",), ("law",)], "name string")
    found = M.named(spark.createDataFrame([(1, "the trust law")], "qid long, text string"), names, "qid", "text", "name")
    assert [tuple(r) for r in found.collect()] == [(1, "trust law", 1, 2)]
    assert plan(found).count("RDD") + plan(found).count("LocalTableScan") <= 2


def test_amendment_routes_group_no_pairs(spark):
    from corpusmill.operators import lookups as L

    routed = spark.createDataFrame([(1, "Which laws did it amend, and which were amended by it?", 2), (1, "Which laws did it amend, and which were amended by it?", 3), (2, "Who?", 1)], "qid long, question string, doc long")
    found = L.amendment_routes(routed, spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 1), (1, 4, 1)] and "SortMergeJoin" not in plan(found) and "LeftAnti" not in plan(found)


def test_boosts_do_not_multiply_rows(spark):
    one = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.4), (2, 9, 1, 0.1)], "qid long, doc_id long, page int, score double")
    questions = spark.createDataFrame([(1, "What fine is due under Article 7?", "number")], "qid long, question string, answer_type string")
    pages = spark.createDataFrame([(1, 1, "A law"), (1, 2, "SCHEDULE 2\nCONTRAVENTIONS AND FINES\nUSD 5,000")], "doc_id long, page int, text string")
    empty = lambda schema: spark.createDataFrame([], schema)
    found = G.boosted(one, questions, pages, empty("doc_id long, key string, page int"), empty("doc_id long, page int"), empty("qid long, doc_id long, page int"))
    assert {(r.qid, r.page): round(r.score, 6) for r in found.collect()} == {(1, 1): 0.52, (1, 2): 1.21, (2, 1): 0.12} and "Generate" not in plan(found)


def test_statutes_are_dealt(spark):
    """One small file of laws is not one task's."""
    from corpusmill.plans.fixtures import Inputs

    assert Inputs(spark, "/root/testdata/sf0.001").fx("statutes").rdd.getNumPartitions() > 1


def test_pages_are_read_once_for_headings(spark):
    """All patterns in one pass, with court cases told before; a document is one number of marks, and null pages tell nothing."""
    case = "Claimant, defendant, judgment.\n3. Costs of it\nArticle 9 is cited"
    pages = spark.createDataFrame([(1, 1, case), (2, 1, "3. Costs of it\nArticle 9 Scope"), (1, 2, None), (3, 1, None)], "doc_id long, page int, text string")
    court = W.of_case(pages)
    assert [r.doc_id for r in court.collect()] == [1] and "bit_or" in plan(court)
    found = W.heading_pages(pages, court)
    assert {tuple(r) for r in found.collect()} == {(1, "article_9", 1), (2, "article_3", 1), (2, "article_9", 1)} and "Union" not in plan(found)


def test_names_come_with_what_stands_beside_them(spark):
    """A text is read once: no join with the texts again; marks beside a name tell whole words, at the ends of a text as well."""
    texts = [(1, "trust law"), (2, "the trust laws, étrust law"), (3, "[DOCUMENT: DIFC Law] Trust Law"), (4, "court case: trust law"), (5, None), (6, "court case: tax law")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = W.law_name_scores(spark.createDataFrame([("trust law",), ("tax law",)], "name string"), docs.where("doc_id <> 3"), 5)
    assert {tuple(r) for r in found.collect()} == {("trust law", 1, 10, 2), ("trust law", 2, 11, 1), ("tax law", 6, 10, 1)} and "MapInArrow" not in plan(found)
    assert {(r.doc_id, r.score) for r in W.law_name_scores(spark.createDataFrame([("trust law",)], "name string"), docs, 6).collect()} == {(3, 10000)}


def test_page_plan_has_more_tasks_for_more_lines(spark, monkeypatch):
    from corpusmill.plans import composite_queries as C
    from corpusmill.plans.fixtures import Inputs

    few = C.fast_page_plan(Inputs(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(C, "LINES", 600)
    many = C.fast_page_plan(Inputs(spark, "/root/testdata/sf0.001"))
    assert many.rdd.getNumPartitions() == 10 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
