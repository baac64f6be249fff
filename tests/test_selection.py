"""Page selection, metrics, index builders and readers of models' answers on small inputs with known outcomes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import said as S
from corpusmill.functions import text as T
from corpusmill.operators import citations as C
from corpusmill.operators import corpus as D
from corpusmill.operators import evaluation as E
from corpusmill.operators import indexes as X
from corpusmill.operators import pages as G
from corpusmill.operators import retrieval as R

PAGES = "qid long, doc_id long, page int, score double"
ASKED = "qid long, question string, answer_type string"


def test_title_demoted(spark):
    scores = [(1, 1, 1, 0.5), (1, 1, 2, 0.4), (1, 1, 3, 0.2), (1, 2, 1, 0.9), (1, 2, 2, 0.7), (1, 3, 1, 0.4), (1, 3, 2, 0.4), (1, 4, 1, 0.1), (1, 5, 1, 0.5), (1, 5, 2, 0.45)]
    scores += [(q, 1, p, s) for q in (2, 3) for p, s in ((1, 0.5), (2, 0.4))]
    asked = [(1, "What does it say?", "free_text"), (2, "Is it so?", "boolean"), (3, "What is the date of issue?", "date"), (4, None, None)]
    routed = [(1, 5, 1), (1, 1, 2)]
    got = {(r.qid, r.doc_id, r.page): round(r.score, 6) for r in G.title_demoted(spark.createDataFrame(scores, PAGES), spark.createDataFrame(asked, ASKED), spark.createDataFrame(routed, "qid long, doc_id long, page int")).collect()}
    want = {(q, d, p): s for q, d, p, s in scores}
    assert got == want | {(1, 1, 1): 0.399}  # not by a lead of 0.2, a tie, a lone page, the router's page, a boolean, metadata


def test_fallback_pages(spark):
    chunks = [(1, 1, 2, 1), (1, 1, 2, 2), (1, 1, 3, 3), (1, 2, 1, 4), (1, 3, 5, 5), (2, 1, 1, 2), (2, 1, 3, 1), (3, 1, 1, 1), (3, 1, 2, 2), (3, 1, 3, 3), (3, 2, 1, 4)]
    asked = [(1, "What is due?", "number", 1, 2), (2, "When was it issued?", "date", 1, 3), (3, "Is it so?", "boolean", 2, 3), (4, "Nothing found?", "date", 1, 3)]
    found = G.fallback_pages(spark.createDataFrame(chunks, "qid long, doc_id long, page int, rank int"), spark.createDataFrame(asked, ASKED + ", each int, most int"), spark.createDataFrame([(1, 3)], "doc_id long, page int"))
    got = {(r.qid, r.rank): (r.doc_id, r.page, round(r.score, 6)) for r in found.collect()}
    assert got == {
        (1, 1): (1, 2, 1.01), (1, 2): (2, 1, 0.27), (2, 1): (1, 3, 1.506667),
        (3, 1): (1, 1, 1.02), (3, 2): (1, 2, 0.51), (3, 3): (2, 1, 0.27),
    }
    assert found.where("false").count() == 0


def test_with_referred(spark):
    pages = [(q, 1, p, 1.0 / p, p) for q in (1, 2) for p in (1, 2, 3, 4, 5, 6)] + [(3, 9, 1, 1.0, 1)]
    edges = [(1, 1, 1, 1, 9), (1, 1, 2, 2, 4), (1, 1, 3, 2, None), (1, 2, 1, 2, 4), (1, 2, 2, 1, 3), (1, 3, 1, 3, 1), (1, 4, 1, 4, 1), (1, 5, 1, None, None), (9, 1, 1, 9, 2)]
    asked = [(1, "What is it?"), (2, "How do both differ?"), (3, "What is it?")]
    both = G.with_referred(spark.createDataFrame(pages, PAGES + ", rank int"), spark.createDataFrame(edges, "doc_id long, page int, place int, target_doc long, target_page int"), spark.createDataFrame(asked, "qid long, question string"))
    new = {(r.qid, r.rank): (r.doc_id, r.page) for r in both.where("rank > 6 or (qid = 3 and rank > 1)").collect()}
    assert new == {(1, 7): (2, 4), (1, 8): (3, 1), (2, 7): (1, 9), (2, 8): (2, 4)}
    assert both.count() == 13 + 4 and {r.score for r in both.where("rank > 6").collect()} == {G.REFERRED}


def test_found_gold(spark):
    ids = lambda rows: spark.createDataFrame(rows, "qid long, unit long")
    asked, gold = spark.createDataFrame([(i,) for i in range(1, 5)], "qid long"), ids([(1, 1), (1, 2), (2, 1), (3, 5)])
    before, after = ids([(1, 2), (1, 2), (2, 1), (2, 3), (4, 1)]), ids([(1, 2), (2, 3)])
    assert {r.qid: r.hit for r in E.found_gold(asked, gold, before).collect()} == {1: True, 2: True, 3: False, 4: None}
    assert {r.qid: (r.hit, r.dropped) for r in E.reranked_gold(asked, gold, before, after).collect()} == {1: (True, False), 2: (False, True), 3: (False, False), 4: (None, None)}


def test_citations(spark):
    no = "I cannot answer based on the provided passages."
    rows = [(1, "a [P1] b [P3].", [True, True, False]), (2, no, [False, False]), (3, no, [True]), (4, "nothing", [True]), (5, "[P1]", [False]), (6, "[P2][P2][P9]", [False, True]), (7, "nothing", [])]
    scores = E.relevant_citations(spark.createDataFrame(rows, "qid long, response string, relevant array<boolean>"))
    got = {r.qid: (r.precision, r.recall, r.f1, r.raf) for r in scores.collect()}
    assert got == {1: (0.5, 0.5, 0.5, 0.5), 2: (1, 1, 1, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0), 6: (1, 1, 1, 1), 7: (1, 1, 1, 0)}
    one = E.citation_summary(scores).first()
    assert (one.n, one.with_relevant) == (7, 4) and [one.raf, one.eligibility, one.true_rate, one.false_rate] == pytest.approx([2.5 / 7, 0.5, 1 / 3, 0.25])
    assert E.citation_summary(scores.where("false")).first().eligibility == 0


def test_total_score(spark):
    schema = "answer_type string, quality double, grounding double, telemetry double, speed double"
    rows = [("boolean", 1.0, 0.5, 1.0, 1.0), ("date", 0.0, 0.5, 1.0, 1.05), ("free_text", 0.8, 1.0, 0.0, 0.85)]
    one = E.total_score(spark.createDataFrame(rows, schema)).first()
    assert one.total == pytest.approx((0.7 * 0.5 + 0.3 * 0.8) * (2 / 3) * (2 / 3) * (2.9 / 3))
    assert E.total_score(spark.createDataFrame(rows[:1], schema)).first().total == pytest.approx(0.35)
    assert E.total_score(spark.createDataFrame([], schema)).first().total == 0


def test_heading_key(spark):
    want = {
        "Article 5(1)": "article_5_sub_1", " ARTICLE 28 Duties": "article_28", "Article 5A(1)": "article_5A(1)", "Schedule 3": "schedule_3", "Schedule IV": None, "part iv of it": "part_iv", "Article IV": None,
        "Rule 3.1": "rule_3", "Regulation 3.1.2": "regulation_3.1", "Chapter 2": "chapter_2", "Appendix 2A": "appendix_2", "Articles 3": None, "The Article 3": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "h string").select("h", X.heading_key(F.col("h")).alias("key"))
    assert {r.h: r.key for r in df.collect()} == want


def test_case_index(spark):
    rows = [(1, "cfi-1-2020", None), (2, None, "In CFI 001/2020 and SCT 2/2021"), (3, " ", "no number"), (4, "SCT 2 of 2021", "CFI 9/2009"), (5, None, None)]
    got = {(r.case_id, r.doc_id) for r in X.case_index(spark.createDataFrame(rows, "doc_id long, case_id string, first_page string")).collect()}
    assert got == {("CFI 001/2020", 1), ("CFI 001/2020", 2), ("SCT 002/2021", 4)}


def test_index_agreement(spark):
    schema = "case_id string, doc_id long, kind string, names array<string>"
    auto = spark.createDataFrame([("A", 1, "x", ["Acme ", "Beta"]), ("A", 2, None, None), ("B", 3, "x", ["a"]), ("C", 4, "x", [])], schema)
    manual = spark.createDataFrame([("A", 1, "x", ["beta", "ACME", "acme"]), ("A", 2, None, ["q"]), ("B", 3, "y", ["a"]), ("B", 9, "y", []), ("D", 5, "x", [])], schema)
    got = {r.what: (r.total, r.correct) for r in X.index_agreement(auto, manual, ["kind"], ["names"]).collect()}
    assert got == {"cases": (4, 2), "auto_only": (1, 0), "manual_only": (1, 0), "doc_counts": (2, 1), "kind": (3, 2), "names": (3, 2)}


def test_editions_and_variants(spark):
    laws = spark.createDataFrame([(1, "DIFC Trust Law 2018", 2018), (2, "DIFC Tax Law", 2004), (3, "difc tax law", 2010), (4, "DIFC Tax Law", 2010), (5, "Tax Law", 2001), (6, "Law", 2001)], "doc_id long, name string, year int")
    editions = X.latest_editions(laws)
    assert {r.key: (r.name, r.doc_id) for r in editions.collect()} == {"difc trust law 2018": ("DIFC Trust Law 2018", 1), "difc tax law": ("difc tax law", 3), "tax law": ("Tax Law", 5), "law": ("Law", 6)}
    got = {r.name: r.doc_id for r in X.name_variants(editions).collect()}
    assert got == {"difc trust law 2018": 1, "difc trust law": 1, "trust law 2018": 1, "difc tax law": 3, "tax law": 5, "difc tax": 3}


def test_law_of_question(spark):
    titles = spark.createDataFrame([(1, "Employment Law DIFC Law No. 2"), (2, "Employment Law Amended"), (3, "Leasing of Property Law Consolidated Secret"), (4, "Property Damage"), (5, None), (6, "")], "doc_id long, title string")
    headings = spark.createDataFrame([(4, "article_9", 1), (3, "article_9", 5)], "doc_id long, key string, page int")
    asked = {
        1: ("Is employment regulated?", 2), 2: ("Who files under the Trust Law?", None), 3: ("What of leasing property?", 3), 4: ("A secret under Article 9?", 3), 5: ("What of property damage?", 4),
        6: ("What of properties?", None), 7: ("Damage under Article 9?", 4), 8: ("Article 77?", None), 9: (None, None),
    }
    got = {r.qid: r.doc_id for r in X.law_of_question(spark.createDataFrame([(q, t) for q, (t, _) in asked.items()], "qid long, question string"), titles, headings).collect()}
    assert got == {q: d for q, (_, d) in asked.items()}


def test_document_entries(spark):
    case = "Claimant and Defendant; judgment.\nDate of Issue: today"
    pages = spark.createDataFrame([(1, 1, case), (1, 2, "IT IS HEREBY ORDERED"), (1, 3, "2. and more"), (2, 1, "Rules of the court. Schedule 1"), (3, 1, None)], "doc_id long, page int, text string")
    kinds = X.document_kinds(pages)
    assert {r.doc_id: r.kind for r in kinds.collect()} == {1: "CASE", 2: "REGULATION", 3: "LAW"}
    got = {r.doc_id: tuple(r)[1:] for r in X.document_entries(pages, spark.createDataFrame([(2, "schedule_1", 1)], "doc_id long, key string, page int"), kinds).collect()}
    assert got == {1: ("CASE", 3, 0, [2, 3], 1, None), 2: ("REGULATION", 1, 1, None, None, [1]), 3: ("LAW", 1, 0, None, None, [1])}


def test_said(spark):
    def each(column, *raws):
        return [r.v for r in spark.createDataFrame(list(enumerate(raws)), "i long, x string").select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]

    parties = ['{"name": "A", "page": 1}', '{"names": ["A", "", "B"]}', '[{"name": "A"}, {"name": ""}, {"page": 2}]', '"A, B"', "{}", "[]", "{broken", "", None]
    assert each(S.party_names, *parties) == [["A"], ["A", "B"], ["A"], ["A, B"], [], [], [], [], []]
    passages = ['{"cite_2": " own ", "cite_1": "x"}', '{"age": "1", "cite_9": "any"}', '{"age": "1"}', "plain", "", None]
    assert each(lambda x: S.passage_text(x, F.lit(1)), *passages) == ["own", "any", '{"age": "1"}', "plain", "", None]
    objects = ['so: {"judge": "J", "page": 2} ok', '{"judge": "J"', "none", '{"page": "x"}', '{"judge": "J", "more": {"a": 1}}', None]
    assert [r and r.judge for r in each(lambda x: S.object_in(x, "judge string, page int"), *objects)] == ["J", None, None, None, "J", None]
    pairs = ['```json\n[{"q": "a", "a": "b"}, {"q": "c"}]\n```', '[{"q": "a", "a": "b", "z": 1}]', "```[]```", '[{"q": "cut', "no", None]
    assert [[tuple(p) for p in v] for v in each(S.question_answers, *pairs)] == [[("a", "b")], [("a", "b")], [], [], [], []]
    scores = ['x {"1": 0.9, "2": "0.5", } y', '{"0": 1, "5": 1, "a": 2, "3": "high"}', '{"1": {"2": 0.5}}', "none", None]
    assert [[tuple(p) for p in v] for v in each(lambda x: S.page_scores(x, F.lit(4)), *scores)] == [[(1, 0.9), (2, 0.5)], [], [(2, 0.5)], [], []]
    assert json.loads(each(S.unfenced, "```json\n{}\n```")[0]) == {}


def test_keyword_index(spark):
    rules = "RULES of the Dubai International Financial Centre Courts"
    pages = [
        (1, 1, rules), (2, 1, "Consultation paper"), (2, 2, " No. 07 of May 2021"), (3, 1, "CONSULTATION PAPER NO 8 of 2022"), (4, 1, "Consultation Paper No. 5 of 1999"), (5, 1, "In CFI 007/2020 and SCT 1/2021"),
        (6, 1, "DIFC Law No. (3) of 2009"), (7, 1, "the roadmap to the proposed changes"), (8, 1, " "), (9, 1, None), (10, 1, "other"), (10, 3, rules), (11, 1, "CFI 1/2001"), (12, 2, "SCT 1/2001"), (13, 1, rules),
    ]
    papers, indexed = spark.createDataFrame([(8, 2022)], "number long, year int"), spark.createDataFrame([(11,), (None,)], "doc_id long")
    index = X.keyword_index(spark.createDataFrame(pages, "doc_id long, page int, text string"), indexed, papers)
    got = {r.key: r.doc_id for r in index.collect()}
    assert got.pop("rdc") == got.pop("overriding objective") == 13
    assert {k: d for k, d in got.items() if d != 13} == {
        "cp_7_of_2021": 2, "consultation paper no. 7 of 2021": 2, "consultation paper no 7 of 2021": 2, "cfi 7/2020": 5, "cfi 007/2020": 5, "difc law no. 3 of 2009": 6, "roadmap to proposed changes": 7,
    }
    asked = [(1, "What do the Rules of Court say of a default judgment?"), (2, "See Consultation Paper No. 7 of 2021 and consultation paper 8 of 2022"), (3, "Consultation Paper No. 7?"), (4, None)]
    assert {tuple(r) for r in X.route_unindexed(spark.createDataFrame(asked, "qid long, question string"), index, papers).collect()} == {(1, 13), (2, 2)}


def test_prompt_kind(spark):
    want = {
        ("Which was earlier, CFI 1/2020 or CFI 2/2020?", "name"): "name_by_date", ("Which is larger, CFI 1/2020 or SCT 2/2020?", "name"): "name_by_value", ("Which is larger?", "name"): "name", ("Is it?", "boolean"): "boolean",
        ("Was there a jury trial in CFI 1/2020?", "free_text"): "free_trick", ("What of case CFI one?", "free_text"): "free_case", ("What of sct 1/2020?", "free_text"): "free_case", ("What of injury?", "free_text"): "free_law",
    }
    df = spark.createDataFrame([(*k, v) for k, v in want.items()], "q string, a string, want string").withColumn("got", T.prompt_kind(F.col("q"), F.col("a")))
    assert [(r.q, r.got) for r in df.collect()] == [(r.q, r.want) for r in df.collect()]


def test_overridden(spark):
    answers, fixes = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "qid long, value string"), spark.createDataFrame([(1, "x"), (3, None), (9, "y")], "qid long, fixed string")
    assert {tuple(r) for r in C.overridden(answers, fixes, "value", "fixed").collect()} == {(1, "x", True), (2, None, False), (3, None, True)}


def test_keyword_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Fine words"), (1, 2, "fine print of words and duties"), (1, 3, "nothing"), (1, 4, "words, FINE"), (2, 1, None)], "doc_id long, page int, text string")
    asked = spark.createDataFrame([(1, 1, ["fine", "words", "duties"]), (2, 2, ["fine"]), (3, 1, [])], "qid long, doc_id long, kw array<string>")
    assert {tuple(r) for r in G.keyword_pages(asked, pages, 2).collect()} == {(1, 1, 2, 3), (1, 1, 1, 2)}


def test_dense_group_max(spark):
    rng = np.random.default_rng(5)
    vectors, asked = rng.standard_normal((300, 6)), rng.standard_normal((7, 6))
    place = [(None if i % 11 == 0 else i % 4, i % 3) for i in range(300)]
    units = spark.createDataFrame([(*p, v.tolist()) for p, v in zip(place, vectors)] + [(1, 1, None), (9, 9, [None] * 6)], "doc_id long, page int, v array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(50, None)], "qid long, v array<float>")
    f = lambda x: x.astype("f4").astype(float)
    want = {}
    for q, row in enumerate(f(asked) @ f(vectors).T):
        for p, s in zip(place, row):
            want[(q, *p)] = max(want.get((q, *p), -np.inf), s)
    for block in (2_000, 3):
        got = {(r.qid, r.doc_id, r.page): r.score for r in R.dense_group_max(queries, units, "qid", ("doc_id", "page"), "v", block).collect()}
        assert got == pytest.approx(want)
    assert R.dense_group_max(queries.where("false"), units, "qid", ("doc_id", "page"), "v").count() == 0
    assert R.dense_group_max(queries, units.where("false"), "qid", ("doc_id", "page"), "v").count() == 0


def test_entity_sentences(spark):
    text = "Short Article 7. The ARTICLE 7 of this law applies; nothing is said here of it.  No law of that kind here"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, None), (1, 3, "")], "doc_id long, page int, text string")
    entities = spark.createDataFrame([(1, 1, "Article 7"), (1, 1, "law"), (1, 1, None), (1, 2, "law"), (1, 3, "law"), (2, 1, "law")], "doc_id long, page int, entity string")
    got = {(r.entity, r.sentence) for r in D.entity_sentences(pages, entities).collect()}
    assert got == {("Article 7", "The ARTICLE 7 of this law applies;"), ("law", "The ARTICLE 7 of this law applies;"), ("law", "No law of that kind here")}


def test_a_question_of_many_is_looked_at_once(spark, monkeypatch):
    """Equal questions and equal titles are one row each when words are looked for; nulls and other cases of letters keep their answers."""
    rows, write = {}, X.written
    monkeypatch.setattr(X, "written", lambda df, name: rows.setdefault(name, write(df, name)))
    titles = spark.createDataFrame([(i, ("Leasing Law", "Employment Law", None)[i % 3]) for i in range(90)], "doc_id long, title string")
    texts = ["What of leasing?", "WHAT OF LEASING?", "Is employment regulated?", None, "Nothing at all?"]
    asked = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "qid long, question string")
    got = {r.qid: r.doc_id for r in X.law_of_question(asked, titles, spark.createDataFrame([], "doc_id long, key string, page int")).collect()}
    assert got == {i: (0, 0, 88, None, None)[i % 5] for i in range(100)}
    assert rows["asked-texts"].count() == 4 and rows["each-title"].count() == 3
