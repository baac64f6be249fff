"""Queries that hold retrieval and answers against gold: benchmark texts are questions, documents that hold such a text are its gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators.matching import containing
from corpusmill.operators.retrieval import reranked
from corpusmill.plans.evaluation_queries import RERANKED, reranked_sql, shared_words
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval_queries import _PAGE_UNITS, _duck_bm25, _ranked, best_scores


def _questions(t: Inputs) -> DataFrame:
    return t.table("benchmark").select(F.col("item_id").alias("qid"))


def _gold(t: Inputs) -> DataFrame:
    """(qid, unit): documents that hold a benchmark text."""
    return t.once("gold_documents", lambda: t.fx("queries").where("gold_doc_id is not null").select("qid", F.col("gold_doc_id").alias("unit")))


_HITS = RERANKED + """, gold AS (SELECT DISTINCT qid, gold_doc_id AS unit FROM fx_queries WHERE gold_doc_id IS NOT NULL),
hits AS (SELECT g.qid, bool_or(r.unit IS NOT NULL) AS had, coalesce(bool_or(r.rank <= 3), false) AS hit FROM gold g LEFT JOIN reranked r ON r.qid = g.qid AND r.unit = g.unit GROUP BY g.qid)"""


@query(_HITS + " SELECT item_id AS qid, had AS hit FROM benchmark LEFT JOIN hits ON qid = item_id")
def recall_at_k(t: Inputs) -> DataFrame:
    """Whether any gold document of a question is among the first ten; null without gold."""
    return E.found_gold(_questions(t), _gold(t), shared_words(t))


@query(_HITS + " SELECT item_id AS qid, hit, had AND NOT hit AS dropped FROM benchmark LEFT JOIN hits ON qid = item_id")
def rerank_drops(t: Inputs) -> DataFrame:
    """Whether the second scorer keeps a gold document among three of ten, and whether it loses all of them."""
    before = shared_words(t)
    return E.reranked_gold(_questions(t), _gold(t), before, reranked(before, "qid", "before", 3))


@query(_HITS + """, h AS (SELECT had, hit FROM benchmark LEFT JOIN hits ON qid = item_id)
SELECT 'retrieval_recall@10' AS stage, count(*) AS total, count_if(had)::BIGINT AS hits, count_if(NOT had)::BIGINT AS misses, 0::BIGINT AS drops, round(count_if(had) / nullif(count_if(had IS NOT NULL), 0), 4) AS hit_rate FROM h
UNION ALL SELECT 'reranker', count(*), count_if(hit), count_if(NOT hit), count_if(had AND NOT hit), round(count_if(hit) / nullif(count_if(hit IS NOT NULL), 0), 4) FROM h""")
def stage_recall(t: Inputs) -> DataFrame:
    """Hits, misses and losses of the two stages; questions without gold count in the total only."""
    stages = [("retrieval_recall@10", recall_at_k(t).withColumn("dropped", F.lit(False))), ("reranker", rerank_drops(t))]
    rows = [df.select(F.lit(name).alias("stage"), "hit", "dropped") for name, df in stages]
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    rate = F.round(F.try_divide(hits, hits + misses), 4)
    return rows[0].unionByName(rows[1]).groupBy("stage").agg(F.count("*").alias("total"), hits.alias("hits"), misses.alias("misses"), F.count_if("dropped").alias("drops"), rate.alias("hit_rate"))


@query(reranked_sql(None) + """, gold AS (SELECT qid, min(gold_doc_id) AS unit FROM fx_queries WHERE gold_doc_id IS NOT NULL GROUP BY qid)
SELECT qid, CASE WHEN EXISTS (SELECT 1 FROM reranked r WHERE r.qid = g.qid AND r.unit = g.unit AND r.rank <= 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM gold g""")
def retrieval_accuracy(t: Inputs) -> DataFrame:
    """One where the question's one gold document, its first, is among the three that the second scorer keeps; it reads whole documents."""
    first = _gold(t).groupBy("qid").agg(F.min("unit").alias("unit"))
    hits = E.found_gold(first.select("qid"), first, reranked(shared_words(t, None), "qid", "before", 3))
    return hits.select("qid", F.col("hit").cast("double").alias("accuracy"))


# -- answers that cite passages

#: A passage with this share of the question's words is cited; an answer declines where none reaches the other.
CITES, DECLINES = 0.9, 0.6
_DECLINED = "I cannot answer based on the provided passages."
_JUDGED = RERANKED + f""", passages AS (SELECT s.qid, s.before AS n, s.share, EXISTS (SELECT 1 FROM fx_queries q WHERE q.qid = s.qid AND q.gold_doc_id = s.unit) AS relevant FROM shares s WHERE s.before <= 5),
judged AS (SELECT qid, list(relevant ORDER BY n) AS relevant, CASE WHEN max(share) < {DECLINES} THEN '{_DECLINED}' ELSE 'It says so' || coalesce(string_agg(CASE WHEN share >= {CITES} THEN ' [P' || n || ']' END, '' ORDER BY n), '') || '.' END AS response FROM passages GROUP BY qid),
sides AS (SELECT qid, list_filter(range(1, len(relevant) + 1), lambda i: relevant[i]) AS g, list_distinct(list_transform(regexp_extract_all(response, '\\[P(\\d+)\\]', 1), lambda x: x::BIGINT)) AS p, contains(response, 'cannot answer') AS deflected FROM judged),
pairs AS (SELECT *, len(list_intersect(g, p))::DOUBLE AS same, len(g) + len(p) = 0 AS none FROM sides),
scores AS (SELECT qid, len(g) > 0 AS has_relevant, deflected, len(p)::INT AS n_cited, CASE WHEN none THEN 1 ELSE coalesce(same / nullif(len(p), 0), 0) END AS precision, CASE WHEN none THEN 1 ELSE coalesce(same / nullif(len(g), 0), 0) END AS recall,
  CASE WHEN none THEN 1 ELSE coalesce(2 * same / nullif(len(p) + len(g), 0), 0) END AS f1, CASE WHEN len(g) = 0 THEN deflected::INT::DOUBLE WHEN deflected OR len(p) = 0 THEN 0 ELSE same / len(p) END AS raf FROM pairs)"""


def _judged(t: Inputs) -> DataFrame:
    """(qid, response, relevant): a reply to each benchmark text that cites some of its five passages or declines, and which of them are gold."""
    gold = _gold(t).withColumn("relevant", F.lit(True))
    passages = shared_words(t).where("before <= 5").join(gold, ["qid", "unit"], "left").select("qid", F.struct(F.col("before").alias("n"), "score", F.coalesce("relevant", F.lit(False)).alias("relevant")).alias("p"))
    five = passages.groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max("p.score").alias("top"))
    marks = F.array_join(F.transform(F.filter("ps", lambda p: p["score"] >= CITES), lambda p: F.concat(F.lit(" [P"), p["n"].cast("string"), F.lit("]"))), "")
    response = F.when(F.col("top") < DECLINES, _DECLINED).otherwise(F.concat(F.lit("It says so"), marks, F.lit(".")))
    return five.select("qid", response.alias("response"), F.transform("ps", lambda p: p["relevant"]).alias("relevant"))


def _six(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


@query(_JUDGED + " SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores")
def attribution_prf(t: Inputs) -> DataFrame:
    """Precision, recall and F1 of the passages that a reply cites."""
    return E.relevant_citations(_judged(t)).select("qid", *_six("precision", "recall", "f1"))


@query(_JUDGED + " SELECT qid, has_relevant, deflected, n_cited, round(raf, 6) AS raf FROM scores")
def raf(t: Inputs) -> DataFrame:
    """Share of relevant citations; a question without relevant passages scores one for declining, any other nothing."""
    return E.relevant_citations(_judged(t)).select("qid", "has_relevant", "deflected", "n_cited", *_six("raf"))


@query(_JUDGED + """ SELECT count(*) AS n, count_if(has_relevant)::BIGINT AS with_relevant, round(avg(raf), 6) AS raf, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
 round(coalesce(avg((n_cited > 0 AND NOT deflected)::INT) FILTER (has_relevant), 0), 6) AS eligibility, round(coalesce(avg(deflected::INT) FILTER (NOT has_relevant), 0), 6) AS true_rate, round(coalesce(avg(deflected::INT) FILTER (has_relevant), 0), 6) AS false_rate FROM scores""")
def garage_summary(t: Inputs) -> DataFrame:
    """Means over all replies: citations, eligibility, and how often a reply declines with and without relevant passages."""
    return E.citation_summary(E.relevant_citations(_judged(t))).select("n", "with_relevant", *_six("raf", "precision", "recall", "f1", "eligibility", "true_rate", "false_rate"))


@query(_JUDGED + " SELECT qid, array_to_string(list_transform(range(1, 9), lambda i: coalesce(relevant[i], false)), '|') AS gold FROM judged")
def gold_labels(t: Inputs) -> DataFrame:
    """Whether each of eight passages is relevant; passages without a label are not."""
    return _judged(t).select("qid", F.array_join(F.transform(E.padded(F.col("relevant"), 8), lambda x: x.cast("string")), "|").alias("gold"))


# -- the score of a run

_PAGES = "WITH " + _duck_bm25(_PAGE_UNITS) + f""", gold AS (SELECT item_id AS qid, list(unit ORDER BY unit) AS gold FROM benchmark b JOIN units u ON contains(u.text, b.text) GROUP BY item_id),
pred AS (SELECT qid, list(unit ORDER BY unit) AS pred FROM ({_ranked('scored', 3)}) GROUP BY qid),
sides AS (SELECT qid, pred, gold, len(list_intersect(gold, pred))::DOUBLE AS s FROM gold LEFT JOIN pred USING (qid)),
f AS (SELECT qid, CASE WHEN s > 0 THEN 7.25 * (s / len(pred)) * (s / len(gold)) / (6.25 * s / len(pred) + s / len(gold)) ELSE 0 END AS f FROM sides)"""


def _grounding(t: Inputs) -> DataFrame:
    """(qid, f): how well the three best pages of a benchmark text agree with the pages that hold it."""
    items = t.table("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    pages = t.fx("pages").select(F.struct("doc_id", "page").alias("unit"), "text")
    gold = containing(pages, items, "unit", "text", "qid", "query").groupBy("qid").agg(F.collect_list("unit").alias("gold"))
    best = best_scores(t, 3, "pages").groupBy("qid").agg(F.collect_list("unit").alias("pred"))
    empty = F.slice("gold", 1, 0)
    precision, recall, _ = E.precision_recall(F.coalesce("pred", empty), F.col("gold"))
    return t.once("grounding", lambda: gold.join(best, "qid", "left").select("qid", E.f_beta(precision, recall).alias("f")))


@query(_PAGES + " SELECT qid, round(f, 6) AS f FROM f")
def fbeta_pages(t: Inputs) -> DataFrame:
    """F-beta of cited pages against gold pages, recall weighing 6.25 times as much."""
    return _grounding(t).select("qid", F.round("f", 6).alias("f"))


_GRADED = """SELECT r.qid, r.answer_type, CASE r.answer_type WHEN 'free_text' THEN r.n_pages / 5.0 ELSE CASE WHEN r.answer = 'true' THEN 1.0 ELSE 0.0 END END AS quality, CASE WHEN r.n_pages = 1 THEN 1.0 WHEN r.n_pages > 1 THEN 0.8 ELSE 0.0 END AS grounding,
 CASE WHEN r.ttft_ms >= 1 AND r.total_time_ms >= r.ttft_ms AND r.output_tokens > 0 THEN 1.0 ELSE 0.0 END AS telemetry, CASE WHEN r.ttft_ms < 5 THEN 1.05 WHEN r.ttft_ms < 20 THEN 1.0 ELSE 0.85 END AS speed FROM {runs} r"""
_PARTS = "SELECT coalesce(avg(quality) FILTER (answer_type <> 'free_text'), 0) AS e, coalesce(avg(quality) FILTER (answer_type = 'free_text'), 0) AS f, avg(grounding) AS g, avg(telemetry) AS t, avg(speed) AS s FROM graded"


@query("WITH graded AS (" + _GRADED.replace("{runs}", "fx_runs") + f") SELECT round(e, 6) AS exact, round(f, 6) AS free, round(g, 6) AS grounding, round(t, 6) AS telemetry, round(s, 6) AS speed, round(({E.EXACT} * e + {E.FREE} * f) * g * t * s, 6) AS total FROM ({_PARTS})")
def total_score(t: Inputs) -> DataFrame:
    """The score of a run: weighted quality of exact and free answers, times grounding, telemetry and speed."""
    graded = t.sql(_GRADED.replace("{runs}", "{fx_runs}"))
    return E.total_score(graded).select(*_six("exact", "free", "grounding", "telemetry", "speed", "total"))
