"""Queries of metrics, run statistics, evaluations and page selection."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.functions import answers as A
from corpusmill.operators import evaluation as E
from corpusmill.operators.retrieval import reranked, top_k
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval_queries import _DOC_UNITS, _duck_bm25, _ranked, best_scores, word_shares, words_sql

# -- runs


# Prices of a million tokens.
INPUT_PRICE, OUTPUT_PRICE = 3.0, 15.0


@query(f"""WITH levels AS (SELECT false AS overall, answer_type, * EXCLUDE (answer_type) FROM fx_runs UNION ALL SELECT true, NULL, * EXCLUDE (answer_type) FROM fx_runs),
k AS (SELECT overall, answer_type, ttft_ms AS v, row_number() OVER (PARTITION BY overall, answer_type ORDER BY ttft_ms) - 1 AS i, count(*) OVER (PARTITION BY overall, answer_type) AS n FROM levels WHERE ttft_ms > 0),
q AS (SELECT overall, answer_type, max(CASE WHEN i = n // 2 THEN v END) AS p50, max(CASE WHEN i = least(floor(0.95 * n)::BIGINT, n - 1) THEN v END) AS p95 FROM k GROUP BY ALL)
SELECT l.*, p50, p95 FROM (SELECT overall, answer_type, count(*) AS n, count_if(answer IS NULL)::BIGINT AS nulls, round(avg(n_pages), 6) AS pages_per_question, count_if(n_pages = 0)::BIGINT AS without_pages, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  round(avg(CASE WHEN ttft_ms > 0 THEN ttft_ms END), 6) AS mean, max(CASE WHEN ttft_ms > 0 THEN ttft_ms END) AS top, round((sum(input_tokens) * {INPUT_PRICE} + sum(output_tokens) * {OUTPUT_PRICE}) / 1000000, 6) AS cost FROM levels GROUP BY overall, answer_type) l LEFT JOIN q ON q.overall = l.overall AND q.answer_type IS NOT DISTINCT FROM l.answer_type""")
def run_stats(t: Inputs) -> DataFrame:
    """Statistics of a run by type of answer and in all: nulls, pages, times, tokens, cost."""
    found = E.run_statistics(t.fx("runs"), "answer_type", "ttft_ms", {"p50": 0.5, "p95": 0.95}, INPUT_PRICE, OUTPUT_PRICE)
    return found.withColumns({c: F.round(c, 6) for c in ("pages_per_question", "mean", "cost")})


@query("SELECT model_name, count(*) AS n, round(avg(ttft_ms), 6) AS mean, max(ttft_ms) AS top FROM fx_runs GROUP BY model_name")
def fast_stats(t: Inputs) -> DataFrame:
    return t.fx("runs").groupBy("model_name").agg(F.count("*").alias("n"), F.round(F.avg("ttft_ms"), 6).alias("mean"), F.max("ttft_ms").alias("top"))


@query("SELECT answer_type, count_if(n_pages > 1)::BIGINT AS hits, count_if(n_pages = 1)::BIGINT AS misses, count(*) AS total FROM fx_runs GROUP BY answer_type")
def router_hits(t: Inputs) -> DataFrame:
    return t.fx("runs").groupBy("answer_type").agg(F.count_if(F.col("n_pages") > 1).alias("hits"), F.count_if(F.col("n_pages") == 1).alias("misses"), F.count("*").alias("total"))


@query("SELECT model_name AS stage, count_if(n_pages > 1)::BIGINT AS hits, count_if(n_pages = 1)::BIGINT AS misses, CASE WHEN count_if(n_pages > 0) > 0 THEN round(count_if(n_pages > 1) / count_if(n_pages > 0), 4) END AS hit_rate FROM fx_runs GROUP BY model_name")
def stage_summary(t: Inputs) -> DataFrame:
    hits, misses = F.count_if(F.col("n_pages") > 1), F.count_if(F.col("n_pages") == 1)
    return t.fx("runs").groupBy(F.col("model_name").alias("stage")).agg(hits.alias("hits"), misses.alias("misses"), F.round(F.try_divide(hits, hits + misses), 4).alias("hit_rate"))


# -- three-class labels

_LABELS = """WITH n AS (SELECT false AS overall, hyp_key, gold, prediction FROM fx_nli UNION ALL SELECT true, NULL, gold, prediction FROM fx_nli),
l AS (SELECT overall, hyp_key, gold AS label, 1 AS support, 0 AS claimed, (gold = prediction)::INT AS tp FROM n UNION ALL SELECT overall, hyp_key, prediction, 0, 1, 0 FROM n),
m AS (SELECT overall, hyp_key, label, sum(support)::BIGINT AS support, sum(claimed) AS claimed, sum(tp)::DOUBLE AS tp FROM l GROUP BY ALL),
f AS (SELECT overall, hyp_key, label, coalesce(tp / nullif(claimed, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(claimed + support, 0), 0) AS f1, support, tp FROM m)"""


def _nli_metrics(t: Inputs) -> DataFrame:
    return E.class_metrics(t.fx("nli"), "gold", "prediction", "hyp_key")


@query(_LABELS + " SELECT overall, hyp_key, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def nli_metrics(t: Inputs) -> DataFrame:
    """Precision, recall and F1 of each label, for every hypothesis and in all."""
    r6 = lambda c: F.round(c, 6).alias(c)
    return _nli_metrics(t).select("overall", "hyp_key", "label", r6("precision"), r6("recall"), r6("f1"), "support")


@query(_LABELS + " SELECT overall, hyp_key, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN f1 END), 6) AS macro_f1 FROM f GROUP BY overall, hyp_key")
def nli_summary(t: Inputs) -> DataFrame:
    """Accuracy and macro F1 for every hypothesis and in all."""
    return E.class_summary(_nli_metrics(t), "hyp_key").withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


@query("SELECT hyp_key, gold, count_if(prediction = 'entailment')::BIGINT AS entailment, count_if(prediction = 'contradiction')::BIGINT AS contradiction, count_if(prediction = 'not_mentioned')::BIGINT AS not_mentioned FROM fx_nli GROUP BY ALL")
def confusion(t: Inputs) -> DataFrame:
    return t.fx("nli").groupBy("hyp_key", "gold").pivot("prediction", ["entailment", "contradiction", "not_mentioned"]).count().na.fill(0)


@query("SELECT d.doc_id, h.lang AS hyp, CASE WHEN l.quality IS NULL THEN 'not_mentioned' WHEN l.quality = 1 THEN 'entailment' ELSE 'contradiction' END AS gold FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) h LEFT JOIN labels l USING (doc_id)")
def nli_pairs(t: Inputs) -> DataFrame:
    """Every document with every hypothesis of a stated set."""
    docs = t.table("documents")
    hypotheses = docs.where("lang is not null").select(F.col("lang").alias("hyp")).distinct()
    gold = F.when(F.col("quality").isNull(), "not_mentioned").when(F.col("quality") == 1, "entailment").otherwise("contradiction")
    labelled = docs.select("doc_id").join(t.table("labels"), "doc_id", "left").select("doc_id", gold.alias("gold"))
    return E.with_every(labelled, hypotheses).select("doc_id", "hyp", "gold")


#: What a model may say, by document modulo 7, and the label it means.
_SAID = [
    ("thinking of contradiction\nEntailment.", "entailment"), ("entailment?\nCONTRADICTION", "contradiction"), ("entailment\nNotMentioned", "not_mentioned"), ("Contradiction\nso it is", "contradiction"),
    ("entailment or contradiction\ndone", "entailment"), ("not mentioned, no entailment\ndone", "not_mentioned"), ("unclear", "not_mentioned"),
]


@query("SELECT doc_id, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{label}'" for i, (_, label) in enumerate(_SAID)) + " END AS label FROM documents")
def nli_label(t: Inputs) -> DataFrame:
    """The label of a model's answer."""
    said = F.element_at(F.array(*[F.lit(x) for x, _ in _SAID]), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.table("documents").select("doc_id", A.nli_label(said).alias("label"))


# -- spans

_CHARS = "WITH c AS (SELECT DISTINCT qid, file, kind, unnest(range(span_start, span_end)) AS c FROM fx_spans), k AS (SELECT qid, file, c, bool_or(kind = 'pred') AS p, bool_or(kind = 'gold') AS g FROM c GROUP BY ALL)"


@query(_CHARS + " SELECT qid, round(coalesce(count_if(p AND g) / nullif(count_if(p), 0), 0), 6) AS precision, round(coalesce(count_if(p AND g) / nullif(count_if(g), 0), 0), 6) AS recall FROM k GROUP BY qid")
def char_overlap(t: Inputs) -> DataFrame:
    """Precision and recall over characters: spans are merged and overlaps measured, no character becomes a row."""
    found = E.char_overlap(t.fx("spans"), "qid", "file", "kind", "span_start", "span_end")
    return found.select("qid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_CHARS + """, e AS (SELECT qid, coalesce(count_if(p AND g) / nullif(count_if(p), 0), 0) AS p, coalesce(count_if(p AND g) / nullif(count_if(g), 0), 0) AS r FROM k GROUP BY qid)
SELECT count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM e""")
def char_overlap_macro(t: Inputs) -> DataFrame:
    """Precision, recall and F1 over characters, averaged over queries."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    six = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return E.char_overlap(t.fx("spans"), "qid", "file", "kind", "span_start", "span_end").agg(F.count("*").alias("n"), six(p, "precision"), six(r, "recall"), six(f1, "f1"))


@query("SELECT qid, kind, span_start AS s, span_end AS e FROM fx_spans")
def parse_spans(t: Inputs) -> DataFrame:
    """Spans written as ``[s, e]`` or as objects."""
    text = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("["), F.col("span_start").cast("string"), F.lit(", "), F.col("span_end").cast("string"), F.lit("]"))).otherwise(F.to_json(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"))))
    pair, named = F.from_json(text, "array<int>"), F.from_json(text, "start int, end int")
    return t.fx("spans").select("qid", "kind", F.coalesce(F.get(pair, F.lit(0)), named["start"]).alias("s"), F.coalesce(F.get(pair, F.lit(1)), named["end"]).alias("e"))


# -- answers against references


@query(r"""WITH s AS (SELECT item_id, list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '') AS s, list_distinct(regexp_extract_all(lower(left(text, length(text) // 2)), '[\p{L}\p{N}_]+')) AS ctx FROM benchmark),
k AS (SELECT item_id, list_transform(s, lambda x: len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')), ctx)) * 2 >= len(list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')))) AS ok FROM s)
SELECT item_id, round(len(list_filter(ok, lambda x: x)) / len(ok), 6) AS score FROM k WHERE len(ok) > 0""")
def groundedness(t: Inputs) -> DataFrame:
    """Share of sentences half of whose words stand in the context, here the first half of the text."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    items = t.table("benchmark").select("item_id", F.filter(F.split("text", "[.!?]+"), lambda x: F.trim(x) != "").alias("s"), words(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).alias("ctx"))
    ok = F.filter("s", lambda x: F.size(F.array_intersect(words(x), F.col("ctx"))) * 2 >= F.size(words(x)))
    return items.where(F.size("s") > 0).select("item_id", F.round(F.size(ok) / F.size("s"), 6).alias("score"))


@query()
def rouge_l(t: Inputs) -> DataFrame:
    """F-measure of matching blocks of words of neighbouring benchmark items, as difflib finds them."""

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = x.split(), y.split()
            n = sum(m.size for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks())
            return 2 * n / (len(x) + len(y)) if x and y and n else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    items = t.table("benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(after, "item_id").select("item_id", score("text", "other").alias("score"))


@query("""WITH k AS (SELECT qid, answer_type, row_number() OVER (PARTITION BY answer_type ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY answer_type) AS n FROM fx_runs)
SELECT qid, answer_type FROM k WHERE i > 0 AND i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) <= 4""")
def stratified_pick(t: Inputs) -> DataFrame:
    """Four questions of each type at even steps."""
    w = Window.partitionBy("answer_type")
    k = t.fx("runs").select("qid", "answer_type", (F.row_number().over(w.orderBy("qid")) - 1).alias("i"), F.count("*").over(w).alias("n")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    return k.where("i > 0 and i % step = 0 and floor(i / step) <= 4").select("qid", "answer_type")


@query("SELECT qid FROM fx_runs ORDER BY md5(qid::VARCHAR || '-42'), qid LIMIT 10")
def sample_n(t: Inputs) -> DataFrame:
    """A fixed random sample of ten runs, the same at any partitioning."""
    return t.fx("runs").select("qid").orderBy(F.md5(F.concat(F.col("qid").cast("string"), F.lit("-42")).cast("binary")), "qid").limit(10)


@query(r"SELECT item_id, '[P1] ' || text || chr(10) || '[P2] ' || replace(text, ' ', '_') AS prompt FROM benchmark")
def passage_prompt(t: Inputs) -> DataFrame:
    passages = F.array(F.col("text"), F.replace("text", F.lit(" "), F.lit("_")))
    lines = F.transform(passages, lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("] "), p))
    return t.table("benchmark").select("item_id", F.concat_ws("\n", lines).alias("prompt"))


# -- page selection: lines of an order stand for scored pages of documents

_SCORED = "SELECT l_orderkey AS qid, l_suppkey % 5 AS doc, l_linenumber AS page, max(l_discount) * 10 AS score FROM lineitem GROUP BY ALL"


def _scored(t: Inputs) -> DataFrame:
    return t.table("lineitem").groupBy(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") % 5).alias("doc"), F.col("l_linenumber").alias("page")).agg((F.max("l_discount") * 10).alias("score"))


def _r(c="score"):
    return F.round(c, 6).alias("score")


@query("""WITH c AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM fx_pages), n AS (SELECT doc_id FROM fx_pages GROUP BY doc_id HAVING count(DISTINCT page) <= 8)
SELECT doc_id, page, 1.0::DOUBLE AS score, md5(arg_max(chunk, length(chunk) * 1000 - pos)) AS digest FROM c JOIN n USING (doc_id) GROUP BY doc_id, page""")
def small_doc_pages(t: Inputs) -> DataFrame:
    """All pages of documents of up to eight, each with the text of its longest chunk (here a line; the first of equal ones)."""
    chunks = t.fx("pages").select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "chunk"))
    small = chunks.groupBy("doc_id").agg(F.count_distinct("page").alias("n")).where("n <= 8").select("doc_id")
    longest = F.max_by("chunk", F.struct(F.length("chunk"), -F.col("pos")))
    pages = chunks.join(small, "doc_id", "left_semi").groupBy("doc_id", "page").agg(longest.alias("text"))
    return pages.select("doc_id", "page", F.lit(1.0).alias("score"), F.md5(F.col("text").cast("binary")).alias("digest"))


_CANDIDATES = "SELECT l_orderkey // 100 AS qid, l_suppkey % 20 AS doc, l_linenumber AS page, l_partkey AS chunk, max(l_discount) AS dense, max(l_quantity) AS ce FROM lineitem GROUP BY ALL"


@query(f"WITH s AS ({_CANDIDATES}), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc, page, chunk) AS n FROM s) SELECT qid, doc, page, round(max(ce), 6) AS score FROM k WHERE n <= 50 GROUP BY ALL")
def prefilter50(t: Inputs) -> DataFrame:
    """Page scores by the second scorer, of the fifty candidates that the first one likes best."""
    keys = [F.expr("l_orderkey div 100").alias("qid"), (F.col("l_suppkey") % 20).alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("chunk")]
    every = t.table("lineitem").groupBy(*keys).agg(F.max("l_discount").alias("dense"), F.max("l_quantity").alias("ce"))
    top = top_k(every, ["qid"], [F.col("dense").desc(), F.col("doc"), F.col("page"), F.col("chunk")], 50, "n")
    return top.groupBy("qid", "doc", "page").agg(F.max("ce").alias("score")).select("qid", "doc", "page", _r())


@query(f"WITH s AS ({_SCORED}) SELECT qid, doc, page FROM s QUALIFY max(score) OVER (PARTITION BY qid, doc) >= 0.10")
def doc_floor(t: Inputs) -> DataFrame:
    return _scored(t).withColumn("best", F.max("score").over(Window.partitionBy("qid", "doc"))).where("best >= 0.10").select("qid", "doc", "page")


# How close to a document's best page another must come, by type of answer; 0.6 for any other.
GAPS = {"number": 0.80, "name": 0.80, "names": 0.80, "boolean": 0.65, "date": 0.75}
_TYPE = "CASE qid % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'name' WHEN 2 THEN 'names' WHEN 3 THEN 'boolean' WHEN 4 THEN 'date' ELSE 'free_text' END"


@query(f"""WITH s AS (SELECT *, {_TYPE} AS kind, row_number() OVER w AS n, first_value(score) OVER w AS top FROM ({_SCORED}) WINDOW w AS (PARTITION BY qid, doc ORDER BY score DESC, page))
SELECT qid, doc, page FROM s WHERE n <= 2 AND (top <= 0 OR score / top >= CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in GAPS.items())} ELSE 0.6 END)""")
def gap_pages(t: Inputs) -> DataFrame:
    """Up to two pages of a document, those that come close enough to its best one for the type of answer."""
    w = Window.partitionBy("qid", "doc").orderBy(F.col("score").desc(), "page")
    s = _scored(t).withColumns({"kind": F.expr(_TYPE), "n": F.row_number().over(w), "top": F.first("score").over(w)})
    gap = F.lit(0.6)
    for kind, value in GAPS.items():
        gap = F.when(F.col("kind") == kind, value).otherwise(gap)
    return s.where((F.col("n") <= 2) & ((F.col("top") <= 0) | (F.try_divide("score", "top") >= gap))).select("qid", "doc", "page")


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, page) AS n FROM ({_SCORED})), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (n = 1) DESC, CASE WHEN n = 1 THEN doc END, score DESC, doc, page) AS pos FROM s)
SELECT qid, doc, page, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, page) AS position FROM k WHERE pos <= 3""")
def fair_select(t: Inputs) -> DataFrame:
    """The best page of each case first, in order of cases, then by score, three in all; these by score."""
    w = Window.partitionBy("qid", "doc").orderBy(F.col("score").desc(), "page")
    ranked = _scored(t).withColumn("n", F.row_number().over(w))
    order = [(F.col("n") == 1).desc(), F.when(F.col("n") == 1, F.col("doc")).asc_nulls_last(), F.col("score").desc(), F.col("doc"), F.col("page")]
    chosen = top_k(ranked, ["qid"], order, 3, "pos")
    last = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc", "page")
    return chosen.select("qid", "doc", "page", F.row_number().over(last).cast("long").alias("position"))


#: Characters of a document that the second scorer reads, where a query does not have it read all of them.
READ = 2000


def reranked_sql(chars: int | None = READ) -> str:
    """CTEs up to ``shares`` (qid, unit, before, few, share) and ``reranked`` (qid, unit, before, rank) of the benchmark's texts, over whole documents or their first ``chars`` characters."""
    return "WITH " + _duck_bm25(_DOC_UNITS) + f""", top AS ({_ranked('scored', 10)}), shares AS (SELECT t.qid, t.unit, t.rank AS before, count(*) OVER (PARTITION BY t.qid) <= 3 AS few,
 len(list_intersect({words_sql('b.text')}, {words_sql(f'left(d.text, {chars})' if chars else 'd.text')}))::DOUBLE / greatest(1, len({words_sql('b.text')})) AS share FROM top t JOIN benchmark b ON b.item_id = t.qid JOIN documents d ON d.doc_id = t.unit),
reranked AS (SELECT qid, unit, before, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN few THEN 0 ELSE -round(share, 9) END, before) AS rank FROM shares)"""


RERANKED = reranked_sql()


def shared_words(t: Inputs, chars: int | None = READ) -> DataFrame:
    """(qid, unit, before, score): the best ten documents of each benchmark text and the share of its words in them, or in their first ``chars`` characters, a stand-in for a scorer."""
    top = best_scores(t, 10, rank="before").select("qid", "unit", "before")
    return t.once(f"shared_words_{chars}", lambda: word_shares(t, top, chars).withColumnRenamed("share", "score"))


@query(RERANKED + " SELECT qid, unit, rank FROM reranked WHERE rank <= 3")
def rerank_topk(t: Inputs) -> DataFrame:
    """The best three of ten candidates by the second scorer; up to three candidates stay in their order."""
    return reranked(shared_words(t), "qid", "before", 3).select("qid", "unit", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH s AS ({_SCORED}), best AS (SELECT qid, doc, page FROM s QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, page) = 1),
chosen AS (SELECT qid, doc, page, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, page) AS pos FROM s QUALIFY pos <= 2),
missing AS (SELECT qid, max_by(doc, doc) AS doc, max_by(page, doc) AS page FROM best b WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.qid = b.qid AND c.doc = b.doc) GROUP BY qid)
SELECT c.qid, c.pos::INT AS pos, CASE WHEN c.pos = 2 AND m.doc IS NOT NULL THEN m.doc ELSE c.doc END AS doc, CASE WHEN c.pos = 2 AND m.doc IS NOT NULL THEN m.page ELSE c.page END AS page FROM chosen c LEFT JOIN missing m USING (qid)""")
def doc_rescue(t: Inputs) -> DataFrame:
    """The best page of the last document that the selection misses takes the last place."""
    best = top_k(_scored(t), ["qid", "doc"], [F.col("score").desc(), F.col("page")], 1, "n")
    chosen = top_k(_scored(t), ["qid"], [F.col("score").desc(), F.col("doc"), F.col("page")], 2, "pos")
    missing = best.join(chosen.select("qid", "doc"), ["qid", "doc"], "left_anti").groupBy("qid").agg(F.max_by(F.struct("doc", "page"), "doc").alias("m"))
    swapped = chosen.join(missing, "qid", "left").withColumn("swap", (F.col("pos") == 2) & F.col("m").isNotNull())
    return swapped.select("qid", "pos", F.when(F.col("swap"), F.col("m.doc")).otherwise(F.col("doc")).alias("doc"), F.when(F.col("swap"), F.col("m.page")).otherwise(F.col("page")).alias("page"))
