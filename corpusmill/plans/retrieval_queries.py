"""Queries of lexical, dense and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.operators import retrieval as R
from corpusmill.operators.lexical import LexicalIndex, TextIndex
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query
from corpusmill.storage import written

_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{P.WORD}'), lambda w: w NOT IN ({_STOP}))"


_ARTICLE_TOKENS = "['article_' || m.a] || CASE WHEN m.s <> '' THEN ['article_' || m.a || '_' || m.s, m.s] ELSE [] END || CASE WHEN m.u <> '' THEN ['article_' || m.a || '_' || m.s || '_' || m.u, m.u] ELSE [] END"
_REFERENCES = " || ".join(
    f"flatten(list_transform({matches}, lambda m: {tokens}))"
    for matches, tokens in (
        (f"regexp_extract_all(text, '{P.TOKEN_ENF}', ['n', 'y'])", "['enf_' || m.n || '_' || m.y, m.n, m.y]"),
        (f"list_filter(regexp_extract_all(text, '{P.TOKEN_CASE}', ['p', 'n', 'y']), lambda m: m.p <> 'ENF')", "[lower(m.p) || '_' || m.n || '_' || m.y, m.n, m.y]"),
        (f"regexp_extract_all(text, '{P.TOKEN_ARTICLE}', ['a', 's', 'u'])", _ARTICLE_TOKENS),
        (f"regexp_extract_all(text, '{P.TOKEN_LAW}', ['p', 'n', 'y'])", "[lower(m.p) || '_law_' || m.n || '_' || m.y]"),
        (f"regexp_extract_all(text, '{P.TOKEN_SCHEDULE}', 1)", "['schedule_' || lower(m)]"),
        (f"regexp_extract_all(text, '{P.TOKEN_REGULATION}', 1)", "['regulation_' || replace(m, '.', '_')] || string_split(m, '.')"),
    )
)
#: What the lexical index holds of a text: words, and references as compound tokens.
_INDEXED = f"({_TOKENS} || {_REFERENCES})"


def _duck_bm25(units: str, p: str = "", asked: str = "SELECT item_id AS qid, text FROM benchmark") -> str:
    """CTEs up to ``scored`` (qid, unit, score) over ``units`` (unit, text), their names after ``p``."""
    return f"""
{p}units AS ({units}),
{p}unit_tokens AS (SELECT unit, {_INDEXED} AS toks FROM {p}units),
{p}tf AS (SELECT unit, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT unit, len(toks) AS dl, unnest(toks) AS token FROM {p}unit_tokens) GROUP BY unit, token),
{p}totals AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avg_dl FROM {p}unit_tokens),
{p}df AS (SELECT token, count(*)::DOUBLE AS df FROM {p}tf GROUP BY token),
{p}weights AS (SELECT unit, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + {R.K1} * (1 - {R.B} + {R.B} * dl / avg_dl))) AS weight FROM {p}tf JOIN {p}df USING (token) CROSS JOIN {p}totals),
{p}asked AS (SELECT qid, token, count(*) AS times FROM (SELECT qid, unnest({_INDEXED}) AS token FROM ({asked})) GROUP BY qid, token),
{p}scored AS (SELECT qid, unit, sum(weight * times) AS score FROM {p}asked JOIN {p}weights USING (token) GROUP BY qid, unit)"""


def _ranked(source: str, k: int, unit: str = "unit", by: str = "qid") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, {unit}) AS rank FROM {source} QUALIFY rank <= {k}"


def _queries(t: Inputs) -> DataFrame:
    return t.table("benchmark").select(F.col("item_id").alias("qid"), T.index_tokens(F.col("text")).alias("toks"))


#: The indexes of this application, by folder and kind of unit: a later query reads what an earlier one has written.
_WRITTEN: dict[tuple, LexicalIndex | TextIndex] = {}


def index_of(t: Inputs, kind: str) -> LexicalIndex | TextIndex:
    """The stored index of ``documents`` (unit: doc_id), or of ``pages`` or ``statutes`` (unit: doc_id and page; many statutes have pages in common)."""
    key = t.spark.sparkContext.applicationId, t.sf_dir, kind
    if key not in _WRITTEN and kind == "statutes":
        _WRITTEN[key] = TextIndex.write(t.fx(kind), T.index_tokens, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    elif key not in _WRITTEN:
        units = _docs(t) if kind == "documents" else t.fx(kind).select(F.struct("doc_id", "page").alias("unit"), "text")
        _WRITTEN[key] = LexicalIndex.write(units.select("unit", T.index_tokens(F.col("text")).alias("toks")), "unit", "toks")
    return _WRITTEN[key]


def _scores(t: Inputs, kind: str = "documents", where: str = "true") -> DataFrame:
    """(qid, unit, score) of the benchmark's texts in one of the indexes, or in some units of it."""
    return _index(t, kind, where).search(_queries(t), "qid", "toks")


def _index(t: Inputs, kind: str, where: str) -> LexicalIndex:
    index = index_of(t, kind)
    return index if where == "true" else index.where(where)


def best_scores(t: Inputs, k: int, kind: str = "documents", where: str = "true", rank: str = "rank") -> DataFrame:
    """(qid, unit, score, rank): the ``k`` best of ``_scores`` for each benchmark text."""
    return _index(t, kind, where).best(_queries(t), "qid", "toks", k, rank)


def _docs(t: Inputs) -> DataFrame:
    return t.table("documents").select(F.col("doc_id").alias("unit"), "text")


_DOC_UNITS = "SELECT doc_id AS unit, text FROM documents"
_PAGE_UNITS = "SELECT doc_id * 1000 + page AS unit, text FROM fx_pages"


def _pages(t: Inputs) -> DataFrame:
    """Pages by document and number; the number in the SQL (1000 a document) is the same for two pages if a document has 1000 or more."""
    return t.fx("pages").select(F.struct("doc_id", "page").alias("unit"), "text", "doc_id", "page")


@query(f"SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS toks FROM documents)")
def tokenize(t: Inputs) -> DataFrame:
    toks = t.table("documents").select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", " ").cast("binary")).alias("digest"))


@query("WITH " + _duck_bm25(_PAGE_UNITS) + " SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf, round(max(weight), 6) AS max_weight FROM weights JOIN tf USING (unit, token) GROUP BY token")
def bm25_postings(t: Inputs) -> DataFrame:
    return index_of(t, "pages").weights().withColumn("max_weight", F.round("max_weight", 6))


def _topk(top: DataFrame) -> DataFrame:
    return top.select("qid", "unit", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _topk_sql(units: str, k: int = 10) -> str:
    return "WITH " + _duck_bm25(units) + f" SELECT qid, unit, round(score, 6) AS score, rank FROM ({_ranked('scored', k)})"


@query(_topk_sql(_DOC_UNITS))
def bm25_topk(t: Inputs) -> DataFrame:
    return _topk(best_scores(t, 10))


@query(_topk_sql(_PAGE_UNITS + " WHERE page = 1"))
def bm25_page1(t: Inputs) -> DataFrame:
    first = best_scores(t, 10, "pages", "unit.page = 1")
    return _topk(first.withColumn("unit", F.col("unit.doc_id") * 1000 + F.col("unit.page")))


@query(_topk_sql("SELECT doc_id AS unit, string_agg(text, chr(10) ORDER BY page) AS text FROM fx_pages GROUP BY doc_id"))
def bm25_doc(t: Inputs) -> DataFrame:
    """The pages of a document, joined by line feeds, are its text."""
    return _topk(best_scores(t, 10))


@query("WITH " + _duck_bm25(_PAGE_UNITS) + """, best AS (SELECT qid, unit // 1000 AS doc_id, max(score) AS score FROM scored GROUP BY ALL)
SELECT qid, doc_id, round(score / max(score) OVER (PARTITION BY qid), 6) AS norm FROM best""")
def bm25_doc_max_norm(t: Inputs) -> DataFrame:
    best = _scores(t, "pages").groupBy("qid", F.col("unit.doc_id").alias("doc_id")).agg(F.max("score").alias("score"))
    top = best.groupBy("qid").agg(F.max("score").alias("top"))
    return best.join(top, "qid").select("qid", "doc_id", F.round(F.col("score") / F.col("top"), 6).alias("norm"))


# -- dense

_DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE))"
_DENSE = f"""dense AS (SELECT q.vec_id AS qid, c.vec_id AS unit, c.doc_id, c.page, {_DOT} AS score FROM fx_vec q CROSS JOIN fx_vec c WHERE q.asked)"""


def _vectors(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every vector whose number is divisible by 20, and all vectors."""
    vec = t.fx("vec")
    return vec.where("asked").select(F.col("vec_id").alias("qid"), "embedding"), vec.select(F.col("vec_id").alias("unit"), "embedding")


def _nearest(t: Inputs, k: int) -> DataFrame:
    return R.dense_top_k(*_vectors(t), "qid", "unit", "embedding", k)


@query("""SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, round(v[1], 6) AS first FROM (
SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def l2_normalize(t: Inputs) -> DataFrame:
    v = t.table("embeddings").select("vec_id", R.normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(R.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(f"WITH {_DENSE} SELECT qid, unit, round(1 - score, 6) AS distance, rank FROM ({_ranked('dense', 50)})")
def dense_topk(t: Inputs) -> DataFrame:
    return _nearest(t, 50).select("qid", "unit", F.round(1 - F.col("score"), 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT l.doc_id AS qid, p.pos - 1 AS pos, v.vec_id, v.label FROM labels l CROSS JOIN (VALUES (1), (2), (3)) AS p(pos) JOIN embeddings v ON v.vec_id = [l.doc_id + 1, l.doc_id, l.doc_id * 2][p.pos]")
def fetch_by_ids(t: Inputs) -> DataFrame:
    """Vectors of the lists of ids that are asked for, with their places in the lists; ids that no vector has are left out."""
    d = F.col("doc_id")
    wanted = t.table("labels").select(d.alias("qid"), F.posexplode(F.array(d + 1, d, d * 2)).alias("pos", "vec_id"))
    return t.table("embeddings").join(wanted, "vec_id").select("qid", "pos", "vec_id", "label")


@query(f"WITH {_DENSE} SELECT qid, doc_id, page, round(max(score), 6) AS score FROM dense GROUP BY ALL")
def dense_page_max(t: Inputs) -> DataFrame:
    best = R.dense_group_max(_vectors(t)[0], t.fx("vec"), "qid", ("doc_id", "page"), "embedding")
    return best.select("qid", "doc_id", F.col("page").cast("int").alias("page"), F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT user_id % 50 AS qid, event_id % 97 AS unit, event_type, round(avg(value), 6) AS score FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, event_type ORDER BY score DESC, unit) AS rank FROM r)
SELECT qid, unit, round(sum((CASE event_type WHEN 'view' THEN 2.0 ELSE 1.0 END) / (60 + rank)), 9) AS score FROM k GROUP BY ALL""")
def rrf(t: Inputs) -> DataFrame:
    scores = t.table("events").groupBy((F.col("user_id") % 50).alias("qid"), (F.col("event_id") % 97).alias("unit"), "event_type").agg(F.round(F.avg("value"), 6).alias("score"))
    ranked = R.top_k(scores, ["qid", "event_type"], [F.col("score").desc(), F.col("unit")], 1 << 30)
    fused = R.rrf([(ranked.where("event_type = 'view'"), 2.0), (ranked.where("event_type <> 'view'"), 1.0)], "qid", "unit")
    return fused.select("qid", "unit", F.round("score", 9).alias("score"))


# Weights of the five signals of a document.
_FIVE = {"chunk": 0.10, "dense": 0.05, "dense_rrf": 0.20, "doc": 0.30, "page1": 0.30}
#: Candidates of each signal.
POOL = 200
#: The vector of benchmark item i is number 20 i, and vector d is that of document d.
_DOC_DENSE = f"SELECT q.vec_id // 20 AS qid, c.vec_id AS unit, {_DOT} AS score FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id // 20 IN (SELECT item_id FROM benchmark) AND c.vec_id IN (SELECT doc_id FROM documents)"


def _doc_nearest(t: Inputs, k: int = POOL) -> DataFrame:
    vec = t.table("embeddings")
    asked = vec.where("vec_id % 20 = 0").select(F.expr("vec_id div 20").alias("qid"), "embedding").join(t.table("benchmark").select(F.col("item_id").alias("qid")), "qid", "left_semi")
    units = vec.join(t.table("documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("unit"), "embedding")
    return R.dense_top_k(asked, units, "qid", "unit", "embedding", k)


@query("WITH " + _duck_bm25(_PAGE_UNITS, "a_") + ", " + _duck_bm25(_DOC_UNITS, "b_") + ", " + _duck_bm25(_PAGE_UNITS + " WHERE page = 1", "c_") + f""",
pool AS ({_ranked('a_scored', POOL)}), near AS ({_ranked(f'({_DOC_DENSE})', POOL)}), whole AS ({_ranked('b_scored', POOL)}), page1 AS ({_ranked('c_scored', POOL)}),
signals AS (SELECT '{'chunk'}' AS s, qid, unit // 1000 AS doc_id, max(score) AS score FROM pool GROUP BY ALL
 UNION ALL SELECT 'dense', qid, unit, score FROM near UNION ALL SELECT 'dense_rrf', qid, unit, 1.0 / (60 + rank) FROM near
 UNION ALL SELECT 'doc', qid, unit, score FROM whole UNION ALL SELECT 'page1', qid, unit // 1000, score FROM page1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s, qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM signals),
fused AS (SELECT qid, doc_id, sum(CASE s {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _FIVE.items())} END / (60 + rank)) AS score FROM ranked GROUP BY ALL)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS top FROM fused WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id))
WHERE rank <= 3 AND (rank = 1 OR (top - score) / top <= 0.15)""")
def doc_fusion(t: Inputs) -> DataFrame:
    """Documents for every benchmark text by five signals: their best chunk, nearest vector and its reciprocal rank, whole
    text, and first page; weighted reciprocal ranks, then up to three whose score is close to the best."""
    near = _doc_nearest(t).withColumnRenamed("unit", "doc_id")
    chunk = best_scores(t, POOL, "pages").groupBy("qid", F.col("unit.doc_id").alias("doc_id")).agg(F.max("score").alias("score"))
    first = best_scores(t, POOL, "pages", "unit.page = 1").withColumn("unit", F.col("unit.doc_id"))
    signals = {
        "chunk": chunk,
        "dense": near.select("qid", "doc_id", "score"),
        "dense_rrf": near.select("qid", "doc_id", (1.0 / (R.RRF_K + F.col("rank"))).alias("score")),
        "doc": best_scores(t, POOL).select("qid", F.col("unit").alias("doc_id"), "score"),
        "page1": first.select("qid", F.col("unit").alias("doc_id"), "score"),
    }
    return R.fused_documents(signals, _FIVE, "qid", "doc_id", POOL).select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH " + _duck_bm25(_DOC_UNITS) + f""", r AS ({_ranked('scored', 5)})
SELECT qid, unit, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM r) WHERE rank = 1 OR (top - score) / top <= 0.15""")
def gap_select(t: Inputs) -> DataFrame:
    return R.gap_select(best_scores(t, 5).drop("rank"), "qid", 0.15, 5, "unit").select("qid", "unit", F.col("rank").cast("long").alias("rank"))


_HYBRID = "WITH " + _duck_bm25(_DOC_UNITS) + f""",
lexical AS ({_ranked('scored', POOL)}), near AS ({_ranked(f'({_DOC_DENSE})', POOL)}),
fused AS (SELECT qid, unit, sum(w / (60 + rank)) AS score FROM (SELECT 2.0 AS w, qid, unit, rank FROM lexical UNION ALL SELECT 1.0, qid, unit, rank FROM near) GROUP BY ALL)
SELECT qid, unit, round(score, 6) AS score, rank FROM ({_ranked('fused', 60)})"""


@query(_HYBRID)
def hybrid_rrf(t: Inputs) -> DataFrame:
    """Documents for every benchmark text: reciprocal ranks of BM25 (weight two) and of the nearest vectors (weight one)."""
    lexical = best_scores(t, POOL)
    top = R.top_k(R.rrf([(lexical, 2.0), (_doc_nearest(t), 1.0)], "qid", "unit"), ["qid"], R.best_first("score", "unit"), 60)
    return top.select("qid", "unit", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_DENSE}, l AS (SELECT vec_id // 20 * 20 AS qid, vec_id AS unit, (vec_id % 13) / 13.0 AS score FROM embeddings),
d AS ({_ranked('dense', 100)}), f AS (SELECT qid, unit, coalesce(d.score, 0) + 0.3 * coalesce(l.score, 0) AS score FROM d FULL JOIN l USING (qid, unit))
SELECT qid, unit, round(score, 6) AS score, rank FROM ({_ranked('f', 10)})""")
def additive_fusion(t: Inputs) -> DataFrame:
    lexical = t.table("embeddings").select(F.expr("vec_id div 20 * 20").alias("qid"), F.col("vec_id").alias("unit"), (F.col("vec_id") % 13 / 13.0).alias("score"))
    top = R.top_k(R.additive(_nearest(t, 100), lexical, "qid", "unit"), ["qid"], R.best_first("score", "unit"), 10)
    return top.select("qid", "unit", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def words_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '{P.WORD}'))"


def word_shares(t: Inputs, candidates: DataFrame, chars: int | None = None) -> DataFrame:
    """``candidates`` (qid, unit, ...) with ``share``: how much of a benchmark text's words a document has, or its first ``chars`` characters; a stand-in for a scorer."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(P.WORD), F.lit(0)))
    asked = t.table("benchmark").select(F.col("item_id").alias("qid"), words(F.col("text")).alias("asked"))
    met = written(candidates, "candidates").join(_docs(t), "unit")  # a written table has its size: a small one goes to the texts
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    share = F.size(F.array_intersect("asked", words(text))) / F.greatest(F.lit(1), F.size("asked"))
    return met.join(asked, "qid").select(*candidates.columns, share.alias("share"))


#: Fused candidates that a second scorer sees, and how many of them it keeps.
FUSED, KEPT = 100, 10


@query("WITH " + _duck_bm25(_DOC_UNITS) + f""", lexical AS ({_ranked('scored', POOL)}), near AS ({_ranked(f'({_DOC_DENSE})', POOL)}),
fused AS (SELECT qid, unit, sum(1.0 / (60 + rank)) AS score FROM (SELECT qid, unit, rank FROM lexical UNION ALL SELECT qid, unit, rank FROM near) GROUP BY ALL),
filled AS (SELECT f.*, u.text FROM fused f JOIN units u USING (unit) WHERE trim(u.text) <> ''), pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit) AS before FROM filled QUALIFY before <= {FUSED}),
shares AS (SELECT p.qid, p.unit, p.score, p.before, count(*) OVER (PARTITION BY p.qid) <= {KEPT} AS few, len(list_intersect({words_sql('b.text')}, {words_sql('p.text')}))::DOUBLE / greatest(1, len({words_sql('b.text')})) AS share FROM pool p JOIN benchmark b ON b.item_id = p.qid)
SELECT qid, unit, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN few THEN 0 ELSE -round(share, 9) END, before) AS rank FROM shares QUALIFY rank <= {KEPT}""")
def passage_rrf(t: Inputs) -> DataFrame:
    """Passages for every benchmark text: reciprocal ranks of BM25 and of the nearest vectors with equal weights; of those with a text the
    first hundred go to a second scorer, which reads them whole and keeps ten. Up to ten candidates stay in their order."""
    fused = R.rrf([(best_scores(t, POOL), 1.0), (_doc_nearest(t), 1.0)], "qid", "unit")
    filled = fused.join(_docs(t).where(F.trim("text") != "").select("unit"), "unit", "left_semi")
    pool = R.top_k(filled, ["qid"], R.best_first("score", "unit"), FUSED, "before")
    top = R.reranked(word_shares(t, pool), "qid", "before", KEPT, "share")
    return top.select("qid", "unit", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# Candidates, documents and pages for each type of answer.
TYPE_LIMITS = {"boolean": (200, 3, 3), "number": (200, 2, 2), "date": (200, 2, 1), "name": (200, 3, 3), "names": (200, 3, 3), "free_text": (200, 4, 5)}


@query("WITH c(answer_type, top_k, max_docs, max_pages) AS (VALUES " + ", ".join(str((k, *v)) for k, v in TYPE_LIMITS.items()) + ") SELECT qid, answer_type, top_k, max_docs, max_pages FROM fx_questions JOIN c USING (answer_type)")
def type_config(t: Inputs) -> DataFrame:
    limits = t.spark.createDataFrame([(k, *v) for k, v in TYPE_LIMITS.items()], "answer_type string, top_k int, max_docs int, max_pages int")
    return t.fx("questions").join(F.broadcast(limits), "answer_type").select("qid", "answer_type", "top_k", "max_docs", "max_pages")


# -- keyword search over documents and pages

@query("""WITH h AS (SELECT l_orderkey // 100 AS qid, l_suppkey AS doc, l_partkey AS unit, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, unit) AS turn FROM h)
SELECT qid, doc, unit, row_number() OVER (PARTITION BY qid ORDER BY turn, doc) AS position FROM t WHERE turn <= 15""")
def round_robin(t: Inputs) -> DataFrame:
    hits = t.table("lineitem").groupBy(F.expr("l_orderkey div 100").alias("qid"), F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("unit")).agg(F.max("l_quantity").alias("score"))
    return R.round_robin(hits, "qid", "doc", 15, F.col("score").desc(), F.col("unit")).select("qid", "doc", "unit", F.col("position").cast("long").alias("position"))


_CASE_KEY = "upper(m.p) || ' ' || lpad(m.n, greatest(3, length(m.n))::INT, '0') || '/' || m.y"
_IDENTIFIERS = f"list_distinct(list_transform(regexp_extract_all(text, '{P.CASE_ID}', ['p', 'n', 'y']), lambda m: {_CASE_KEY}) || list_transform(regexp_extract_all(text, '{P.LAW_NO}', 1), lambda n: 'LAW ' || n))"
_KEYED = "SELECT n_nationkey AS qid, CASE WHEN n_nationkey % 2 = 0 THEN concat('What does Law No ', CAST(n_nationkey % 12 + 1 AS STRING), ' say of ', CAST(2004 + n_nationkey % 16 AS STRING), '?') ELSE concat('What did CFI-', CAST(n_nationkey + 150 AS STRING), '-', CAST(2010 + n_nationkey % 15 AS STRING), ' decide?') END AS text FROM "


@query(f"""WITH q AS ({_KEYED} nation), asked AS (SELECT qid, regexp_extract_all(text, '{P.YEAR}') AS years, unnest({_IDENTIFIERS}) AS key FROM q), held AS (SELECT doc_id, regexp_extract_all(text, '{P.YEAR}') AS years, unnest({_IDENTIFIERS}) AS key FROM fx_legal_text),
hits AS (SELECT qid, doc_id, bool_or(len(list_intersect(a.years, h.years)) > 0) AS in_year FROM asked a JOIN held h USING (key) GROUP BY qid, doc_id)
SELECT qid, doc_id FROM hits QUALIFY in_year OR NOT bool_or(in_year) OVER (PARTITION BY qid)""")
def keyword_docs(t: Inputs) -> DataFrame:
    """Documents that hold a question's case or law number, those of its years if there are any."""
    return R.identifier_docs(t.sql(_KEYED + "{nation}"), t.fx("legal_text").select("doc_id", "text"))
