"""Queries of answer parsing, the format guard, citations and post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import answers as A
from corpusmill.functions import patterns as Q
from corpusmill.functions.text import contains_any
from corpusmill.operators import citations as P
from corpusmill.operators import submissions as S
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query


def _raw(t: Inputs) -> DataFrame:
    return t.fx("answers")


def _each(c):
    return lambda t: _raw(t).select("qid", c(F.col("raw")).alias("value"))


def scalar(name: str, c, sql: str):
    query(f"SELECT qid, {sql} AS value FROM fx_answers", name)(_each(c))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NUM = r"try_cast(nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)AED|USD|EUR|GBP|\$', '', 'g'), '(\d)[ ,](\d{3})\b', '\1\2', 'g'), '(\d)[ ,](\d{3})\b', '\1\2', 'g'), '-?\d+(?:\.\d+)?'), '') AS DOUBLE)"
_DATE = "coalesce(" + ", ".join(f"strftime(try_strptime(trim(raw), '{f}'), '%Y-%m-%d')" for f in ("%Y-%m-%d", "%d %B %Y", "%B %d, %Y", "%d/%m/%Y")) + ")"

scalar("strip_artifacts", A.without_artifacts, _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(raw, '(?im)^(?:SOURCES|PAGES|PAGES_USED|QUOTE)\s*:.*$', '', 'g'), '\[\d+\]', '', 'g'), '(?i)\s*\(Source:[^)]*\)\s*$', '')"))
scalar("parse_boolean", A.parse_boolean, r"CASE WHEN regexp_matches(lower(trim(regexp_replace(raw, '[*_`]', '', 'g'))), '^(?:true|yes)') THEN true WHEN regexp_matches(lower(trim(regexp_replace(raw, '[*_`]', '', 'g'))), '^(?:false|no\b)') THEN false END")
scalar("parse_number", A.parse_number, _NUM)
scalar("parse_date", A.parse_date, f"coalesce({_DATE}, trim(raw))")
scalar("parse_fast", lambda x: F.when(F.lower(x).rlike("^(yes|true|correct)"), "true").when(F.lower(x).rlike("^(no|false)"), "false").otherwise(F.substring(x, 1, 10)), "CASE WHEN regexp_matches(lower(raw), '^(yes|true|correct)') THEN 'true' WHEN regexp_matches(lower(raw), '^(no|false)') THEN 'false' ELSE left(raw, 10) END")
scalar("parse_name", lambda x: F.when(A.is_null_word(x), None).otherwise(A.answer_case_id(x)), r"CASE WHEN lower(trim(raw)) IN ('null', 'n/a', 'none', 'unanswerable') THEN NULL ELSE regexp_replace(raw, '^([A-Z]{2,4})-(\d+)-(\d{4})$', '\1 \2/\3') END")
scalar("norm_answer_case", A.answer_case_id, r"regexp_replace(raw, '^([A-Z]{2,4})-(\d+)-(\d{4})$', '\1 \2/\3')")
scalar("fix_boolean", A.fix_boolean, "CASE WHEN lower(trim(raw)) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim(raw)) IN ('false', 'no', 'n', '0') THEN false END")
scalar("fix_number", A.fix_number, r"try_cast(regexp_replace(raw, '[AED$£€¥US,\s]', '', 'g') AS DOUBLE)")
scalar("fix_date", A.fix_date, _DATE)
scalar("fix_name", A.fix_name, r"regexp_replace(regexp_replace(regexp_replace(trim(raw), '(?i)^(?:the answer is|it is|this is)\s+', ''), '(?i)^(?:the|an?)\s+', ''), '\.$', '')")
scalar("fix_names", lambda x: F.array_join(A.fix_names(x), "|"), "array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|')")
scalar("fix_free_text", lambda x: A.fix_free_text(F.concat(x, F.lit(" Caveat: none."))), r"trim(regexp_replace(regexp_replace(raw || ' Caveat: none.', '\*\*|__|`', '', 'g'), '(?is)\s*Caveat:.*$', ''))")
scalar("fix_unanswerable", lambda x: F.when(A.is_null_word(x), None).otherwise(x), "CASE WHEN lower(trim(raw)) IN ('null', 'n/a', 'none', 'unanswerable') THEN NULL ELSE raw END")
_PHRASES = [*A.DEFLECTIONS, "fine", "cannot say", "passages"]
_PHRASED = "CASE qid % 12 " + " ".join("WHEN {} THEN '{}'".format(i, p.replace("'", "''")) for i, p in enumerate(_PHRASES)) + " END"
scalar("deflection", lambda x: A.is_deflection(F.concat(x, F.lit(" "), F.upper(F.expr(_PHRASED.replace("''", "\\'"))))), "(" + " OR ".join("contains(lower(raw || ' ' || upper({})), '{}')".format(_PHRASED, p.replace("'", "''")) for p in A.DEFLECTIONS) + ")")
scalar("parse_citations", lambda x: F.array_join(A.cited(F.concat(F.lit("[P"), (F.col("qid") % 9).cast("string"), F.lit("] a [P2] b [P2]")), F.lit(5)), "|"), "CASE WHEN qid % 9 BETWEEN 1 AND 5 AND qid % 9 <> 2 THEN CASE WHEN qid % 9 < 2 THEN (qid % 9 - 1)::VARCHAR || '|1' ELSE '1|' || (qid % 9 - 1) END ELSE '1' END")
scalar("pages_used", lambda x: F.array_join(A.pages_used(F.concat(F.lit("PAGES_USED: [3, "), (F.col("qid") % 40).cast("string"), F.lit(", 12]"))), "|"), "'3|' || (qid % 40) || '|12'")
scalar("grounding", lambda x: F.array_join(F.regexp_extract_all(F.concat(F.lit('"'), x, F.lit('" → page '), (F.col("qid") % 7).cast("string")), F.lit(r'"([^"]+)" → page (\d+)'), F.lit(2)), "|"), "(qid % 7)::VARCHAR")


#: Answers checked by hand: those of some labelled documents' numbers, null where the question has none.
_OVERRIDES = "SELECT doc_id AS qid, CASE WHEN quality = 1 THEN concat('checked ', CAST(doc_id AS STRING)) END AS fixed FROM {labels}"


@query("SELECT a.qid, CASE WHEN o.qid IS NOT NULL THEN o.fixed ELSE a.raw END AS value, o.qid IS NOT NULL AS overridden FROM fx_answers a LEFT JOIN (" + _OVERRIDES.replace("{labels}", "labels") + ") o ON o.qid = a.qid")
def answer_override(t: Inputs) -> DataFrame:
    """Answers, those checked by hand in place of the model's."""
    return P.overridden(_raw(t).select("qid", F.col("raw").alias("value")), t.sql(_OVERRIDES), "value", "fixed")


_DAY = "try_strptime(answer, '%Y-%m-%d')"
_TERMS = f"list_filter(regexp_extract_all(answer, '{Q.ANSWER_WORD.replace(chr(39), chr(39) * 2)}'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in Q.ANSWER_STOP_WORDS) + "], lower(w)))"


@query(f"""WITH w AS (SELECT qid, answer_type, trim(answer) AS answer, {_TERMS} AS w FROM fx_results), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS low FROM w)
SELECT qid, array_to_string(coalesce(CASE answer_type
 WHEN 'number' THEN list_filter([answer, CASE WHEN suffix(answer, '.0') THEN left(answer, length(answer) - 2) END, CASE WHEN try_cast(answer AS DOUBLE) >= 1000 AND try_cast(answer AS DOUBLE) = floor(try_cast(answer AS DOUBLE)) THEN format('{{:,}}', try_cast(answer AS DOUBLE)::BIGINT) END], lambda x: x IS NOT NULL)
 WHEN 'date' THEN list_filter([answer, strftime({_DAY}, '%d %B %Y'), strftime({_DAY}, '%d %b %Y'), strftime({_DAY}, '%B %d, %Y'), strftime({_DAY}, '%-d %B %Y'), strftime({_DAY}, '%d/%m/%Y')], lambda x: x IS NOT NULL)
 WHEN 'name' THEN CASE WHEN answer <> '' AND lower(answer) <> 'null' THEN [answer] END
 WHEN 'names' THEN CASE WHEN answer <> '' AND lower(answer) <> 'null' THEN list_transform(string_split(answer, ','), lambda x: trim(x)) END
 WHEN 'free_text' THEN list_filter(w, lambda x, i: list_position(low, lower(x)) = i)[1:20] END, []), '|') AS keywords FROM l""")
def answer_keywords(t: Inputs) -> DataFrame:
    return t.fx("results").select("qid", F.array_join(A.answer_keywords(F.col("answer"), F.col("answer_type")), "|").alias("keywords"))


@query("SELECT qid, " + _STRIP.format(r"regexp_replace(regexp_replace(" + _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(raw, '(?im)^(?:SOURCES|PAGES|PAGES_USED|QUOTE)\s*:.*$', '', 'g'), '\[\d+\]', '', 'g'), '(?i)\s*\(Source:[^)]*\)\s*$', '')") + r", '\*\*|__|`', '', 'g'), '(?is)\s*Caveat:.*$', '')") + " AS value FROM fx_answers")
def parse_free_text(t: Inputs) -> DataFrame:
    return _raw(t).select("qid", A.truncated_sentence(A.fix_free_text(A.without_artifacts(F.col("raw")))).alias("value"))


@query(r"SELECT qid, unnest(string_split(regexp_replace(raw, '\s+and\s+', ', ', 'g'), ', ')) AS name FROM fx_answers WHERE qid % 12 = 10")
def parse_names(t: Inputs) -> DataFrame:
    """Names of a list; a comma before a company's legal form does not separate."""
    parts = F.split(F.regexp_replace("raw", r"\s+and\s+", ", "), r",\s*(?!(?:LLC|Ltd|Inc|Limited)\b)")
    return _raw(t).where("qid % 12 = 10").select("qid", F.explode(parts).alias("name"))


# -- the guard's report

_ISSUES = "SELECT qid, answer_type, CASE WHEN answer IS NULL THEN 'warning' WHEN n_pages = 0 THEN 'info' WHEN answer_type = 'date' THEN 'critical' END AS severity FROM fx_runs"


@query(f"SELECT severity, answer_type, count(*) AS n FROM ({_ISSUES}) WHERE severity IS NOT NULL GROUP BY ALL")
def format_report(t: Inputs) -> DataFrame:
    severity = F.when(F.col("answer").isNull(), "warning").when(F.col("n_pages") == 0, "info").when(F.col("answer_type") == "date", "critical")
    return t.fx("runs").withColumn("severity", severity).where("severity is not null").groupBy("severity", "answer_type").agg(F.count("*").alias("n"))


# -- citations: pages of documents stand for cited pages, their first words for keywords

_CITED = "SELECT doc_id AS qid, doc_id AS doc, page, text, CASE doc_id % 3 WHEN 0 THEN 'boolean' WHEN 1 THEN 'names' ELSE 'number' END AS kind, list_filter(string_split(lower(left(first_value(text) OVER (PARTITION BY doc_id ORDER BY page), 80)), ' '), lambda w: length(w) >= 4) AS kw FROM fx_pages"
_HELD = "len(list_filter(kw, lambda w: contains(lower(text), w)))"
_STATUS = f"""CASE WHEN trim(text) = '' THEN 'NO_SUPPORT' WHEN len(kw) = 0 THEN 'WEAK' WHEN kind = 'number' THEN CASE WHEN {_HELD} > 0 THEN 'CONFIRMED' ELSE 'NO_SUPPORT' END
 WHEN kind = 'boolean' THEN CASE WHEN {_HELD} / len(kw) >= 0.5 THEN 'CONFIRMED' WHEN {_HELD} / len(kw) >= 0.25 THEN 'WEAK' ELSE 'NO_SUPPORT' END
 ELSE CASE WHEN {_HELD} / len(kw) >= 0.5 THEN 'CONFIRMED' WHEN {_HELD} > 0 THEN 'WEAK' ELSE 'NO_SUPPORT' END END"""


def _checked(t: Inputs) -> DataFrame:
    pages = t.fx("pages")
    words = pages.where("page = 1").select("doc_id", F.filter(F.split(F.lower(F.substring("text", 1, 80)), " "), lambda w: F.length(w) >= 4).alias("kw"))
    kind = F.when(F.col("doc_id") % 3 == 0, "boolean").when(F.col("doc_id") % 3 == 1, "names").otherwise("number")
    cited = pages.join(words, "doc_id").withColumn("kind", kind)
    return cited.select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("doc"), "page", P.page_status(F.col("kind"), F.col("kw"), F.col("text")).alias("status"))


@query(f"WITH c AS ({_CITED}) SELECT qid, page, {_STATUS} AS status FROM c")
def verify_page(t: Inputs) -> DataFrame:
    return _checked(t).select("qid", "page", "status")


_BEST = f"""c AS ({_CITED}), s AS (SELECT qid, page, {_STATUS} AS status FROM c), cite AS (SELECT qid, max(page) AS cited FROM s GROUP BY qid),
best AS (SELECT qid, cited, page FROM s JOIN cite USING (qid) WHERE status <> 'NO_SUPPORT' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY (status <> 'CONFIRMED'), CASE page - cited WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 WHEN 2 THEN 4 ELSE page + 4 END, page) = 1)"""


def _best(t: Inputs) -> DataFrame:
    checked = _checked(t)
    cited = checked.groupBy("qid").agg(F.max("page").alias("cited"))
    tried = checked.join(cited, "qid").withColumn("position", P.scan_position(F.col("page"), F.col("cited")))
    return P.best_pages(tried, ["qid"]).select("qid", "cited", "page")


@query(f"WITH {_BEST} SELECT qid, cited, page FROM best")
def reselect_page(t: Inputs) -> DataFrame:
    return _best(t)


@query(f"WITH {_BEST} SELECT s.qid, CASE WHEN s.status = 'NO_SUPPORT' THEN coalesce(b.page, s.page) ELSE s.page END AS page FROM s JOIN cite ON s.qid = cite.qid AND s.page = cite.cited LEFT JOIN best b ON b.qid = s.qid")
def verify_pages(t: Inputs) -> DataFrame:
    best = _best(t).select("qid", "cited", F.col("page").alias("other"))
    checked = _checked(t)
    last = checked.groupBy("qid").agg(F.max("page").alias("page"))
    own = checked.join(last, ["qid", "page"]).join(best.drop("cited"), "qid", "left")
    return own.select("qid", F.when(F.col("status") == P.NO_SUPPORT, F.coalesce("other", "page")).otherwise(F.col("page")).alias("page"))


_LINES = "SELECT l_orderkey AS qid, l_suppkey AS doc, l_linenumber AS page FROM lineitem"


def _lines(t: Inputs) -> DataFrame:
    return t.table("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"))


@query(f"SELECT qid, doc, string_agg(DISTINCT page::VARCHAR, '|' ORDER BY page::VARCHAR) AS pages FROM ({_LINES}) GROUP BY ALL")
def chunk_pages(t: Inputs) -> DataFrame:
    return P.grouped(_lines(t), ["qid", "doc"]).select("qid", "doc", F.array_join(F.col("pages").cast("array<string>"), "|").alias("pages"))


@query(f"""WITH c AS (SELECT DISTINCT * FROM ({_LINES}) WHERE page <= 2), r AS (SELECT DISTINCT * FROM ({_LINES}) WHERE page >= 2), k AS (SELECT * FROM c INTERSECT SELECT * FROM r)
SELECT * FROM k UNION ALL SELECT * FROM r WHERE qid NOT IN (SELECT qid FROM k) AND qid IN (SELECT qid FROM c)""")
def validate_citations(t: Inputs) -> DataFrame:
    lines = _lines(t).distinct()
    return P.validated(lines.where("page <= 2"), lines.where("page >= 2"), ["qid", "doc", "page"])


@query(f"""WITH l AS (SELECT DISTINCT * FROM ({_LINES})), k AS (SELECT *, count(*) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid, doc ORDER BY page) AS f, dense_rank() OVER (PARTITION BY qid ORDER BY doc) AS d FROM l)
SELECT qid, doc, page FROM k WHERE total <= 3 OR (f = 1 AND d <= 3)""")
def page_limit(t: Inputs) -> DataFrame:
    return P.capped(_lines(t).distinct(), "qid", 3)


@query(f"WITH l AS (SELECT qid, doc, min(page) AS page FROM ({_LINES}) GROUP BY ALL) SELECT qid, doc, page FROM l QUALIFY row_number() OVER (PARTITION BY qid ORDER BY doc) <= 3")
def page_limit_fast(t: Inputs) -> DataFrame:
    from corpusmill.operators.retrieval import top_k

    first = _lines(t).groupBy("qid", "doc").agg(F.min("page").alias("page"))
    return top_k(first, ["qid"], [F.col("doc")], 3).select("qid", "doc", "page")


@query(f"WITH l AS (SELECT DISTINCT qid, doc, page FROM ({_LINES})), n AS (SELECT o_orderkey AS qid, o_orderkey % 3 + 1 AS most FROM orders) SELECT qid, doc, page FROM l JOIN n USING (qid) QUALIFY dense_rank() OVER (PARTITION BY qid ORDER BY doc) <= most AND row_number() OVER (PARTITION BY qid ORDER BY doc, page) <= greatest(3, most)")
def doc_cap(t: Inputs) -> DataFrame:
    """At most as many documents as were asked for, and three pages or as many."""
    w = Window.partitionBy("qid").orderBy("doc")
    most = t.table("orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % 3 + 1).alias("most"))
    ranked = _lines(t).distinct().join(most, "qid").withColumns({"d": F.dense_rank().over(w), "n": F.row_number().over(Window.partitionBy("qid").orderBy("doc", "page"))})
    return ranked.where("d <= most and n <= greatest(3, most)").select("qid", "doc", "page")


@query(f"WITH a AS (SELECT l_suppkey AS doc, min(l_linenumber) AS start FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL), l AS (SELECT DISTINCT * FROM ({_LINES})) SELECT qid, doc, CASE WHEN page = start + 1 THEN start ELSE page END AS page FROM l LEFT JOIN a USING (doc)")
def article_restore(t: Inputs) -> DataFrame:
    """A cited page right after an article's start is the start."""
    starts = t.table("lineitem").where("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("doc")).agg(F.min("l_linenumber").alias("start"))
    return _lines(t).distinct().join(starts, "doc", "left").select("qid", "doc", F.when(F.col("page") == F.col("start") + 1, F.col("start")).otherwise(F.col("page")).alias("page"))


@query("SELECT l_orderkey AS qid, l_linenumber AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def valid_doc_ids(t: Inputs) -> DataFrame:
    known = t.table("part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return t.table("lineitem").join(known, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("n"))


@query(f"SELECT DISTINCT qid, doc FROM ({_LINES}) l WHERE doc % 2 = 0 OR qid NOT IN (SELECT qid FROM ({_LINES}) WHERE doc % 2 = 0)")
def cited_sources(t: Inputs) -> DataFrame:
    """The sources that the answer names, else all of them."""
    lines = _lines(t).select("qid", "doc").distinct()
    named = lines.where("doc % 2 = 0")
    return named.union(lines.join(named.select("qid").distinct(), "qid", "left_anti"))


def clearing(name: str, rule, sql: str):
    """A rule that clears the pages of an answer."""
    query(f"SELECT qid, CASE WHEN {sql} THEN 0 ELSE n_pages END AS n_pages FROM fx_results", name)(lambda t: t.fx("results").select("qid", F.when(rule(), 0).otherwise(F.col("n_pages")).alias("n_pages")))


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_FALSE = (lambda: (F.col("answer_type") == "boolean") & (F.col("answer") == "false")), "answer_type = 'boolean' AND answer = 'false'"
clearing("null_clears", lambda: F.col("answer").isNull(), "answer IS NULL")
clearing("absence_free_text", lambda: (F.col("answer_type") == "free_text") & A.says_absent(F.col("question"), F.col("answer")),
         f"answer_type = 'free_text' AND starts_with(lower(question), 'does') AND contains(lower(question), 'address') AND NOT regexp_matches(question, '{Q.CASE_IN_QUESTION}') AND {_has('lower(left(answer, 150))', Q.ABSENT_ANSWER)}")
clearing("absence_boolean", lambda: _FALSE[0]() & A.topic_absent(F.col("question")), rf"{_FALSE[1]} AND {_has('lower(question)', Q.ABSENT_TOPIC)} AND NOT regexp_matches(question, '(?i)\bArticle\s+\d')")
clearing("cross_case_false", lambda: _FALSE[0]() & ((F.col("model_name") == "oracle") | A.several_cases(F.col("question"))),
         f"{_FALSE[1]} AND (model_name = 'oracle' OR len(list_distinct(regexp_extract_all(question, '{Q.CASE_NUMBER}'))) >= 2)")
clearing("oracle_cmp_clears", lambda: (F.col("model_name") == "oracle") & F.col("answer_type").isin("name", "date") & contains_any(F.lower("question"), Q.COMPARING),
         f"model_name = 'oracle' AND answer_type IN ('name', 'date') AND {_has('lower(question)', Q.COMPARING)}")


@query("SELECT qid, greatest(1, ttft_ms) AS ttft_ms, greatest(1, ttft_ms, total_time_ms) AS total_time_ms, coalesce(model_name, 'unknown') AS model_name FROM fx_runs")
def telemetry_fix(t: Inputs) -> DataFrame:
    ttft = F.greatest(F.lit(1), "ttft_ms")
    return t.fx("runs").select("qid", ttft.alias("ttft_ms"), F.greatest(ttft, "total_time_ms").alias("total_time_ms"), F.coalesce("model_name", F.lit("unknown")).alias("model_name"))


_ANSWERED = "CASE doc_id % 5 WHEN 0 THEN concat(' 1. ', text) WHEN 1 THEN concat('QUESTION PARSE ', text) WHEN 2 THEN concat('As it says: \"this\". ', text) WHEN 3 THEN concat('A trustee''s duty. ', text) ELSE text END"


@query(f"""WITH a AS (SELECT doc_id, {_ANSWERED} AS a FROM documents) SELECT doc_id, (contains(a, chr(39)) OR contains(a, '"')) AND length(a) >= 300 AND NOT (starts_with(ltrim(a), '1.') OR contains(a, 'QUESTION PARSE') OR contains(a, 'KEY PROVISIONS')) AS skip FROM a""")
def grounding_gate(t: Inputs) -> DataFrame:
    """Which free answers are not rewritten."""
    answer = F.expr(_ANSWERED.replace("''", "\\'"))
    return t.table("documents").select("doc_id", A.keeps_grounding(answer).alias("skip"))


@query("SELECT qid, ttft_ms, greatest(1, ttft_ms, total_time_ms) - greatest(1, ttft_ms) AS tpot_ms, least(3, n_pages) AS n_pages FROM fx_runs")
def fast_result(t: Inputs) -> DataFrame:
    ttft = F.greatest(F.lit(1), "ttft_ms")
    return t.fx("runs").select("qid", "ttft_ms", (F.greatest(ttft, "total_time_ms") - ttft).alias("tpot_ms"), F.least(F.lit(3), "n_pages").alias("n_pages"))


@query("""WITH r AS (SELECT *, greatest(1, ttft_ms) AS first, greatest(1, ttft_ms, total_time_ms) AS whole FROM fx_runs)
SELECT qid, '{"question_id":"' || qid || '","answer":' || coalesce('"' || answer || '"', 'null') || ',"telemetry":{"timing":{"ttft_ms":' || first || ',"tpot_ms":' || (whole - first) || ',"total_time_ms":' || whole
 || '},"usage":{"input_tokens":' || greatest(1, qid % 900) || ',"output_tokens":' || greatest(1, qid % 7) || '},"retrieval":{"retrieved_chunk_pages":[' || CASE WHEN n_pages > 0 THEN '{"doc_id":"d' || qid % 50 || '","page_numbers":[' || n_pages || ']}' ELSE '' END
 || ']},"model_name":"' || model_name || '"}}' AS entry FROM r""")
def submission(t: Inputs) -> DataFrame:
    """Answers as they are submitted."""
    q = F.col("qid")
    pages = F.array(F.struct(F.concat(F.lit("d"), (q % 50).cast("string")).alias("doc_id"), F.array(F.col("n_pages")).alias("page_numbers")), F.struct(F.lit(None).cast("string").alias("doc_id"), F.array(F.lit(1)).alias("page_numbers")))
    return t.fx("runs").select("qid", S.record(q, F.col("answer"), F.col("ttft_ms"), F.col("total_time_ms"), q % 900, q % 7, pages, F.col("model_name")).alias("entry"))


#: What is wrong with an entry of each number (modulo 32); all others are as they should be.
_WRONG = [
    "missing question_id", "duplicate question_id", "missing answer", "answer has an invalid type", "an item of the answer is no string", "missing telemetry", "missing timing", "missing usage",
    "missing retrieval", "missing ttft_ms", "ttft_ms is negative", "missing tpot_ms", "tpot_ms is negative", "missing total_time_ms", "total_time_ms is negative", "missing input_tokens",
    "input_tokens is negative", "missing output_tokens", "output_tokens is negative", "total_time_ms is below ttft_ms", "total_time_ms is 0", "missing retrieved_chunk_pages", "pages without doc_id",
    "pages without page_numbers", "a page number is below 1", "missing model_name", "model_name is empty",
]
#: A wrong total breaks other rules as well.
_ALSO = {"missing total_time_ms": ["total_time_ms is below ttft_ms", "total_time_ms is 0"], "total_time_ms is negative": ["total_time_ms is below ttft_ms"], "total_time_ms is 0": ["total_time_ms is below ttft_ms"]}


def _entries(t: Inputs) -> DataFrame:
    """Parsed entries, one in 32 for each way to be wrong."""
    k = F.col("event_id") % 32
    off = lambda name: k == _WRONG.index(name)
    number = lambda field, value: F.when(off(f"missing {field}"), None).when(off(f"{field} is negative"), -1).otherwise(value).alias(field)
    some = lambda name, c: F.when(~off(name), c)
    total = F.when(off("total_time_ms is below ttft_ms"), 3).when(off("total_time_ms is 0"), 0).otherwise(20)
    page = F.struct(some("pages without doc_id", F.lit("d")).alias("doc_id"), some("pages without page_numbers", F.array(F.when(off("a page number is below 1"), 0).otherwise(2))).alias("page_numbers"))
    telemetry = F.struct(
        some("missing timing", F.struct(number("ttft_ms", 5), number("tpot_ms", 1), number("total_time_ms", total))).alias("timing"),
        some("missing usage", F.struct(number("input_tokens", 9), number("output_tokens", 2))).alias("usage"),
        some("missing retrieval", F.struct(some("missing retrieved_chunk_pages", F.array(page)).alias("retrieved_chunk_pages"))).alias("retrieval"),
        some("missing model_name", F.when(off("model_name is empty"), " ").otherwise("m")).alias("model_name"),
    )
    own = F.when(off("duplicate question_id"), F.col("event_id") + 1).otherwise(F.col("event_id"))
    answer = F.when(off("answer has an invalid type"), '{"a": 1}').when(off("an item of the answer is no string"), '["a, 1", 2]').otherwise('["a, 1"]')
    return t.table("events").select(
        F.col("event_id").alias("position"), some("missing question_id", own.cast("string")).alias("question_id"), some("missing answer", answer).alias("answer"), some("missing telemetry", telemetry).alias("telemetry")
    )


_BROKEN = " ".join("WHEN {} THEN [{}]".format(i, ", ".join(f"'{e}'" for e in [name, *_ALSO.get(name, [])])) for i, name in enumerate(_WRONG) if name != "duplicate question_id")


@query(f"""WITH e AS (SELECT event_id AS position, unnest(CASE event_id % 32 {_BROKEN} ELSE [] END) AS error FROM events UNION ALL
SELECT event_id, 'duplicate question_id' FROM events WHERE event_id % 32 = 2 AND event_id - 1 IN (SELECT event_id FROM events)) SELECT position, error FROM e""")
def validate_submission(t: Inputs) -> DataFrame:
    """Every rule that a submitted entry breaks; of entries with one question_id the first is fine."""
    return S.errors(_entries(t))
