"""Queries of column functions: references in texts and questions, and cleaning."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query

JOINED = lambda a: F.array_join(a, "|")


def _legal(t: Inputs) -> DataFrame:
    return t.fx("legal_text")


@query(r"""SELECT doc_id, page, left(md5(text), 8) AS k, concat_ws('|',
 array_to_string(list_transform(regexp_extract_all(text, '\b([A-Z]{2,5})[\s\-/](\d{2,4})[\s\-/](\d{4})\b', ['p','n','y']), lambda m: lower(m.p) || '_' || m.n || '_' || m.y || '|' || m.n || '|' || m.y), '|'),
 array_to_string(list_transform(regexp_extract_all(text, '(?i)\b(?:Article|Art\.?)\s+(\d+)(?:\((\w+)\))?(?:\((\w+)\))?', ['a','s','u']), lambda m: 'article_' || m.a || '|article_' || m.a || '_' || m.s || '|' || m.s || '|article_' || m.a || '_' || m.s || '_' || m.u || '|' || m.u), '|'),
 array_to_string(list_transform(regexp_extract_all(text, '(?i)\b(\w+)\s+Law\s+No\.?\s*(\d+)\s+of\s+(\d{4})\b', ['p','n','y']), lambda m: lower(m.p) || '_law_' || m.n || '_' || m.y), '|'),
 array_to_string(list_transform(regexp_extract_all(text, '(?i)\bSchedule\s+(\w+)\b', 1), lambda x: 'schedule_' || lower(x)), '|'),
 array_to_string(list_transform(regexp_extract_all(text, '(?i)\bRegulation\s+(\d+(?:\.\d+)*)\b', 1), lambda x: 'regulation_' || replace(x, '.', '_') || '|' || replace(x, '.', '|')), '|')) AS toks FROM fx_legal_text""")
def legal_tokens(t: Inputs) -> DataFrame:
    return _legal(t).select("doc_id", "page", F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("k"), JOINED(T.reference_tokens(F.col("text"))).alias("toks"))


_ENTITY_SQL = " || ".join(f"regexp_extract_all(text, '{p}')" for p in P.ENTITIES)


@query(f"SELECT doc_id, page, left(md5(text), 8) AS k, array_to_string(list_sort(list_distinct(list_transform({_ENTITY_SQL}, lambda e: lower(regexp_replace(trim(e), '\\s+', ' ', 'g'))))), '|') AS entities FROM fx_legal_text")
def chunk_entities(t: Inputs) -> DataFrame:
    return _legal(t).select("doc_id", "page", F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("k"), JOINED(T.entities(F.col("text"))).alias("entities"))


@query(rf"SELECT qid, unnest(list_distinct(list_transform(regexp_extract_all(question, '{P.CASE_ID}', ['p','n','y']), lambda m: upper(m.p) || ' ' || lpad(m.n, greatest(3, length(m.n))::INT, '0') || '/' || m.y))) AS case_id FROM fx_questions")
def extract_case_ids(t: Inputs) -> DataFrame:
    return t.fx("questions").select("qid", F.explode(T.case_ids(F.col("question"))).alias("case_id"))


@query(rf"SELECT qid, unnest(list_distinct(list_transform(regexp_extract_all(replace(question, ' 1', '/1'), '(?i)(CFI|ARB|SCT)/(\d+)/(\d{{4}})', ['p','n','y']), lambda m: upper(m.p) || ' ' || lpad(m.n, greatest(3, length(m.n))::INT, '0') || '/' || m.y))) AS case_id FROM fx_questions")
def case_ids_slash(t: Inputs) -> DataFrame:
    """Case numbers in slashes: the same pattern takes a slash after the prefix."""
    slashed = F.replace(F.col("question"), F.lit(" 1"), F.lit("/1"))
    only = F.filter(T.found(slashed, P.CASE_ID), lambda x: x.rlike(r"(?i)^(?:CFI|ARB|SCT)/"))
    return t.fx("questions").select("qid", F.explode(F.array_distinct(F.transform(only, T.case_id))).alias("case_id"))


@query(rf"SELECT doc_id, page, left(md5(text), 8) AS k, upper(regexp_extract(text, '{P.CASE_ID}', 1)) || ' ' || lpad(regexp_extract(text, '{P.CASE_ID}', 2), greatest(3, length(regexp_extract(text, '{P.CASE_ID}', 2)))::INT, '0') || '/' || regexp_extract(text, '{P.CASE_ID}', 3) AS case_id FROM fx_legal_text")
def norm_case_id(t: Inputs) -> DataFrame:
    return _legal(t).select("doc_id", "page", F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("k"), T.case_id(F.col("text")).alias("case_id"))


@query(rf"""SELECT qid, array_to_string(list_transform(regexp_extract_all(question, '{P.ARTICLE}', 1), lambda x: 'article_' || x), '|') AS keys FROM fx_questions""")
def extract_articles(t: Inputs) -> DataFrame:
    return t.fx("questions").select("qid", JOINED(T.article_keys(F.col("question"))).alias("keys"))


@query(rf"SELECT qid, array_to_string(regexp_extract_all(question || ' at the last page, page 7 of the judgment', '{P.PAGE_OF}', 1), '|') AS pages, lower(regexp_extract(question || ' at the last page', '{P.ORDINAL_PAGE}', 1)) AS ordinal FROM fx_questions")
def extract_page_refs(t: Inputs) -> DataFrame:
    q = F.concat("question", F.lit(" at the last page, page 7 of the judgment"))
    return t.fx("questions").select("qid", JOINED(T.found(q, P.PAGE_OF, 1)).alias("pages"), F.lower(F.regexp_extract(q, P.ORDINAL_PAGE, 1)).alias("ordinal"))


_KINDS = "CASE " + " ".join("WHEN regexp_matches(question, '(?i)" + "|".join(f"(?:{p})" for p in ps) + f"') THEN '{k}'" for k, ps in P.METADATA.items()) + " END"


@query(f"SELECT qid, {_KINDS} AS kind FROM fx_questions")
def metadata_type(t: Inputs) -> DataFrame:
    return t.fx("questions").select("qid", T.metadata_kind(F.col("question")).alias("kind"))


@query(r"SELECT qid, regexp_extract(question, '(?i)\bArticle\s+(\d+)', 1) AS article FROM fx_questions")
def article_filter(t: Inputs) -> DataFrame:
    return t.fx("questions").select("qid", F.regexp_extract("question", r"(?i)\bArticle\s+(\d+)", 1).alias("article"))


# Words that announce a comparison over several documents.
MULTI_HOP = r"(?i)\b(?:both|compare|comparison|earlier|later|higher|lower|common to|same)\b"


@query(rf"SELECT qid, (len(list_distinct(regexp_extract_all(question, '{P.CASE_ID}'))) >= 2 OR regexp_matches(question, '{MULTI_HOP}')) AS multi FROM fx_questions")
def multi_hop(t: Inputs) -> DataFrame:
    several = F.size(F.array_distinct(T.found(F.col("question"), P.CASE_ID))) >= 2
    return t.fx("questions").select("qid", (several | F.col("question").rlike(MULTI_HOP)).alias("multi"))


@query("SELECT n_nationkey AS k, trim(regexp_replace(lower(regexp_replace('Chief Justice Sir ' || n_name || ' KC', '(?i)\\b(?:H\\.E\\.|Justice|Chief|Deputy|Sir|Dr|KC)\\b\\.?', '', 'g')), '\\s+', ' ', 'g')) AS judge FROM nation")
def norm_judge(t: Inputs) -> DataFrame:
    name = F.concat(F.lit("Chief Justice Sir "), "n_name", F.lit(" KC"))
    bare = F.lower(F.regexp_replace(name, r"(?i)\b(?:H\.E\.|Justice|Chief|Deputy|Sir|Dr|KC)\b\.?", ""))
    return t.table("nation").select(F.col("n_nationkey").alias("k"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("judge"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_LOW = "lower(question)"


_CASE_ASKED = f"({_any(_LOW, P.CASE_WORDS)} OR regexp_matches(question, '{P.CASE_IN_QUESTION}'))"
_BY = lambda words: f"(len(regexp_extract_all(question, '{P.CASE_IN_QUESTION}')) >= 2 AND {_any(_LOW, words)})"


@query(f"SELECT qid, {_CASE_ASKED} AS is_case, NOT regexp_matches(question, '{P.CASE_IN_QUESTION}') AS is_law, {_any(_LOW, P.FOREIGN)} AS is_trick, {_BY(P.DATE_WORDS)} AS compares_dates, {_BY(P.VALUE_WORDS)} AS compares_values FROM fx_all_questions")
def question_class(t: Inputs) -> DataFrame:
    """What kind of question it is: about a case, purely about laws, a trick, a comparison of dates or of values."""
    q = F.col("question")
    return t.fx("all_questions").select(
        "qid", T.is_case_question(q).alias("is_case"), (~q.rlike(P.CASE_IN_QUESTION)).alias("is_law"), T.contains_any(F.lower(q), P.FOREIGN).alias("is_trick"),
        T.compares_cases(q, P.DATE_WORDS).alias("compares_dates"), T.compares_cases(q, P.VALUE_WORDS).alias("compares_values"),
    )


@query(f"""SELECT qid, CASE WHEN answer_type IN ('boolean', 'number', 'names', 'date') THEN answer_type WHEN answer_type = 'name' THEN CASE WHEN {_BY(P.DATE_WORDS)} THEN 'name_by_date' WHEN {_BY(P.VALUE_WORDS)} THEN 'name_by_value' ELSE 'name' END
 ELSE CASE WHEN {_any(_LOW, P.FOREIGN)} THEN 'free_trick' WHEN {_CASE_ASKED} THEN 'free_case' ELSE 'free_law' END END AS prompt, CASE answer_type WHEN 'free_text' THEN 1500 WHEN 'name' THEN 280 ELSE 80 END AS max_tokens FROM fx_all_questions""")
def prompt_route(t: Inputs) -> DataFrame:
    """The prompt and the length of the answer for each question."""
    return t.fx("all_questions").select("qid", T.prompt_kind(F.col("question"), F.col("answer_type")).alias("prompt"), T.answer_tokens(F.col("answer_type")).alias("max_tokens"))


@query(f"""SELECT qid, {_any(_LOW, P.FOREIGN)} OR (NOT regexp_matches(question, '{P.FOREIGN_CASE}') AND (regexp_matches(question, '{P.FOREIGN_LOOSE}') OR ({_any(_LOW, P.FOREIGN_CONCEPTS)} AND NOT {_any('lower(source)', P.FOREIGN_CONCEPTS)}))) AS trick FROM fx_results""")
def trick_question(t: Inputs) -> DataFrame:
    return t.fx("results").select("qid", T.is_foreign(F.col("question"), F.col("source")).alias("trick"))


@query(rf"SELECT qid, array_to_string(list_filter(regexp_extract_all(question, '{P.YEAR}'), lambda y, i: list_position(regexp_extract_all(question, '{P.YEAR}'), y) = i), '|') AS years FROM fx_results")
def question_years(t: Inputs) -> DataFrame:
    return t.fx("results").select("qid", JOINED(T.years(F.col("question"))).alias("years"))


def _count(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + ")"


@query(f"""SELECT doc_id, page, left(md5(text), 8) AS k, CASE WHEN {_count(P.CASE_SIGNALS)} >= 3 THEN 'CASE' WHEN {_count(P.LAW_SIGNALS)} >= 3 THEN 'LAW' WHEN {_count(P.REGULATION_SIGNALS)} >= 2 THEN 'REGULATION'
 WHEN {_count(P.CASE_SIGNALS)} > {_count(P.LAW_SIGNALS)} THEN 'CASE' ELSE 'LAW' END AS kind FROM fx_legal_text""")
def classify_doc(t: Inputs) -> DataFrame:
    return _legal(t).select("doc_id", "page", F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("k"), T.document_kind(F.col("text")).alias("kind"))


@query(r"SELECT doc_id, page, len(regexp_extract_all(replace(text, ', ', '......'), '\.{5,}')) >= 3 AS toc FROM fx_pages")
def toc_page(t: Inputs) -> DataFrame:
    return t.fx("pages").select("doc_id", "page", (F.regexp_count(F.replace(F.col("text"), F.lit(", "), F.lit("......")), F.lit(r"\.{5,}")) >= 3).alias("toc"))


@query(f"SELECT doc_id, translate(text, 'aeopcTH', 'аеорсТН') <> text AS changed, md5(translate(translate(text, 'aeopcTH', 'аеорсТН'), '{P.HOMOGLYPHS[0]}', '{P.HOMOGLYPHS[1]}')) AS digest FROM documents")
def homoglyphs(t: Inputs) -> DataFrame:
    from corpusmill.functions.answers import plain_letters

    mixed = F.translate("text", "aeopcTH", "аеорсТН")
    return t.table("documents").select("doc_id", (mixed != F.col("text")).alias("changed"), F.md5(plain_letters(mixed).cast("binary")).alias("digest"))


_CLEAN = "text || chr(10) || 'IN THE COURT OF FIRST INSTANCE' || chr(10) || chr(10) || chr(10) || '  17 ' || chr(10) || 'Page 3 of 9' || chr(10) || 'x'"
_DUCK_CLEAN = _CLEAN
for _p in P.BOILERPLATE:
    _DUCK_CLEAN = f"regexp_replace({_DUCK_CLEAN}, '{_p}', '', 'g')"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace({_DUCK_CLEAN}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def decontaminate(t: Inputs) -> DataFrame:
    """The text that is embedded, without boilerplate."""
    raw = F.concat("text", F.lit("\nIN THE COURT OF FIRST INSTANCE\n\n\n  17 \nPage 3 of 9\nx"))
    return t.table("documents").select("doc_id", F.md5(T.without_boilerplate(raw).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace('~~a' || chr(10) || '~~' || text || '~~x~~', '(?s)~~.*?~~', '', 'g')) AS digest FROM documents")
def strip_strike(t: Inputs) -> DataFrame:
    marked = F.concat(F.lit("~~a\n~~"), "text", F.lit("~~x~~"))
    return t.table("documents").select("doc_id", F.md5(F.regexp_replace(marked, r"(?s)~~.*?~~", "").cast("binary")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(left(text, 2000), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, coalesce(left(list_filter(lines[1:10], lambda x: length(x) > 10 AND NOT regexp_matches(x, '^\d+$') AND NOT starts_with(x, '#'))[1], 200), left(lines[1], 200), 'Untitled') AS title FROM l""")
def doc_title(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id", T.title(F.col("text")).alias("title"))


@query(r"SELECT item_id AS qid, CASE WHEN length(c) < 20 THEN text ELSE c END AS query FROM (SELECT item_id, text, trim(regexp_replace(text, ' in [A-Z][A-Za-z ]{25,}', '', 'g')) AS c FROM benchmark)")
def clean_query(t: Inputs) -> DataFrame:
    short = F.trim(F.regexp_replace("text", r" in [A-Z][A-Za-z ]{25,}", ""))
    return t.table("benchmark").select(F.col("item_id").alias("qid"), F.when(F.length(short) < 20, F.col("text")).otherwise(short).alias("query"))


@query(r"""SELECT qid, unnest(list_distinct(regexp_extract_all(question, '(?i)(?:CFI|SCT|CA|ARB|ENF)\s+\d+/\d{4}') || regexp_extract_all(question, '(?i)(?:DIFC\s+)?Law\s+No\.?\s*\d+') || regexp_extract_all(question, '(?:[A-Z][a-z]+ )+Law'))) AS identifier FROM fx_questions""")
def identifiers(t: Inputs) -> DataFrame:
    q = F.col("question")
    every = F.concat(T.found(q, r"(?i)(?:CFI|SCT|CA|ARB|ENF)\s+\d+/\d{4}"), T.found(q, r"(?i)(?:DIFC\s+)?Law\s+No\.?\s*\d+"), T.found(q, r"(?:[A-Z][a-z]+ )+Law"))
    return t.fx("questions").select("qid", F.explode(F.array_distinct(every)).alias("identifier"))


@query()
def nfkc(t: Inputs) -> DataFrame:
    """NFKC normalization; texts in ASCII never reach Python."""
    @pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    plain = ~F.col("text").rlike(r"[^\x00-\x7F]")
    docs = t.table("documents").select("doc_id", "text")
    return docs.where(plain).union(docs.where(~plain).select("doc_id", normal("text")))
