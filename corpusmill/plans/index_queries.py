"""Queries of the index builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import said as S
from corpusmill.operators import indexes as X
from corpusmill.operators.corpus import entity_sentences as entity_sentences_of
from corpusmill.operators.corpus import joined_pages
from corpusmill.plans.corpus_queries import _SENTENCES
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query

_KEYS = rf"list_transform(regexp_extract_all(text, '{P.ARTICLE}', 1), lambda x: 'article_' || x) || list_transform(regexp_extract_all(text, '{P.SCHEDULE}', 1), lambda x: 'schedule_' || x) || list_transform(regexp_extract_all(text, '{P.PART}', 1), lambda x: 'part_' || x) || list_transform(regexp_extract_all(text, '{P.APPENDIX}', 1), lambda x: 'appendix_' || x)"


_HEADING = "coalesce(" + ", ".join(rf"'{kind}_' || regexp_replace(nullif(regexp_extract(trim(heading), '(?i)^{kind}\s+({number})', 1), ''), '^(\d+)\((\d+)\)$', '\1_sub_\2')" for kind, number in X.HEADING_NUMBERS.items()) + ")"


@query(f"SELECT n, {_HEADING} AS key FROM fx_heading_lines")
def heading_key(t: Inputs) -> DataFrame:
    return t.fx("heading_lines").select("n", X.heading_key(F.col("heading")).alias("key"))


@query(f"""WITH r AS (SELECT doc_id, key, min(page) AS page FROM (SELECT doc_id, page, unnest({_KEYS}) AS key FROM fx_legal_text) GROUP BY ALL),
d AS (SELECT l_orderkey AS doc_id, 'schedule_' || l_linenumber AS key, max(l_linenumber) + 100 AS page FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, coalesce(d.key, r.key) AS key, coalesce(d.page, r.page) AS page FROM r FULL JOIN d ON r.doc_id = d.doc_id AND r.key = d.key""")
def article_pages_merge(t: Inputs) -> DataFrame:
    """Pages from document structure win over pages from patterns."""
    read = X.article_pages(t.fx("legal_text")).groupBy("doc_id", "key").agg(F.min("page").alias("page"))
    told = t.table("lineitem").where("l_linenumber % 2 = 0").groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("schedule_"), F.col("l_linenumber").cast("string")).alias("key")).agg((F.max("l_linenumber") + 100).alias("told"))
    return read.join(told, ["doc_id", "key"], "full").select("doc_id", "key", F.coalesce("told", "page").alias("page"))


_SHAPED = "CASE WHEN doc_id % 3 <> 0 AND (doc_id + page) % 4 = 0 THEN 'IT IS HEREBY ORDERED' WHEN (doc_id * page) % 3 = 1 THEN '2. and so on' WHEN doc_id % 5 = 1 THEN 'Dated today' WHEN doc_id % 7 = 3 THEN 'Issued by: x' ELSE 'text' END"


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, page, {_SHAPED} AS text, max(page) OVER (PARTITION BY doc_id) AS n, bool_or({_SHAPED} = 'IT IS HEREBY ORDERED') OVER (PARTITION BY doc_id) AS any_marked FROM fx_pages),
o AS (SELECT doc_id, page FROM p WHERE text = 'IT IS HEREBY ORDERED' OR (NOT any_marked AND n > 2 AND page = n AND text IN ('Dated today', 'Issued by: x')) UNION SELECT p.doc_id, p.page FROM o JOIN p ON p.doc_id = o.doc_id AND p.page = o.page + 1 AND starts_with(p.text, '2.'))
SELECT doc_id, page FROM o UNION SELECT doc_id, page FROM p WHERE page = n AND text = 'Issued by: x'""")
def order_pages(t: Inputs) -> DataFrame:
    return X.order_pages(t.fx("pages").select("doc_id", "page", F.expr(_SHAPED).alias("text")))


@query("SELECT doc_id, coalesce(min(CASE WHEN page <= 3 AND (contains(text, 'Date:') OR doc_id % 5 = page) THEN page END), 1)::INT AS page FROM fx_pages GROUP BY doc_id")
def date_page(t: Inputs) -> DataFrame:
    marked = F.when(F.col("doc_id") % 5 == F.col("page"), F.concat("text", F.lit(" Date: x"))).otherwise(F.col("text"))
    return X.date_page(t.fx("pages").withColumn("text", marked))


_CASE_KEY = "upper(m.p) || ' ' || lpad(m.n, greatest(3, length(m.n))::INT, '0') || '/' || m.y"
_TOLD = f"list_transform(regexp_extract_all(case_id, '{P.CASE_ID}', ['p', 'n', 'y']), lambda m: {_CASE_KEY})[1]"
_READ = f"list_transform(regexp_extract_all(first_page, '{P.CASE_ID}', ['p', 'n', 'y']), lambda m: {_CASE_KEY})[1]"


@query(f"SELECT coalesce({_TOLD}, {_READ}) AS case_id, count(*) AS n, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id) AS docs FROM fx_case_meta WHERE coalesce({_TOLD}, {_READ}) IS NOT NULL GROUP BY 1")
def case_index(t: Inputs) -> DataFrame:
    """Documents by canonical case number, as told or as the first page has it."""
    docs = F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), "|")
    return X.case_index(t.fx("case_meta")).groupBy("case_id").agg(F.count("*").alias("n"), docs.alias("docs"))


_NAMES = lambda c: f"list_sort(list_distinct(list_filter(list_transform(split({c}, ';'), lambda x: upper(trim(x))), lambda x: x <> '')))"
_FIELDS, _PARTIES = ["told", "case_type", "date_of_issue"], ["claimant", "defendant"]


@query(f"""WITH a AS (SELECT * FROM fx_auto_index), m AS (SELECT * FROM fx_manual_index), c AS (SELECT x.n AS a, y.n AS m FROM (SELECT case_id, count(*) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT case_id, count(*) AS n FROM m GROUP BY 1) y ON x.case_id = y.case_id),
d AS (SELECT {', '.join(f'a.{f} IS NOT DISTINCT FROM m.{f} AS {f}' for f in _FIELDS)}, {', '.join(f'{_NAMES(f"a.{f}")} = {_NAMES(f"m.{f}")} AS {f}' for f in _PARTIES)} FROM a JOIN m ON a.case_id = m.case_id AND a.doc_id = m.doc_id)
SELECT 'cases' AS what, count(*) AS total, count_if(a IS NOT NULL AND m IS NOT NULL)::BIGINT AS correct FROM c UNION ALL SELECT 'auto_only', count_if(m IS NULL), 0 FROM c UNION ALL SELECT 'manual_only', count_if(a IS NULL), 0 FROM c
UNION ALL SELECT 'doc_counts', count_if(a IS NOT NULL AND m IS NOT NULL), count_if(a = m) FROM c {' '.join(f"UNION ALL SELECT '{f}', count(*), count_if({f}) FROM d" for f in [*_FIELDS, *_PARTIES])}""")
def index_validation(t: Inputs) -> DataFrame:
    """A case index against one made by hand: cases, numbers of documents, and each field."""
    split = {c: F.split(c, ";") for c in _PARTIES}
    return X.index_agreement(t.fx("auto_index").withColumns(split), t.fx("manual_index").withColumns(split), _FIELDS, _PARTIES)


_EDITIONS = """WITH e AS (SELECT *, lower(name) AS key, min(doc_id) OVER (PARTITION BY lower(name)) AS first FROM fx_editions), latest AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY year DESC, doc_id) = 1)"""


@query(_EDITIONS + " SELECT key, name, doc_id, year, first FROM latest")
def latest_edition(t: Inputs) -> DataFrame:
    """The edition with the latest year of each name; the first one on ties."""
    return X.latest_editions(t.fx("editions"))


@query(_EDITIONS + r""", v AS (SELECT doc_id, first, unnest([1, 2, 3, 4]) AS i, unnest([key, regexp_replace(key, '\s+\d{4}$', ''), regexp_replace(key, '^difc\s+', ''), regexp_replace(key, '\s+law$', '')]) AS name FROM latest)
SELECT name, doc_id FROM v WHERE length(name) > 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY first DESC, i DESC) = 1""".replace("\\\\", "\\"))
def law_variants(t: Inputs) -> DataFrame:
    """Ways to write the names of the latest editions; of two laws the later one has a name."""
    return X.name_variants(X.latest_editions(t.fx("editions")))


_REFS = " UNION ".join(rf"SELECT doc_id, page, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS context FROM fx_legal_text" for k, p in (("article", P.ARTICLE), ("schedule", P.SCHEDULE), ("law", P.LAW_NUMBER), ("case", P.CASE_ID)))


@query(f"SELECT doc_id, page, type, context FROM ({_REFS})")
def xref_dedup(t: Inputs) -> DataFrame:
    return X.references(t.fx("legal_text"))


@query(f"SELECT context, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM ({_REFS}) GROUP BY context HAVING count(DISTINCT doc_id) >= 2")
def bridge_entities(t: Inputs) -> DataFrame:
    return X.bridges(X.references(t.fx("legal_text")))


@query(f"""WITH refs AS (SELECT DISTINCT doc_id, page, context AS entity FROM ({_REFS})), s AS (SELECT doc_id, page, unnest(list_transform({_SENTENCES}, lambda x: trim(x))) AS sentence FROM fx_legal_text)
SELECT doc_id, page, entity, sentence FROM s JOIN refs USING (doc_id, page) WHERE contains(lower(sentence), lower(entity)) AND length(sentence) > 20""")
def entity_sentences(t: Inputs) -> DataFrame:
    """Sentences that hold one of their page's entities; one that a full stop parts is in none."""
    entities = X.references(t.fx("legal_text")).select("doc_id", "page", F.col("context").alias("entity")).distinct()
    return entity_sentences_of(t.fx("legal_text"), entities)


@query("""WITH k AS (SELECT n_nationkey AS id, lower(n_name) || ' law' AS name FROM nation), q AS (SELECT n_nationkey AS qid, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'the ' || lower(n_name) || ' law of 2004' ELSE lower(n_name) || ' law' END AS part FROM nation)
SELECT qid, arg_min(id, (name <> part)::INT * 1000 + id) AS id FROM q JOIN k ON contains(k.name, q.part) OR contains(q.part, k.name) GROUP BY qid""")
def law_resolve(t: Inputs) -> DataFrame:
    """A known law for a name as it is written: the same name, else the first that contains it or is contained in it."""
    low = F.lower("n_name")
    known = t.table("nation").select(F.col("n_nationkey").alias("id"), F.concat(low, F.lit(" law")).alias("name"))
    written = F.when(F.col("n_nationkey") % 3 == 0, low).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("the "), low, F.lit(" law of 2004"))).otherwise(F.concat(low, F.lit(" law")))
    return X.resolved_names(t.table("nation").select(F.col("n_nationkey").alias("qid"), written.alias("part")), known)


@query("SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY page)) AS digest FROM fx_pages GROUP BY doc_id")
def doc_text(t: Inputs) -> DataFrame:
    return joined_pages(t.fx("pages"), F.col("text"), "\n").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT case_id, doc_ord, date_page FROM fx_case_docs WHERE date_of_issue IS NOT NULL")
def doc_date_pages(t: Inputs) -> DataFrame:
    return t.fx("case_docs").where("date_of_issue is not null").select("case_id", "doc_ord", "date_page")


_INDEXED_DOCS = "SELECT doc FROM fx_papers UNION SELECT doc FROM fx_court_orders"
_LOOSE = f"""heads AS (SELECT doc_id, coalesce(max(CASE WHEN page = 1 THEN text END), '') AS p1, coalesce(max(CASE WHEN page = 2 THEN text END), '') AS p2 FROM fx_loose_pages WHERE doc_id NOT IN ({_INDEXED_DOCS}) GROUP BY doc_id),
read AS (SELECT *, lower(p1 || ' ' || p2) AS both_pages, nullif(regexp_extract(p1 || p2, '{P.PAPER_TITLE}', 1), '')::INT::VARCHAR AS paper, regexp_extract(p1 || p2, '20\\d{{2}}') AS year, regexp_extract(p1, '{P.LOOSE_CASE}', ['p', 'n', 'y']) AS c, regexp_extract(p1, '{P.LOOSE_LAW}', ['n', 'y']) AS l FROM heads),
told AS (SELECT doc_id, CASE WHEN trim(both_pages) = '' THEN [] WHEN contains(both_pages, '{P.RULES_TITLE}') THEN [{', '.join(f"'{w}'" for w in P.COURT_RULES)}, 'rdc']
  WHEN paper IS NOT NULL THEN CASE WHEN year <> '' AND NOT EXISTS (SELECT 1 FROM fx_papers p WHERE p.number::VARCHAR = paper AND p.year::VARCHAR = r.year) THEN ['cp_' || paper || '_of_' || year, 'consultation paper no. ' || paper || ' of ' || year, 'consultation paper no ' || paper || ' of ' || year] ELSE [] END
  WHEN c.p <> '' THEN [lower(c.p) || ' ' || try_cast(c.n AS INT) || '/' || c.y, lower(c.p) || ' ' || c.n || '/' || c.y]
  WHEN contains(both_pages, 'law no.') AND contains(left(both_pages, 200), 'difc') THEN CASE WHEN l.n <> '' THEN ['difc law no. ' || l.n || ' of ' || l.y] ELSE [] END WHEN contains(both_pages, '{P.ROADMAP}') THEN ['roadmap to proposed changes'] ELSE [] END AS keys FROM read r),
loose AS (SELECT key, max(doc_id) AS doc_id FROM (SELECT doc_id, unnest(keys) AS key FROM told) GROUP BY key)"""


def _keyword_index(t: Inputs) -> DataFrame:
    papers = t.fx("papers")
    indexed = papers.select(F.col("doc").alias("doc_id")).unionByName(t.fx("court_orders").select(F.col("doc").alias("doc_id")))
    return X.keyword_index(t.fx("loose_pages"), indexed, papers)


@query(f"WITH {_LOOSE} SELECT key, doc_id FROM loose")
def kw_doc_index(t: Inputs) -> DataFrame:
    """Keys of documents that no other index has: court rules, papers, cases, laws, a roadmap; the first kind that fits."""
    return _keyword_index(t)


@query(f"""WITH {_LOOSE}, refs AS (SELECT qid, unnest(regexp_extract_all(question, '{P.PAPER}', ['n', 'y'])) AS m FROM fx_paper_questions),
found AS (SELECT qid, 'rdc' AS key FROM fx_paper_questions WHERE {' OR '.join(f"contains(lower(question), '{w}')" for w in P.COURT_RULES)} UNION SELECT qid, 'cp_' || m.n::INT || '_of_' || m.y FROM refs WHERE m.y <> '' AND NOT EXISTS (SELECT 1 FROM fx_papers p WHERE p.number::VARCHAR = m.n AND p.year::VARCHAR = m.y))
SELECT DISTINCT qid, doc_id FROM found JOIN loose USING (key)""")
def route_unindexed(t: Inputs) -> DataFrame:
    """Documents of no other index for questions about the court rules and about papers."""
    return X.route_unindexed(t.fx("paper_questions"), _keyword_index(t), t.fx("papers"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM fx_pages UNION ALL SELECT 'case_docs', count(*) FROM fx_case_docs")
def index_counts(t: Inputs) -> DataFrame:
    tables = {"documents": t.table("documents"), "pages": t.fx("pages"), "case_docs": t.fx("case_docs")}
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT CASE WHEN page % 2 = 0 THEN 'CASE' ELSE 'LAW' END AS kind, count(*) AS n, count(nullif(regexp_extract(CASE WHEN page % 3 = 0 THEN '' ELSE text END, 'CFI \\d+/\\d{4}'), '')) AS with_id FROM fx_legal_text GROUP BY 1")
def classify_counts(t: Inputs) -> DataFrame:
    """Documents by kind, and how many of them have a case number."""
    text = F.when(F.col("page") % 3 == 0, "").otherwise(F.when(F.col("page") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit("claim"), F.lit("matter"))))
    marked = t.fx("legal_text").select("page", text.alias("text"), F.when(F.col("page") % 2 == 0, F.lit("the claim")).otherwise(F.lit("an enactment")).alias("head"))
    kind = F.when(F.contains(F.lower("head"), F.lit("claim")), "CASE").otherwise("LAW")
    return marked.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"CFI \d+/\d{4}")).alias("with_id"))


@query("SELECT l.doc_id AS qid, p.doc_id, p.page, p.doc_id - l.doc_id AS pos FROM labels l JOIN fx_pages p ON p.doc_id IN (l.doc_id, l.doc_id + 1)")
def chunks_for_docs(t: Inputs) -> DataFrame:
    """Pages of the documents that each question asks for, with their place in its list."""
    wanted = t.table("labels").select(F.col("doc_id").alias("qid"), F.posexplode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("pos", "doc_id"))
    return t.fx("pages").join(wanted, "doc_id").select("qid", "doc_id", "page", F.col("pos").cast("long").alias("pos"))


@query(r"""WITH m AS (SELECT doc_id, page, text, regexp_extract_all(text, '(?i)Article\s+\d+|\(\d+\)') AS m FROM fx_legal_text), h AS (SELECT doc_id, page, text, unnest(m) AS m, generate_subscripts(m, 1) AS pos FROM m),
a AS (SELECT *, last_value(CASE WHEN lower(m) LIKE 'article%' THEN regexp_extract(m, '\d+') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, md5(text), pos ROWS UNBOUNDED PRECEDING) AS article FROM h)
SELECT doc_id, 'article_' || article || '_sub_' || regexp_extract(m, '\d+') AS key, min(page) AS page FROM a WHERE m LIKE '(%' AND article IS NOT NULL GROUP BY ALL""")
def subsection_pages(t: Inputs) -> DataFrame:
    return X.subsection_pages(t.fx("legal_text"))


@query(rf"""WITH r AS (SELECT DISTINCT doc_id, page, unnest(regexp_extract_all(text, '{P.LAW_NUMBER}')) AS context FROM fx_legal_text), t AS (SELECT doc_id, page, min(text) AS text FROM fx_legal_text GROUP BY ALL),
shared AS (SELECT context FROM r GROUP BY context HAVING count(DISTINCT doc_id) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY doc_id, page) AS n FROM r JOIN shared USING (context) QUALIFY n <= 3)
SELECT context, string_agg('[' || doc_id || ':' || page || '] ' || left(text, 200), ' || ' ORDER BY doc_id, page) AS fact FROM k JOIN t USING (doc_id, page) GROUP BY context""")
def bridging_facts(t: Inputs) -> DataFrame:
    """The text of up to three pages for each law that several documents refer to."""
    return X.bridging_facts(t.fx("legal_text"), "law", 3, 200)


# -- what models say

_BRACES = r"regexp_extract(said, '(?s)\{.*\}')"


@query(rf"""WITH o AS (SELECT qid, CASE WHEN json_valid(nullif({_BRACES}, '')) THEN {_BRACES} END AS o FROM fx_said_objects) SELECT qid, json_extract_string(o, '$.judge') AS judge, try_cast(json_extract_string(o, '$.page') AS INT) AS page FROM o""")
def llm_json_parse(t: Inputs) -> DataFrame:
    """Metadata from a model's answer: the outermost braces, parsed with a fixed schema; null where that fails."""
    said = S.object_in(F.col("said"), "judge string, page int")
    return t.fx("said_objects").select("qid", said.alias("m")).select("qid", "m.judge", "m.page")


_BARE = r"trim(regexp_replace(regexp_replace(trim(said), '^```(?:json)?\s*', ''), '\s*```$', ''))"


@query(f"""WITH b AS (SELECT qid, CASE WHEN json_valid({_BARE}) THEN {_BARE} END AS j FROM fx_said_pairs), l AS (SELECT qid, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END) AS e FROM b)
SELECT qid, json_extract_string(e, '$.q') AS q, json_extract_string(e, '$.a') AS a FROM l WHERE json_extract_string(e, '$.q') IS NOT NULL AND json_extract_string(e, '$.a') IS NOT NULL""")
def aku_parse(t: Inputs) -> DataFrame:
    """Questions and answers from a model's JSON list, fenced or not; entries that lack one are dropped."""
    return t.fx("said_pairs").select("qid", F.explode(S.question_answers(F.col("said"))).alias("p")).select("qid", "p.q", "p.a")


_FLAT = r"regexp_replace(regexp_extract(said, '\{[^{}]+\}'), ',\s*\}', '}')"
_SCORES = f"""o AS (SELECT qid, CASE WHEN json_valid({_FLAT}) THEN {_FLAT} END AS o FROM fx_said_scores), k AS (SELECT qid, o, unnest(json_keys(o)) AS key FROM o WHERE o IS NOT NULL),
scores AS (SELECT qid, try_cast(key AS INT) AS item, try_cast(json_extract_string(o, '$."' || key || '"') AS DOUBLE) AS score FROM k WHERE try_cast(key AS INT) BETWEEN 1 AND 4 AND try_cast(json_extract_string(o, '$."' || key || '"') AS DOUBLE) IS NOT NULL)"""


def _said_scores(t: Inputs) -> DataFrame:
    return t.fx("said_scores").select("qid", F.explode(S.page_scores(F.col("said"), F.lit(4))).alias("s")).select("qid", "s.item", "s.score")


@query(f"WITH {_SCORES} SELECT qid, item, score FROM scores")
def parse_scores(t: Inputs) -> DataFrame:
    """Scores of four pages from a model's answer: the first flat object, a trailing comma forgiven, numbers only."""
    return _said_scores(t)


@query(f"""WITH {_SCORES}, p AS (SELECT qid, unnest([1, 2, 3, 4]) AS item FROM fx_said_scores), b AS (SELECT p.qid, p.item, (p.qid * 7 + p.item * 3) % 9 - 4.0 AS ce, s.score, count(s.score) OVER (PARTITION BY p.qid) AS told FROM p LEFT JOIN scores s ON s.qid = p.qid AND s.item = p.item),
m AS (SELECT *, CASE WHEN told > 0 THEN 0.7 * coalesce(least(1, greatest(0, score)), 0.5) + 0.3 / (1 + exp(-ce)) END AS mixed FROM b)
SELECT qid, item, round(mixed, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(mixed, 9) DESC, item) AS rank FROM m""")
def llm_blend(t: Inputs) -> DataFrame:
    """Four pages by a model's scores blended with another scorer's; in their order where the model's answer can't be read."""
    pages = t.fx("said_scores").select("qid", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("item")).withColumn("ce", (F.col("qid") * 7 + F.col("item") * 3) % 9 - 4.0)
    rows = pages.join(_said_scores(t), ["qid", "item"], "left")
    told = F.count("score").over(Window.partitionBy("qid")) > 0
    rows = rows.withColumn("mixed", F.when(told, S.blended(F.col("score"), F.col("ce"), 0.7)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("mixed", 9).desc(), "item"))
    return rows.select("qid", "item", F.round("mixed", 6).alias("score"), rank.cast("long").alias("rank"))


@query("""WITH p AS (SELECT qid, raw, json_type(raw) AS kind FROM fx_parties), n AS (SELECT qid, CASE kind WHEN 'ARRAY' THEN json_extract_string(raw, '$[*].name') WHEN 'OBJECT' THEN [json_extract_string(raw, '$.name')] || json_extract_string(raw, '$.names[*]') WHEN 'VARCHAR' THEN [json_extract_string(raw, '$')] ELSE [] END AS names FROM p)
SELECT qid, array_to_string(list_filter(names, lambda x: x IS NOT NULL AND x <> ''), '|') AS names FROM n""")
def party_names(t: Inputs) -> DataFrame:
    """Names of a party that is one object, several, a list of objects or a string."""
    return t.fx("parties").select("qid", F.array_join(S.party_names(F.col("raw")), "|").alias("names"))


@query("""WITH p AS (SELECT *, CASE WHEN starts_with(ltrim(raw), '{') THEN raw END AS o FROM fx_raw_passages), f AS (SELECT *, list_filter(json_keys(o), lambda k: starts_with(k, 'cite_')) AS keys FROM p)
SELECT qid, place, coalesce(trim(json_extract_string(o, '$.cite_' || (place + 1))), trim(json_extract_string(o, '$.' || keys[1])), raw) AS text FROM f""")
def passage_text(t: Inputs) -> DataFrame:
    """A passage's text: the field of its own number, else any numbered field, else all of it."""
    return t.fx("raw_passages").select("qid", "place", S.passage_text(F.col("raw"), F.col("place")).alias("text"))
