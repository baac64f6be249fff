"""Queries of sources, pages, chunks and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.functions.answers import truncated_sentence
from corpusmill.operators import corpus as C
from corpusmill.plans.fixtures import Inputs
from corpusmill.plans.registry import query


def digest(c):
    return F.md5(c.cast("binary"))


def key(t: DataFrame) -> DataFrame:
    return t.withColumn("k", F.substring(F.md5(F.col("text").cast("binary")), 1, 8))


@query("SELECT doc_id, page, md5(text) AS digest FROM fx_pages")
def scan_pages(t: Inputs) -> DataFrame:
    return C.pages_of(t.table("documents")).select("doc_id", "page", digest(F.col("text")).alias("digest"))


@query("SELECT doc_id, page FROM fx_pages WHERE length(trim(text)) < 100")
def ocr_candidates(t: Inputs) -> DataFrame:
    return t.fx("pages").where(F.length(F.trim("text")) < 100).select("doc_id", "page")


@query("SELECT w.doc_id, w.page, length(coalesce(p.text, '')) AS n FROM (SELECT doc_id, 2::INT AS page FROM documents) w LEFT JOIN fx_pages p ON w.doc_id = p.doc_id AND w.page = p.page")
def page_lookup(t: Inputs) -> DataFrame:
    wanted = t.table("documents").select("doc_id", F.lit(2).alias("page"))
    return wanted.join(t.fx("pages"), ["doc_id", "page"], "left").select("doc_id", "page", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@query("SELECT doc_id, count(*) AS n FROM fx_pages GROUP BY doc_id")
def page_count(t: Inputs) -> DataFrame:
    return t.fx("pages").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, page, length(text) AS n FROM fx_pages WHERE trim(text) <> ''")
def page_cache(t: Inputs) -> DataFrame:
    return t.fx("pages").where(F.trim("text") != "").select("doc_id", "page", F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id, page, md5(left(text, 2000)) AS digest FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM fx_pages) WHERE trim(text) <> '' AND (page <= 3 OR page > greatest(3, total - 3))""")
def head_tail_pages(t: Inputs) -> DataFrame:
    total = F.count("*").over(Window.partitionBy("doc_id"))
    pages = t.fx("pages").withColumn("total", total).where((F.trim("text") != "") & ((F.col("page") <= 3) | (F.col("page") > F.greatest(F.lit(3), F.col("total") - 3))))
    return pages.select("doc_id", "page", digest(F.substring("text", 1, 2000)).alias("digest"))


@query("""WITH m AS (SELECT doc_id, string_agg('<!-- PAGE ' || page || ' -->' || text, '' ORDER BY page) AS md FROM fx_pages GROUP BY doc_id)
SELECT doc_id, n::INT AS page, md5(trim(p)) AS digest FROM (SELECT doc_id, unnest(string_split_regex(md, '<!-- PAGE \\d+ -->')[2:]) AS p, unnest(regexp_extract_all(md, '<!-- PAGE (\\d+) -->', 1)) AS n FROM m)""")
def md_pages(t: Inputs) -> DataFrame:
    marked = C.joined_pages(t.fx("pages"), F.concat(F.lit("<!-- PAGE "), F.col("page").cast("string"), F.lit(" -->"), "text"), "", "md")
    parts = F.arrays_zip(T.found(F.col("md"), r"<!-- PAGE (\d+) -->", 1).alias("n"), F.slice(F.split("md", r"<!-- PAGE \d+ -->"), 2, 1 << 30).alias("p"))
    return marked.select("doc_id", F.explode(parts).alias("x")).select("doc_id", F.col("x.n").cast("int").alias("page"), digest(F.trim("x.p")).alias("digest"))


@query("""SELECT doc_id, md5(CASE WHEN length(trim(a)) < 0.8 * length(trim(text)) THEN a || chr(10) || chr(10) || text ELSE a END) AS digest FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN left(text, 50) ELSE text END AS a FROM documents)""")
def coverage_guard(t: Inputs) -> DataFrame:
    """A conversion that lost a fifth of the text gets the plain text appended."""
    a = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 50)).otherwise(F.col("text"))
    docs = t.table("documents").withColumn("a", a)
    whole = F.when(F.length(F.trim("a")) < 0.8 * F.length(F.trim("text")), F.concat("a", F.lit("\n\n"), "text")).otherwise(F.col("a"))
    return docs.select("doc_id", digest(whole).alias("digest"))


@query("""WITH s AS (SELECT doc_id, page, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM fx_pages),
p AS (SELECT doc_id, unnest([0, 100, 1000])::BIGINT AS at FROM documents) SELECT p.doc_id, p.at, max(s.page)::INT AS page FROM p JOIN s ON p.doc_id = s.doc_id AND s.at <= p.at GROUP BY ALL""")
def offset_to_page(t: Inputs) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.fx("pages").select("doc_id", "page", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long").alias("at"))
    points = t.table("documents").select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 1000)])).alias("at"))
    return C.last_at_or_before(points, starts, "doc_id", "at", "page")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_docs(t: Inputs) -> DataFrame:
    return t.table("documents").select("doc_id").join(t.table("labels"), "doc_id", "left_anti")


@query("SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.kind, n.kind) AS kind FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'manual' END AS kind FROM labels) o FULL JOIN (SELECT doc_id, source AS kind FROM documents) n ON o.doc_id = n.doc_id")
def merge_preserve_old(t: Inputs) -> DataFrame:
    old = t.table("labels").select("doc_id", F.when(F.col("quality") == 1, "manual").alias("old"))
    new = t.table("documents").select("doc_id", F.col("source").alias("new"))
    return old.join(new, "doc_id", "full").select("doc_id", F.coalesce("old", "new").alias("kind"))


@query("SELECT doc_id, coalesce(q, alt) AS question, list_count(ctx) AS n_contexts FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) END AS q, lang AS alt, [source, lang] AS ctx FROM documents) WHERE coalesce(q, alt) <> ''")
def eval_samples(t: Inputs) -> DataFrame:
    q = F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)), F.col("lang"))
    return t.table("documents").select("doc_id", q.alias("question"), F.size(F.array("source", "lang")).cast("long").alias("n_contexts")).where("question <> ''")


def _stripped_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _cut_sql(x: str) -> str:
    """Non-empty pieces between marks."""
    return f"list_filter(list_transform(string_split({x}, chr(1)), lambda c: {_stripped_sql('c')}), lambda c: c <> '')"


_HEADED = _cut_sql(r"regexp_replace(text, '(?i)\n((?:Article|Section|Part|Schedule|Appendix|Chapter)\s+[\dIVXivx]+)', chr(1) || chr(10) || '\1', 'g')")
_BLANKS = _cut_sql(r"regexp_replace(text, '\n{2,}', chr(1), 'g')")
_PARTED = r"list_filter(string_split(regexp_replace(x, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_HARD = "list_transform(range(0, (length(s) - 1) // 500 + 1), lambda i: substr(s, i * 500 + 1, 500))"


@query(f"""WITH p AS (SELECT doc_id, page, text, {_HEADED} AS h, {_BLANKS} AS b FROM fx_pages), parts AS (SELECT doc_id, page, text, CASE WHEN len(h) >= 2 THEN h ELSE b END AS parts FROM p),
small AS (SELECT doc_id, page, text, flatten(list_transform(parts, lambda x: CASE WHEN length(x) <= 500 THEN [x] ELSE flatten(list_transform({_PARTED}, lambda s: CASE WHEN length(s) <= 500 THEN [s] ELSE {_HARD} END)) END)) AS small FROM parts),
packed AS (SELECT doc_id, page, text, CASE WHEN len(small) > 0 THEN list_reduce(list_transform(small, lambda x: {{'done': []::VARCHAR[], 'last': x}}), lambda s, x: CASE WHEN s['last'] = '' THEN {{'done': s['done'], 'last': x['last']}}
 WHEN length(s['last']) + 2 + length(x['last']) <= 500 THEN {{'done': s['done'], 'last': s['last'] || chr(10) || chr(10) || x['last']}} ELSE {{'done': list_append(s['done'], s['last']), 'last': x['last']}} END) END AS s FROM small),
chunks AS (SELECT doc_id, page, CASE WHEN length(text) < 500 THEN list_filter([{_stripped_sql('text')}], lambda x: x <> '') WHEN s IS NULL THEN [] WHEN s['last'] <> '' THEN list_append(s['done'], s['last']) ELSE s['done'] END AS c FROM packed)
SELECT doc_id, page, (generate_subscripts(c, 1) - 1)::INT AS chunk_idx, unnest(c) AS text FROM chunks""")
def split_chunks(t: Inputs) -> DataFrame:
    """Chunks of all pages (tests hold them against a plain loop)."""
    pages = t.fx("pages").withColumn("c", C.chunks(F.col("text")))
    return pages.select("doc_id", "page", F.posexplode("c").alias("chunk_idx", "text"))


def _end_sql(at: str) -> str:
    """Where the chunk that starts at ``at`` ends: past the last blank line, sentence or blank of its window's second half."""
    w = f"substr(d.text, {at} + 1, 500)"
    place = lambda m: f"CASE WHEN contains({w}, {m}) THEN length({w}) - instr(reverse({w}), reverse({m})) + 1 ELSE 0 END"
    line, stop = place("chr(10) || chr(10)"), f"greatest({place(chr(39) + '. ' + chr(39))}, {place(chr(39) + '.' + chr(39) + ' || chr(10)')})"
    blank = place("' '")
    return f"CASE WHEN {at} + 500 >= length(d.text) THEN length(d.text) WHEN {line} > 250 THEN {at} + ({line}) WHEN {stop} > 250 THEN {at} + {stop} WHEN {blank} > 250 THEN {at} + ({blank}) ELSE {at} + 500 END"


@query(f"""WITH RECURSIVE c AS (SELECT d.doc_id, 0::BIGINT AS s, ({_end_sql('0')})::BIGINT AS e FROM documents d WHERE length(d.text) > 0
UNION ALL SELECT d.doc_id, greatest(c.s + 1, c.e - 50), {_end_sql('greatest(c.s + 1, c.e - 50)')} FROM c JOIN documents d ON d.doc_id = c.doc_id WHERE c.e < length(d.text))
SELECT * FROM (SELECT c.doc_id, s::INT AS start, e::INT AS "end", {_stripped_sql('substr(d.text, s + 1, e - s)')} AS text FROM c JOIN documents d ON d.doc_id = c.doc_id) WHERE text <> ''""")
def chunk_rcts(t: Inputs) -> DataFrame:
    """Overlapping chunks of all documents (tests hold them against their rules)."""
    return C.overlapping_chunks(t.table("documents"))


@query(r"""WITH l AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM fx_pages),
e AS (SELECT DISTINCT doc_id, page, unnest([l[1], l[-1]]) AS line FROM l), n AS (SELECT doc_id, count(*) AS pages FROM fx_pages GROUP BY doc_id HAVING count(*) >= 3)
SELECT doc_id, line, count(*) AS n FROM e JOIN n USING (doc_id) WHERE length(line) > 5 GROUP BY doc_id, line, pages HAVING count(*) * 2 >= pages""")
def repeated_headers(t: Inputs) -> DataFrame:
    return C.repeated_edges(t.fx("pages"))


@query("SELECT doc_id, md5('=== ' || left(any_value(first), 100) || ' ===' || chr(10) || string_agg('[PAGE ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS digest FROM (SELECT p.*, first_value(text) OVER (PARTITION BY doc_id ORDER BY page) AS first FROM fx_pages p) GROUP BY doc_id")
def doc_context(t: Inputs) -> DataFrame:
    whole = C.joined_pages(t.fx("pages"), F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n"), "text"), "\n\n")
    first = t.fx("pages").where("page = 1").select("doc_id", F.substring("text", 1, 100).alias("first"))
    return whole.join(first, "doc_id").select("doc_id", digest(F.concat(F.lit("=== "), "first", F.lit(" ===\n"), "text")).alias("digest"))


_HEAD_SQL = " UNION ALL ".join(rf"SELECT doc_id, page, {i} AS i, {level} AS level, unnest(regexp_extract_all(x, '{p}')) AS h FROM l" for i, (level, p) in enumerate(P.HEADINGS))


@query(rf"WITH l AS (SELECT doc_id, page, replace(text, ', ', chr(10)) AS x FROM fx_legal_text), h AS ({_HEAD_SQL}) SELECT doc_id, trim(h) AS heading, arg_min(page, i * 1000000 + page)::INT AS page, arg_min(level, i * 1000000 + page)::INT AS level FROM h GROUP BY doc_id, trim(h)")
def headings(t: Inputs) -> DataFrame:
    lined = t.fx("legal_text").withColumn("text", F.replace("text", F.lit(", "), F.lit("\n")))
    return C.headings(lined, P.HEADINGS)


@query(r"SELECT doc_id, page, k, left(h, 120) AS context FROM (SELECT doc_id, page, left(md5(text), 8) AS k, regexp_extract(text, '(?i)(?:Article|Section|Schedule)\s+\d+[^.\n]*') AS h FROM fx_legal_text)")
def chunk_context_header(t: Inputs) -> DataFrame:
    return key(t.fx("legal_text")).select("doc_id", "page", "k", F.substring(F.regexp_extract("text", r"(?i)(?:Article|Section|Schedule)\s+\d+[^.\n]*", 0), 1, 120).alias("context"))


@query("SELECT doc_id, page, md5('[DOCUMENT: ' || replace(replace('[' || doc_id || ']', '[', ''), ']', '') || ' | page ' || page || ']' || chr(10) || chr(10) || text) AS digest FROM fx_pages")
def chunk_prefix(t: Inputs) -> DataFrame:
    name = F.translate(F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")), "[]", "")
    prefixed = F.concat(F.lit("[DOCUMENT: "), name, F.lit(" | page "), F.col("page").cast("string"), F.lit("]\n\n"), "text")
    return t.fx("pages").select("doc_id", "page", digest(prefixed).alias("digest"))


@query("""SELECT doc_id, page, md5(concat_ws(chr(10) || chr(10), CASE WHEN trim(b) <> '' THEN '[PRECEDING PAGE ' || (page - 1) || ']' || chr(10) || b END, text, CASE WHEN trim(a) <> '' THEN '[FOLLOWING PAGE ' || (page + 1) || ']' || chr(10) || a END)) AS digest
FROM (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM fx_pages WINDOW w AS (PARTITION BY doc_id ORDER BY page))""")
def adjacent_pages(t: Inputs) -> DataFrame:
    return C.with_neighbours(t.fx("pages")).select("doc_id", "page", digest(F.col("text")).alias("digest"))


@query("""WITH n AS (SELECT doc_id, count(*)::INT AS total FROM fx_pages GROUP BY doc_id), h AS (SELECT doc_id, (doc_id % total + 1)::INT AS hit, total FROM n),
w AS (SELECT DISTINCT doc_id, unnest(range(greatest(1, hit - 2), least(total, hit + 2) + 1) || [1] || CASE WHEN total > 10 THEN [3, 4] ELSE [] END)::INT AS page FROM h) SELECT doc_id, page FROM w""")
def context_window(t: Inputs) -> DataFrame:
    n = t.fx("pages").groupBy("doc_id").agg(F.count("*").cast("int").alias("total")).withColumn("hit", (F.col("doc_id") % F.col("total") + 1).cast("int"))
    near = F.sequence(F.greatest(F.lit(1), F.col("hit") - 2), F.least("total", F.col("hit") + 2))
    more = F.when(F.col("total") > 10, F.array(F.lit(3), F.lit(4))).otherwise(F.array().cast("array<int>"))
    return n.select("doc_id", F.explode(F.array_distinct(F.concat(near, F.array(F.lit(1)), more))).alias("page"))


@query("""SELECT qid, string_agg('[SOURCE ' || k || ' | Page: ' || page || ']', chr(10) || '---' || chr(10) ORDER BY k) AS context FROM (SELECT doc_id AS qid, page, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) AS k FROM fx_pages) WHERE k <= 3 GROUP BY qid""")
def prompt_context(t: Inputs) -> DataFrame:
    from corpusmill.operators.retrieval import top_k

    top = top_k(t.fx("pages").select(F.col("doc_id").alias("qid"), "page"), ["qid"], [F.col("page").desc()], 3, "k")
    parts = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("[SOURCE "), F.col("k").cast("string"), F.lit(" | Page: "), F.col("page").cast("string"), F.lit("]")).alias("p"))))
    return top.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n---\n").alias("context"))


_SENTENCES = r"string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(r"""WITH w AS (SELECT doc_id, text, left(text, 705) AS w FROM documents), p AS (SELECT *, regexp_extract(w, '(?s)^(.*[.!?])(?:\s|$)', 1) AS sentence, regexp_extract(w, '(?s)^(.*)\s', 1) AS blank FROM w)
SELECT doc_id, CASE WHEN length(text) <= 705 THEN text WHEN length(sentence) > 352 THEN sentence WHEN length(blank) > 352 THEN regexp_replace(blank, '^\s+|\s+$', '', 'g') ELSE w END AS text FROM p""")
def truncate_sentence(t: Inputs) -> DataFrame:
    """Texts cut at a whole sentence within 705 characters (tests hold them against a plain loop as well)."""
    return t.table("documents").select("doc_id", truncated_sentence(F.col("text")).alias("text"))
