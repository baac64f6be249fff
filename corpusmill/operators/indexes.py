"""Index builders: article pages, order pages, case and law indexes, cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.functions.text import article_keys, contains_any, found
from corpusmill.operators.matching import containing
from corpusmill.storage import written


def article_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, key, page): pages on which each article, schedule, part or appendix of a document stands."""
    toc = F.regexp_count("text", F.lit(r"\.{5,}")) >= 3
    return pages.where(~toc).select("doc_id", "page", F.explode(article_keys(F.col("text"))).alias("key")).distinct()


# The parts that a heading may name, and how each is numbered.
HEADING_NUMBERS = {
    "article": r"\d+[A-Z]?(?:\(\d+\))?", "section": r"\d+[A-Z]?", "rule": r"\d+[A-Z]?", "regulation": r"\d+(?:\.\d+)?", "schedule": r"\d+",
    "part": r"[\dIVXL]+", "appendix": r"\d+", "chapter": r"[\dIVXL]+",
}


def heading_key(heading: Column) -> Column:
    """The index key of a heading: ``Article 5(1)`` is ``article_5_sub_1``, ``PART iv`` is ``part_iv``; null for any other heading."""
    keys = []
    for kind, number in HEADING_NUMBERS.items():
        n = F.regexp_extract(F.trim(heading), rf"(?i)^{kind}\s+({number})", 1)
        keys.append(F.when(n != "", F.concat(F.lit(kind + "_"), F.regexp_replace(n, r"^(\d+)\((\d+)\)$", "$1_sub_$2"))))
    return F.coalesce(*keys)


def document_entries(pages: DataFrame, headings: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc_id, kind, page_count, n_keys, order_pages, date_page, preamble_pages): the index entry of each document of ``pages`` (doc_id, page, text).

    ``headings`` (doc_id, key, page), ``kinds`` (doc_id, kind). A CASE has its order pages (ascending, perhaps none) and the page of its date of issue; a LAW or REGULATION has page one as its preamble."""
    sizes = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    keys = headings.groupBy("doc_id").agg(F.count_distinct("key").alias("n_keys"))
    court = kinds.where("kind = 'CASE'").select("doc_id")
    cases = pages.join(court, "doc_id", "left_semi")
    orders = order_pages(cases).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("orders"))
    dated = date_page(cases).withColumnRenamed("page", "date_page")
    rows = sizes.join(kinds, "doc_id").join(keys, "doc_id", "left").join(orders, "doc_id", "left").join(dated, "doc_id", "left")
    is_case, none = F.col("kind") == "CASE", F.array().cast("array<int>")
    return rows.select(
        "doc_id", "kind", "page_count", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), F.when(is_case, F.coalesce(F.col("orders").cast("array<int>"), none)).alias("order_pages"),
        F.when(is_case, F.col("date_page")).alias("date_page"), F.when(~is_case, F.array(F.lit(1))).alias("preamble_pages"),
    )


def document_kinds(pages: DataFrame) -> DataFrame:
    """(doc_id, kind): CASE, LAW or REGULATION by the marks of all pages; each page is looked at where it lies."""
    low = F.lower("text")
    marks = {"c": P.CASE_SIGNALS, "l": P.LAW_SIGNALS, "r": P.REGULATION_SIGNALS}
    found_on = [F.max(F.contains(low, F.lit(w)).cast("int")).alias(f"{k}{i}") for k, words in marks.items() for i, w in enumerate(words)]
    flags = pages.groupBy("doc_id").agg(*found_on)
    total = {k: sum((F.col(f"{k}{i}") for i in range(1, len(words))), F.col(f"{k}0")) for k, words in marks.items()}
    kind = F.when(total["c"] >= 3, "CASE").when(total["l"] >= 3, "LAW").when(total["r"] >= 2, "REGULATION").when(total["c"] > total["l"], "CASE").otherwise("LAW")
    return flags.select("doc_id", kind.alias("kind"))


def case_index(metadata: DataFrame) -> DataFrame:
    """(case_id, doc_id): documents of each case, from ``metadata`` (doc_id, case_id as it was told, first_page).

    The number is brought to its canonical form; where none was told, the first one on the first page counts; documents without either are left out."""
    told = F.when(F.trim("case_id") != "", T.case_id(F.col("case_id")))
    read = F.get(T.case_ids(F.col("first_page")), F.lit(0))
    return metadata.select(F.coalesce(told, read).alias("case_id"), "doc_id").where("case_id is not null")


def index_agreement(auto: DataFrame, manual: DataFrame, fields: list[str], parties: list[str]) -> DataFrame:
    """(what, total, correct): a case index against one made by hand; both have case_id, doc_id, ``fields`` and ``parties`` (arrays of names).

    ``cases``: case numbers of either, and those in both; ``auto_only`` and ``manual_only``: the others; ``doc_counts``: shared cases, and those with as many documents;
    for each field, over documents that both have in the same case, how often it is equal: nulls agree, names agree as sets in any case."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    cases = count(auto, "a").join(count(manual, "m"), "case_id", "full")
    both = F.col("a").isNotNull() & F.col("m").isNotNull()
    of_cases = cases.agg(
        F.struct(F.count("*").alias("total"), F.count_if(both).alias("correct")).alias("cases"), F.struct(F.count_if(F.col("m").isNull()).alias("total"), F.lit(0).cast("long").alias("correct")).alias("auto_only"),
        F.struct(F.count_if(F.col("a").isNull()).alias("total"), F.lit(0).cast("long").alias("correct")).alias("manual_only"),
        F.struct(F.count_if(both).alias("total"), F.count_if(both & (F.col("a") == F.col("m"))).alias("correct")).alias("doc_counts"),
    )
    names = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != "")))
    side = lambda df, p: df.select("case_id", "doc_id", *[F.col(c).alias(p + c) for c in fields], *[names(F.col(c)).alias(p + c) for c in parties])
    docs = side(auto, "a_").join(side(manual, "m_"), ["case_id", "doc_id"])
    of_docs = docs.agg(*[F.struct(F.count("*").alias("total"), F.count_if(F.col(f"a_{c}").eqNullSafe(F.col(f"m_{c}"))).alias("correct")).alias(c) for c in [*fields, *parties]])
    tall = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in df.columns])).alias("r")).select("r.what", "r.n.total", "r.n.correct")
    return tall(of_cases).unionByName(tall(of_docs))


def latest_editions(laws: DataFrame) -> DataFrame:
    """(key, name, doc_id, year, first): of ``laws`` (doc_id, name, year) the edition with the latest year for each name in lower case, the first document
    on ties; ``first`` is the document with which the name came up."""
    best = F.max_by(F.struct("name", "doc_id", "year"), F.struct(F.col("year"), -F.col("doc_id")))
    return laws.groupBy(F.trim(F.lower("name")).alias("key")).agg(best.alias("b"), F.min("doc_id").alias("first")).select("key", "b.*", "first")


def name_variants(editions: DataFrame) -> DataFrame:
    """(name, doc_id): ways to write the law names of ``latest_editions``: in full, without the year, without ``difc``, without ``law``; longer than three
    characters. Of two laws with one variant the later one has it."""
    drop = lambda p: F.regexp_replace("key", p, "")
    variants = F.array(F.col("key"), drop(r"\s+\d{4}$"), drop(r"^difc\s+"), drop(r"\s+law$"))
    rows = editions.select(F.posexplode(variants).alias("v", "variant"), "doc_id", "first").where(F.length("variant") > 3)
    return rows.groupBy(F.col("variant").alias("name")).agg(F.max_by("doc_id", F.struct("first", "v")).alias("doc_id"))


# Words that tell a law, in its title and in a question, and words that say nothing of a title.
LAW_GROUPS = {
    "employment": (["employment law", "employment rights"], ["employment law", "employment", "difc law no. 2 of 2019"]),
    "trust": (["trust law", "difc trust"], ["trust law", "difc trust law", "difc law no. 4 of 2018"]),
    "foundation": (["foundations law", "foundation law"], ["foundations law", "foundation", "difc law no. 3 of 2018"]),
    "personal property": (["personal property law"], ["personal property law", "difc law no. 9", "personal property"]),
    "operating": (["operating law", "law no. 7"], ["operating law", "difc law no. 7", "operating law 2018"]),
    "crs": (["common reporting standard", "crs law"], ["common reporting standard", "crs law", "crs", "difc law no. 2 of 2018"]),
    "general partnership": (["general partnership law", "gp law"], ["general partnership law", "general partnership", "gp law", "difc law no. 11"]),
    "limited liability partnership": (["limited liability partnership law", "llp law"], ["limited liability partnership law", "limited liability partnership", "llp law", "difc law no. 5 of 2004"]),
    "civil": (["civil and commercial", "application of civil"], ["civil and commercial laws", "application of civil", "civil and commercial"]),
}
TITLE_STOP_WORDS = [
    "difc", "law", "no", "of", "the", "and", "for", "a", "an", "regulations", "regulation", "rules", "rule", "code", "act", "consolidated", "version", "amended",
    "updated", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "january", "february",
]
#: Words of a title that may begin a fragment.
TITLE_WORDS = 6


def title_fragments(titles: DataFrame) -> DataFrame:
    """(fragment, doc_id, at): words of more than three characters and pairs of words from the beginnings of titles (doc_id, title), the part before an edition's
    mark; of several documents the first has a fragment, and ``at`` orders fragments by when they came up."""
    core = F.get(F.split(F.substring(F.lower("title"), 1, 200), r"\b(?:consolidated|version|amended)\b"), F.lit(0))
    words = F.filter(F.split(F.trim(core), r"[\W_]+"), lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOP_WORDS) & ~w.rlike(r"^\d+$"))
    each = titles.select("doc_id", words.alias("w")).select("doc_id", "w", F.posexplode(F.slice("w", 1, TITLE_WORDS)).alias("i", "word"))
    after = F.get(F.col("w"), F.col("i") + 1)
    both = F.array(F.struct(F.lit(0).alias("k"), F.when(F.length("word") > 3, F.col("word")).alias("fragment")), F.struct(F.lit(1).alias("k"), F.concat("word", F.lit(" "), after).alias("fragment")))
    rows = each.select("doc_id", "i", F.explode(both).alias("f")).where("f.fragment is not null")
    first = rows.groupBy("f.fragment").agg(F.min(F.struct("doc_id", "i", "f.k")).alias("at"))
    return first.select("fragment", "at.doc_id", "at")


def law_of_question(questions: DataFrame, titles: DataFrame, headings: DataFrame) -> DataFrame:
    """(qid, doc_id): the one law that each question (qid, question) is about, null if none can be told.

    The first of ``LAW_GROUPS`` whose words the question has decides, even if no title (doc_id, title) has them (of several titles the last); else the longest title fragment in
    the question, the first to come up on ties; else the first document in which the question's article begins (``headings``: doc_id, key, page)."""
    start = F.substring(F.lower("title"), 1, 500)
    first = lambda c, side: F.coalesce(*[F.when(T.contains_any(c, words[side]), F.lit(k)) for k, words in LAW_GROUPS.items()])
    # a text is looked at once, however many questions or titles have it
    each = written(titles.groupBy("title").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "each-title")
    grouped = each.select(first(start, 0).alias("law"), "last").where("law is not null").groupBy("law").agg(F.max("last").alias("by_group"))
    texts = written(questions.select("question").where("question is not null").distinct().withColumn("q", F.lower("question")), "asked-texts")
    asked = texts.select("question", "q", first(F.col("q"), 1).alias("law"), F.concat(F.lit("article_"), F.nullif(F.regexp_extract("question", r"(?i)article\s+(\d+)", 1), F.lit(""))).alias("key"))
    fragments = written(title_fragments(each.select("title", F.col("first").alias("doc_id"))).withColumn("f", F.xxhash64("fragment")), "fragments")
    rest = asked.where("law is null").withColumn("u", F.xxhash64("q"))
    hits = containing(rest.select("u", "q").distinct(), fragments, "u", "q", "f", "fragment")
    longest = hits.join(fragments, "f").groupBy("u").agg(F.max_by("doc_id", F.struct(F.length("fragment").alias("n"), -F.col("at.doc_id"), -F.col("at.i"), -F.col("at.k"))).alias("by_title"))
    articles = headings.groupBy("key").agg(F.min("doc_id").alias("by_article"))
    by_words = asked.where("law is not null").join(grouped, "law", "left").select("question", F.col("by_group").alias("doc_id"))
    by_rest = rest.join(longest, "u", "left").join(articles, "key", "left").select("question", F.coalesce("by_title", "by_article").alias("doc_id"))
    return questions.select("qid", "question").join(by_words.unionByName(by_rest), "question", "left").select("qid", "doc_id")


def order_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page): pages with an order's marks (without any, the last of more than two pages if it reads like an end), the
    run of numbered pages that goes on from each, and the last page if it says by whom or when it was issued."""
    w = Window.partitionBy("doc_id").orderBy("page")
    every = Window.partitionBy("doc_id")
    text = F.col("text")
    flagged = pages.select(
        "doc_id", "page", contains_any(text, P.ORDER_MARKS).alias("marked"), F.substring(F.trim("text"), 1, 300).rlike(r"^\d+\.").alias("goes_on"),
        contains_any(F.lower("text"), P.END_WORDS).alias("ends"), contains_any(text, P.ISSUE_MARKS).alias("issued"),
    )
    flagged = flagged.withColumns({"any": F.bool_or("marked").over(every), "n": F.max("page").over(every)})
    last = F.col("page") == F.col("n")
    flagged = flagged.withColumns({"last": last, "anchor": F.col("marked") | (~F.col("any") & (F.col("n") > 2) & last & F.col("ends"))})
    # a break is a page that neither is an anchor nor goes on; a run belongs to an anchor after the last break
    run = F.max(F.when(F.col("anchor"), F.col("page"))).over(w)
    stop = F.coalesce(F.max(F.when(~F.col("anchor") & ~F.col("goes_on"), F.col("page"))).over(w), F.lit(0))
    return flagged.withColumns({"m": run, "b": stop}).where("anchor or (goes_on and m > b) or (last and issued)").select("doc_id", "page")


def date_page(pages: DataFrame) -> DataFrame:
    """(doc_id, page): the first of the first three pages with a date mark, else one."""
    hit = F.when((F.col("page") <= 3) & contains_any(F.col("text"), P.DATE_MARKS), F.col("page"))
    return pages.groupBy("doc_id").agg(F.coalesce(F.min(hit), F.lit(1)).alias("page"))


#: What a page may refer to.
REFERENCES = {"article": P.ARTICLE, "schedule": P.SCHEDULE, "law": P.LAW_NUMBER, "case": P.CASE_ID}


def references(pages: DataFrame, *kinds: str) -> DataFrame:
    """(doc_id, page, type, context): references of a page, each once; of some ``kinds`` or of all."""
    every = F.array(*[F.struct(F.lit(k).alias("type"), found(F.col("text"), p).alias("c")) for k, p in REFERENCES.items() if k in kinds or not kinds])
    rows = pages.select("doc_id", "page", F.explode(every).alias("r"))
    return rows.select("doc_id", "page", "r.type", F.explode("r.c").alias("context")).distinct()


def bridges(refs: DataFrame) -> DataFrame:
    """(context, n, first): contexts that two or more documents refer to, how many do, and the first of them."""
    pairs = refs.select("context", "doc_id").distinct()
    return pairs.groupBy("context").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n >= 2")


def article_mentions(pages: DataFrame) -> DataFrame:
    """(doc_id, page, article): numbers of the articles that a page names, each once."""
    return pages.select("doc_id", "page", F.explode(F.array_distinct(found(F.col("text"), r"(?i)\bArticle\s+(\d+)\b", 1))).alias("article"))


def subsection_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, key, page): the first page of each sub-section ``(n)`` between an article's heading and the next.

    Pages of a document are read in order; what carries over is the current article."""
    hits = pages.select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("t"), F.posexplode(found(F.col("text"), r"(?i)Article\s+\d+|\(\d+\)")).alias("pos", "m"))
    w = Window.partitionBy("doc_id").orderBy("page", "t", "pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.regexp_extract("m", r"(\d+)", 1)
    article = F.last(F.when(F.lower("m").startswith("article"), number), ignorenulls=True).over(w)
    subs = hits.withColumns({"article": article, "number": number}).where(F.col("m").startswith("(") & F.col("article").isNotNull())
    key = F.concat(F.lit("article_"), "article", F.lit("_sub_"), "number")
    return subs.groupBy("doc_id", key.alias("key")).agg(F.min("page").alias("page"))


def cross_references(pages: DataFrame) -> DataFrame:
    """(doc_id, page, type, context, target): references to an article, schedule, part or appendix whose first page in the same document is another one."""
    targets = pages.select("doc_id", "page", F.explode(article_keys(F.col("text"))).alias("key")).groupBy("doc_id", "key").agg(F.min("page").alias("target"))
    refs = references(pages, "article", "schedule").withColumn("key", F.explode(article_keys(F.col("context"))))
    return refs.join(targets, ["doc_id", "key"]).where("target <> page").select("doc_id", "page", "type", "context", "target").distinct()


def resolved_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, id) of ``asked`` (qid, part) among ``known`` (id, name): the equal name, else the smallest id whose name contains
    the asked one or is contained in it. Known names are a fixed list of laws."""
    hits = asked.join(F.broadcast(known), F.contains("name", "part") | F.contains("part", "name"))
    return hits.groupBy("qid").agg(F.min_by("id", F.struct((F.col("name") != F.col("part")).alias("differs"), "id")).alias("id"))


def bridging_facts(pages: DataFrame, kind: str, most: int, chars: int) -> DataFrame:
    """(context, fact): for each reference of a kind that two or more documents share, the start of the first ``most`` pages
    that hold it, each after its place."""
    refs = references(pages, kind).select("context", "doc_id", "page")
    placed = refs.join(bridges(refs).select("context"), "context")
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy("context").orderBy("doc_id", "page"))).where(F.col("n") <= most)
    texts = pages.groupBy("doc_id", "page").agg(F.min("text").alias("text"))
    place = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(":"), F.col("page").cast("string"), F.lit("] "))
    parts = first.join(texts, ["doc_id", "page"]).select("context", F.struct("n", F.concat(place, F.substring("text", 1, chars)).alias("part")).alias("p"))
    return parts.groupBy("context").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), " || ").alias("fact"))


def _paper_key(number, year):
    return F.concat(F.lit("cp_"), number.cast("int").cast("string"), F.lit("_of_"), year.cast("string"))


def keyword_index(pages: DataFrame, indexed: DataFrame, papers: DataFrame) -> DataFrame:
    """(key, doc_id): what documents that no other index has (``indexed``: doc_id) are looked up by, from their first two ``pages`` (doc_id, page, text).

    The first kind that fits decides: the rules of the courts, a consultation paper (with a year from 2000 on, and not in ``papers``: number, year), a case by the number on its
    first page, a law by its number, the roadmap; a blank document has no key. Of several documents the last one has a key."""
    of_page = lambda n: F.coalesce(F.max(F.when(F.col("page") == n, F.col("text"))), F.lit("")).alias(f"p{n}")
    heads = pages.where("page <= 2").join(indexed.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(of_page(1), of_page(2))
    both, joined = F.lower(F.concat("p1", F.lit(" "), "p2")), F.concat("p1", "p2")
    number, year = F.nullif(F.regexp_extract(joined, P.PAPER_TITLE, 1), F.lit("")), F.regexp_extract(joined, r"20\d{2}", 0)
    paper = F.when(number.isNotNull() & (year != ""), _paper_key(number, year))
    named = lambda no: F.concat(F.lit(f"consultation paper {no} "), number.cast("int").cast("string"), F.lit(" of "), year)
    prefix, n, y = (F.regexp_extract("p1", P.LOOSE_CASE, i) for i in (1, 2, 3))
    case = lambda shown: F.concat(F.lower(prefix), F.lit(" "), shown, F.lit("/"), y)
    ln, ly = F.regexp_extract("p1", P.LOOSE_LAW, 1), F.regexp_extract("p1", P.LOOSE_LAW, 2)
    none = F.array().cast("array<string>")
    law = F.when(ln != "", F.array(F.concat(F.lit("difc law no. "), ln, F.lit(" of "), ly))).otherwise(none)
    blank, rules = F.trim(both) == "", F.contains(both, F.lit(P.RULES_TITLE))
    keys = (
        F.when(blank, none).when(rules, F.array(*map(F.lit, [*P.COURT_RULES, "rdc"]))).when(number.isNotNull(), F.when(paper.isNotNull(), F.array(paper, named("no."), named("no"))).otherwise(none))
        .when(prefix != "", F.array(case(n.cast("int").cast("string")), case(n))).when(F.contains(both, F.lit("law no.")) & F.contains(F.substring(both, 1, 200), F.lit("difc")), law)
        .when(F.contains(both, F.lit(P.ROADMAP)), F.array(F.lit("roadmap to proposed changes"))).otherwise(none)
    )
    rows = heads.select("doc_id", F.when(~blank & ~rules, paper).alias("paper"), keys.alias("keys"))
    new = rows.join(papers.select(_paper_key(F.col("number"), F.col("year")).alias("paper")).distinct(), "paper", "left_anti")
    return new.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(F.max("doc_id").alias("doc_id"))


def route_unindexed(questions: DataFrame, index: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, doc_id): documents of a ``keyword_index`` for each question (qid, question): the court rules by their words, papers by number and year that are not in ``papers``."""
    refs = found(F.col("question"), P.PAPER, 1), found(F.col("question"), P.PAPER, 2)
    asked = questions.select("qid", F.explode(F.arrays_zip(refs[0].alias("n"), refs[1].alias("y"))).alias("m")).where("m.y <> ''").select("qid", _paper_key(F.col("m.n"), F.col("m.y")).alias("key"))
    asked = asked.join(papers.select(_paper_key(F.col("number"), F.col("year")).alias("key")).distinct(), "key", "left_anti")
    rules = questions.where(contains_any(F.lower("question"), P.COURT_RULES)).select("qid", F.lit("rdc").alias("key"))
    return rules.unionByName(asked).join(index, "key").select("qid", "doc_id").distinct()
