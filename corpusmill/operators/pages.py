"""Scores of pages and chunks for a question: rules, looked up in what a question asks and what a page has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.storage import written

# Fixed values: (group, what the question asks, what the page has, amount); of a group the rule with the largest amount counts.
BOOSTS = [
    ("outcome", "outcome", "order", 0.5),
    ("outcome", "outcome", "outcome", 0.35),
    ("award", "award", "money", 0.3),
    ("metadata", "metadata_date", "metadata_page", 0.8),
    ("metadata", "metadata", "metadata_page", 0.6),
    ("title", "date", "date_elsewhere", -0.3),
    ("router", "name", "router_off", 1.2),
    ("router", "any", "router", 0.6),
    ("definition", "article", "definition", 0.3),
    ("law_number", "law_number", "first", 1.2),
    ("fine", "fine", "fine_schedule", 0.8),
]
#: What an earlier page gains: this by its number.
EARLIEST = 0.02
METADATA_QUESTION = r"(?i)\b(date of issue|issue date|issued|when was .* issued|who (?:is|was|are|were) the judge|presiding judge|name of.*judge|claimants?|defendants?|respondents?|appellants?|claim value|amount claimed|value of.*claim|title page)\b"


#: What a question quotes, with its marks.
PHRASE = "'[^']{10,}'|\"[^\"]{10,}\""


def _some(**flags: Column) -> Column:
    """The names of the flags that hold."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]), lambda x: x.isNotNull())


def asks(question: Column, answer_type: Column) -> Column:
    """What a question asks, as names that ``BOOSTS`` knows."""
    low = F.lower(question)
    metadata, date = answer_type.isin("date", "name") & question.rlike(METADATA_QUESTION), question.rlike(P.DATE_QUESTION)
    fine = question.rlike(P.FINE_QUESTION)
    return _some(
        any=F.lit(True), outcome=T.contains_any(low, P.OUTCOME_QUESTION), award=question.rlike(P.AWARD_QUESTION), metadata=metadata, metadata_date=metadata & date, date=date,
        name=answer_type.isin("name", "names"), article=question.rlike(r"(?i)Article\s+\d+") & ~fine, law_number=question.rlike(P.LAW_NUMBER_QUESTION), fine=fine,
    )


def has(page: Column, text: Column) -> Column:
    """What a page has, as names that ``BOOSTS`` knows."""
    start = F.substring(text, 1, 300)
    fines = start.rlike(P.FINE_SCHEDULE) | (start.rlike(r"(?i)^SCHEDULE\s+\d+") & F.substring(text, 1, 200).rlike(r"(?i)\bFINES?\b"))
    return _some(first=page == 1, order=T.contains_any(text, P.ORDER_MARKS), outcome=T.contains_any(F.lower(text), P.OUTCOME_TEXT), money=text.rlike(P.MONEY), fine_schedule=fines)


def boosted(scored: DataFrame, questions: DataFrame, pages: DataFrame, headings: DataFrame, date_pages: DataFrame, routed: DataFrame) -> DataFrame:
    """``scored`` (qid, doc_id, page, score) with the boosts of ``BOOSTS``.

    ``questions`` (qid, question, answer_type), ``pages`` (doc_id, page, text), ``headings`` (doc_id, key, page), ``date_pages``
    (doc_id, page: where the date of issue stands) and ``routed`` (qid, doc_id, page: what the router names) tell
    the features. Each pair of a question and a page is one row, and the rules are looked up in it."""
    asked = questions.select("qid", asks(F.col("question"), F.col("answer_type")).alias("asks"), F.transform(T.found(F.col("question"), r"(?i)Article\s+(\d+)", 1), lambda n: F.concat(F.lit("article_"), n)).alias("keys"))
    rows = scored.join(asked, "qid", "left").join(pages.select("doc_id", "page", has(F.col("page"), F.col("text")).alias("has")), ["doc_id", "page"], "left")
    rows = rows.join(date_pages.select("doc_id", F.col("page").alias("date_page")), "doc_id", "left")
    rows = rows.join(routed.select("qid", "doc_id", F.col("page").alias("router_page")), ["qid", "doc_id"], "left")
    defined = headings.where("key like 'article%'").groupBy("doc_id", "page").agg(F.collect_set("key").alias("defined"))
    rows = rows.join(defined, ["doc_id", "page"], "left")
    metadata = F.array_contains("asks", "metadata")
    target = F.when(metadata & F.array_contains("asks", "date"), F.coalesce("date_page", F.lit(1))).otherwise(1)
    own = _some(
        metadata_page=F.col("page") == target, date_elsewhere=(target != 1) & (F.col("page") == 1), router=F.col("page") == F.col("router_page"),
        router_off=(F.col("page") == F.col("router_page")) & (F.col("page") != 1), definition=F.col("router_page").isNull() & F.coalesce(F.arrays_overlap("keys", "defined"), F.lit(False)),
    )
    rows = rows.withColumn("has", F.concat("has", own))
    gain = F.lit(0.0)
    for group in dict.fromkeys(g for g, *_ in BOOSTS):
        amounts = [F.when(F.array_contains("asks", asked) & F.array_contains("has", held), amount) for g, asked, held, amount in BOOSTS if g == group]
        gain = gain + F.coalesce(F.greatest(*amounts) if len(amounts) > 1 else amounts[0], F.lit(0.0))
    return rows.select("qid", "doc_id", "page", (F.col("score") + EARLIEST / F.col("page") + gain).alias("score"))


def prescored(questions: DataFrame, chunks: DataFrame, pairs: DataFrame, k: int = 25) -> DataFrame:
    """(qid, doc_id, page, score, rank): the ``k`` chunks of each question with most signals of its own references.

    ``pairs`` (qid, doc_id) tells which documents are looked through; ``chunks`` has doc_id, page, text. Three for each article reference, and again for its bare
    number, four for a chunk that begins the article or two for one of its clauses; two less in a schedule; six for an
    enactment notice where that is asked; eight for the quoted phrase; seven for an order or five for its words where an outcome is
    asked; four for page one; one for each word in common. Ties by page.
    """
    x, q = F.col("text"), F.col("question")
    quoted = F.regexp_extract(q, PHRASE, 0)
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    refs = F.array_distinct(F.transform(T.found(q, r"(?i)Article\s+\d+[\w\(\)\.]*"), F.lower))
    words = lambda c: F.array_distinct(T.found(F.lower(c), r"[\p{L}\p{N}_]+"))
    asked = questions.select(
        "qid", refs.alias("refs"), F.transform(refs, lambda r: F.regexp_replace(r, r"^article\s+", "")).alias("bare"),
        F.array_distinct(T.found(q, r"(?i)Article\s+(\d+)", 1)).alias("roots"), F.lower(F.trim(quoted)).alias("phrase"), T.contains_any(F.lower(q), P.ENACTMENT_WORDS).alias("enacted"),
        T.contains_any(F.lower(q), P.OUTCOME_QUESTION).alias("outcome"), F.filter(words(q), lambda w: ~w.isin(P.OVERLAP_STOP_WORDS)).alias("words"),
    )
    rows = pairs.join(asked, "qid").join(chunks, "doc_id").withColumn("low", F.lower(x))
    total = lambda a, points: F.aggregate(F.transform(a, points), F.lit(0), lambda s, n: s + n)
    low = F.col("low")
    article = total(F.col("refs"), lambda r: F.when(F.contains(low, r), 3).otherwise(0)) + total(F.col("bare"), lambda r: F.when(F.contains(low, r), 3).otherwise(0))

    def root(r: Column) -> Column:
        dotted = F.concat(r, F.lit("."))
        return F.when(F.startswith(x, dotted) | F.contains(x, F.concat(F.lit("\n"), dotted)), 4).when(F.contains(low, F.concat(r, F.lit("("))), 2).otherwise(0)

    article = article + total(F.col("roots"), root)
    article = F.when(T.contains_any(F.substring(low, 1, 150), P.SCHEDULE_WORDS), F.greatest(F.lit(0), article - 2)).otherwise(article)
    notice = F.when(F.col("enacted") & F.contains(low, F.lit("enactment notice")), 6).otherwise(0)
    section = F.when((F.col("phrase") != "") & F.contains(low, F.col("phrase")), 8).otherwise(0)
    outcome = F.when(~F.col("outcome"), 0).when(T.contains_any(x, P.ORDER_MARKS), 7).when(T.contains_any(low, P.OUTCOME_TEXT), 5).otherwise(0)
    common = F.size(F.array_intersect("words", words(x)))
    scored = rows.select("qid", "doc_id", "page", (article + notice + section + outcome + F.when(F.col("page") == 1, 4).otherwise(0) + common).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id", "page")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _first(order: list[Column], *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def _best() -> list[Column]:
    return [F.round("score", 9).desc(), F.col("doc_id"), F.col("page")]


def asked_twice(targeted: DataFrame, limits: DataFrame, search: Callable[[DataFrame], DataFrame], each: int = 1, least: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """((qid, doc_id, page, score), (qid, lost)): the pages of both steps of ``retrieved``, and which questions were asked again, ``lost`` ones for want of any page."""
    per_doc = lambda df: df.withColumn("n", _first(_best(), "qid", "doc_id")).where(F.col("n") <= each).drop("n")
    best = per_doc(targeted).withColumn("n", _first(_best(), "qid")).join(limits, "qid").where("n <= most").select("qid", "doc_id", "page", "score")
    best = written(best, "targeted")
    top = best.groupBy("qid").agg(F.max("score").alias("top"))
    weak = limits.join(top, "qid", "left").where((F.col("top") < least) | F.col("top").isNull()).select("qid", F.col("top").isNull().alias("lost"))
    again = per_doc(search(weak.select("qid"))).withColumn("n", _first(_best(), "qid"))
    again = again.join(weak, "qid").where("lost or n = 1").select("qid", "doc_id", "page", "score")
    return best.unionByName(again).groupBy("qid", "doc_id", "page").agg(F.max("score").alias("score")), weak


def retrieved(targeted: DataFrame, limits: DataFrame, search: Callable[[DataFrame], DataFrame], each: int = 1, least: float = 0.4) -> DataFrame:
    """(qid, doc_id, page, score, rank): the pages of each question of ``limits`` (qid, most), in two steps.

    First the best ``each`` pages of every document of ``targeted`` (qid, doc_id, page, score), ``most`` in all. Questions whose best page
    stays under ``least``, or that have none, are asked again over the whole corpus: ``search`` gives pages (qid, doc_id,
    page, score) for (qid). A question that had pages gets one more, another as many as its limit; of a page found twice the better score counts.
    """
    both, _ = asked_twice(targeted, limits, search, each, least)
    return both.withColumn("rank", _first(_best(), "qid")).join(limits, "qid").where("rank <= most").drop("most")


# Types of answer whose title pages give way, and the lead that they must have to stay.
DEMOTED, LEAD = ["free_text", "number", "date", "name", "names"], 0.15
# What a page gains where the metadata that a question asks for stands; the score of a page that another one refers to.
METADATA_PAGE, REFERRED = 0.5, 0.3
COMPARING = r"(?i)\b(compar|differ|both|earlier|later|versus|vs\.?|distinguish|contrast)\b"


def asks_metadata(question: Column, answer_type: Column) -> Column:
    """Whether a question for a date or a name asks for metadata."""
    return answer_type.isin("date", "name") & question.rlike(METADATA_QUESTION)


def title_demoted(scores: DataFrame, questions: DataFrame, routed: DataFrame) -> DataFrame:
    """``scores`` (qid, doc_id, page, score) where a title page that leads all other pages of its document by less than ``LEAD`` goes
    just below the best of them.

    It stays for booleans, where the question (qid, question, answer_type) asks for metadata, and where ``routed`` (qid, doc_id, page)
    names page one. Leads are compared to nine places; a page that only draws level does not lead."""
    plain = questions.where(F.col("answer_type").isin(DEMOTED) & ~asks_metadata(F.col("question"), F.col("answer_type"))).select("qid", F.lit(True).alias("plain"))
    named = routed.where("page = 1").select("qid", "doc_id", F.lit(True).alias("named")).distinct()
    deep = F.max(F.when(F.col("page") > 1, F.col("score"))).over(Window.partitionBy("qid", "doc_id"))
    rows = scores.withColumn("deep", deep).join(plain, "qid", "left").join(named, ["qid", "doc_id"], "left")
    lead = F.round(F.col("score") - F.col("deep"), 9)
    gives_way = (F.col("page") == 1) & F.col("plain").isNotNull() & F.col("named").isNull() & (lead > 0) & (lead < LEAD)
    return rows.select("qid", "doc_id", "page", F.when(gives_way, F.col("deep") - 0.001).otherwise(F.col("score")).alias("score"))


def fallback_pages(ranked: DataFrame, questions: DataFrame, date_pages: DataFrame) -> DataFrame:
    """(qid, doc_id, page, score, rank): pages for questions without a known document, from chunks ``ranked`` (qid, doc_id, page, rank from one).

    A page has the reciprocal of its best chunk's rank, ``EARLIEST`` by its number, and ``METADATA_PAGE`` where it is the one that a
    question for metadata means: the page of the date of issue (``date_pages``) for dates, else the first. ``questions`` (qid, question,
    answer_type, each, most) tells how many pages of a document and in all are kept; ties go to the smaller document and page."""
    best = ranked.groupBy("qid", "doc_id", "page").agg(F.min("rank").alias("rank"))
    dating = (F.col("answer_type") == "date") | F.col("question").rlike(P.DATE_QUESTION)
    asked = questions.select("qid", asks_metadata(F.col("question"), F.col("answer_type")).alias("metadata"), dating.alias("dating"), "each", "most")
    rows = best.join(asked, "qid").join(date_pages.select("doc_id", F.col("page").alias("date_page")), "doc_id", "left")
    target = F.when(F.col("dating"), F.coalesce("date_page", F.lit(1))).otherwise(1)
    score = 1.0 / F.col("rank") + EARLIEST / F.col("page") + F.when(F.col("metadata") & (F.col("page") == target), METADATA_PAGE).otherwise(0.0)
    kept = rows.withColumn("score", score).withColumn("n", _first(_best(), "qid", "doc_id")).where("n <= each")
    return kept.withColumn("rank", _first(_best(), "qid")).where("rank <= most").select("qid", "doc_id", "page", "score", "rank")


def with_referred(pages: DataFrame, edges: DataFrame, questions: DataFrame, per: int = 3) -> DataFrame:
    """``pages`` (qid, doc_id, page, score, rank) and, behind them, pages that they refer to: one for every ``per`` pages of a question, at least one.

    ``edges`` (doc_id, page, place, target_doc, target_page) in the order of ``place``; one without a target page does not count, and
    one inside its own document only where the question (qid, question) compares. Targets come in the order of the
    pages and places, each once, none that is among the pages."""
    most = pages.groupBy("qid").agg(F.count("*").alias("n")).withColumn("most", F.greatest(F.lit(1), F.floor(F.col("n") / per)))
    compares = questions.select("qid", F.col("question").rlike(COMPARING).alias("compares"))
    whole = edges.where("target_doc is not null and target_page is not null")
    found = pages.select("qid", "doc_id", "page", "rank").join(whole, ["doc_id", "page"]).join(compares, "qid").where("compares or target_doc <> doc_id")
    first = found.groupBy("qid", "target_doc", "target_page").agg(F.min(F.struct("rank", "place")).alias("at")).withColumnsRenamed({"target_doc": "doc_id", "target_page": "page"})
    new = first.join(pages.select("qid", "doc_id", "page"), ["qid", "doc_id", "page"], "left_anti")
    kept = new.withColumn("k", _first([F.col("at"), F.col("doc_id"), F.col("page")], "qid")).join(most, "qid").where("k <= most")
    return pages.unionByName(kept.select("qid", "doc_id", "page", F.lit(REFERRED).alias("score"), (F.col("n") + F.col("k")).cast("int").alias("rank")))


def keyword_pages(asked: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, page, n): of each asked document (qid, doc_id, kw: words in lower case) the ``k`` pages that hold most of the words, at least one; the earlier page on ties."""
    held = asked.join(pages.select("doc_id", "page", F.lower("text").alias("low")), "doc_id")
    hits = held.select("qid", "doc_id", "page", F.size(F.filter("kw", lambda w: F.contains(F.col("low"), w))).alias("n")).where("n > 0")
    return hits.withColumn("r", _first([F.col("n").desc(), F.col("page")], "qid", "doc_id")).where(F.col("r") <= k).drop("r")
