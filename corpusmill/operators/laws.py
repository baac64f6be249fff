"""Laws by name and number, the pages of their articles, references between documents, papers and orders."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T
from corpusmill.operators import matching as M
from corpusmill.storage import written

#: A question's text without what stands in quotation marks.
QUOTED = "\"[^\"]*\"|'[^']*'|[“”][^“”]*[“”]|[‘’][^‘’]*[‘’]"


def latest_editions(laws: DataFrame) -> DataFrame:
    """(name, abbreviation, doc_id, year) of ``laws`` (doc_id, name, abbreviation, number, year): the edition of the latest year
    of each name, the smallest doc_id on ties."""
    best = F.max_by(F.struct("abbreviation", "doc_id", "year"), F.struct("year", -F.col("doc_id")))
    return laws.groupBy("name").agg(best.alias("b")).select("name", "b.abbreviation", "b.doc_id", "b.year")


def asked_laws(questions: DataFrame, laws: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, name): the known laws that a question (qid, question) names, by names of any length or of up to ``most`` words.

    Names count outside quotation marks: full names first; short ones, without the word law, where a question has no full
    one; abbreviations and numbers (``Law No. 3 of 2018``) always. A question without any of these is looked through once more with its quotations, and the
    longest name in them counts. A number that several laws have is that of the law whose name comes first.
    """
    bare = questions.select("qid", F.regexp_replace("question", QUOTED, " ").alias("text"))
    known = written(latest_editions(laws).select("name", "abbreviation"), "editions")
    full = written(M.named(bare, known, "qid", "text", "name", most).select("qid", "name"), "full-names")
    short = known.select("name", F.regexp_replace("name", r"\s+law$", "").alias("short"))
    loose = M.named(bare.join(full.select("qid").distinct(), "qid", "left_anti"), short, "qid", "text", "short", most).withColumnRenamed("name", "short")
    loose = loose.join(short, "short").select("qid", "name")
    letters = M.named(bare, known.select("abbreviation").distinct(), "qid", "text", "abbreviation", most).withColumnRenamed("name", "abbreviation")
    letters = letters.join(known.groupBy("abbreviation").agg(F.min("name").alias("name")), "abbreviation").select("qid", "name")
    numbers = questions.select("qid", F.explode(T.found(F.col("question"), P.LAW_OF)).alias("m"))
    numbers = numbers.select("qid", F.regexp_extract("m", P.LAW_OF, 1).cast("long").alias("number"), F.regexp_extract("m", P.LAW_OF, 2).cast("long").alias("year"))
    numbered = laws.groupBy(F.col("number").cast("long").alias("number"), F.col("year").cast("long").alias("year")).agg(F.min("name").alias("name"))
    by_number = numbers.join(numbered, ["number", "year"]).select("qid", "name")
    found = written(full.unionByName(loose).unionByName(letters).unionByName(by_number).distinct(), "found-names")
    rest = M.named(questions.join(found.select("qid").distinct(), "qid", "left_anti"), known, "qid", "question", "name", most)
    longest = rest.groupBy("qid").agg(F.min_by("name", F.struct((-F.col("size")).alias("k"), "name")).alias("name"))
    return found.unionByName(longest)


def law_documents(asked: DataFrame, laws: DataFrame) -> DataFrame:
    """``asked`` (qid, name) with the doc_id of each law's latest edition."""
    return asked.join(latest_editions(laws).select("name", "doc_id"), "name").select("qid", "name", "doc_id")


def of_case(pages: DataFrame) -> DataFrame:
    """(doc_id) of documents that read like a court case; each page is looked at where it lies, and a document is one number of marks."""
    kinds = {"case": P.CASE_SIGNALS, "law": P.LAW_SIGNALS, "regulation": P.REGULATION_SIGNALS}
    words = [w for signals in kinds.values() for w in signals]
    masks = {k: sum(1 << i for i, w in enumerate(words) if w in signals) for k, signals in kinds.items()}

    def marks(low):
        return reduce(add, [F.contains(low, F.lit(w)).cast("long") * (1 << i) for i, w in enumerate(words)])

    # as an element the text is made and lower-cased once, not for every word
    found = pages.groupBy("doc_id").agg(F.bit_or(F.get(F.transform(F.array(F.lower("text")), marks), F.lit(0))).alias("marks"))
    counts = found.select("doc_id", *[F.bit_count(F.col("marks").bitwiseAND(F.lit(mask).cast("long"))).alias(kind) for kind, mask in masks.items()])
    return counts.where("case >= 3 or (law < 3 and regulation < 2 and case > law)").select("doc_id")


def heading_pages(pages: DataFrame, court: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, page): every page of ``pages`` (doc_id, page, text) on which an article, rule, section, part, schedule,
    regulation or appendix begins, at the start of a line; pages of contents (three dotted runs) do not count.

    An article may have its number alone, with the title on the next line, or on the same one if no dots follow within 50
    characters; numbers over 300 are none, and neither are the numbered paragraphs of a court case (``court``: their doc_id,
    by ``of_case`` if not given). Null texts have none.
    """
    # elements of an array are made once; an expression would be made again wherever its column is used
    told = pages.select("doc_id", "page", F.explode(F.array("text")).alias("text")).where(F.col("text").rlike("(?m)" + P.MAY_HEAD)).where(F.regexp_count("text", F.lit(r"\.{5,}")) < 3)
    lines = told.select("doc_id", "page", F.split("text", "\n").alias("lines")).select("doc_id", "page", "lines", F.posexplode("lines").alias("i", "line")).where(F.col("line").rlike(P.MAY_HEAD))
    rest = F.array_join(F.slice("lines", F.col("i") + 1, F.size("lines")), "\n")
    # what a line begins with tells which one pattern can fit: no word, a number
    lines = lines.select("doc_id", "page", F.inline(F.array(F.struct(rest.alias("rest"), F.lower(F.regexp_extract("line", r"^\s*([A-Za-z]+)", 1)).alias("word")))))
    begins = lambda p, g: F.regexp_extract("rest", r"^\s*" + p, g)
    number = F.greatest(begins(P.NUMBER_LINE, 1).try_cast("int"), F.when(~F.contains(F.substring("rest", F.length(begins(P.NUMBER_TITLE, 0)) + 1, F.lit(P.AFTER_TITLE)), F.lit(P.DOTS)), begins(P.NUMBER_TITLE, 1).try_cast("int")))
    headed = F.coalesce(*[F.when(F.col("word") == kind, F.concat(F.lit(f"{kind}_"), F.nullif(begins(p, 1), F.lit("")))) for kind, p in P.HEADED.items()])
    told = lines.select("doc_id", "page", F.inline(F.array(F.struct(F.when(F.col("word") == "", number).alias("number"), headed.alias("headed")))))
    key = F.coalesce(F.when(F.col("number") <= P.LARGEST_ARTICLE, F.concat(F.lit("article_"), F.col("number").cast("string"))), F.col("headed"))
    keyed = told.select("doc_id", "page", "number", key.alias("key")).where("key is not null")
    cases = (of_case(pages) if court is None else court).select("doc_id", F.lit(True).alias("court"))
    return keyed.join(cases, "doc_id", "left").where("number is null or court is null").select("doc_id", "key", "page").distinct()


def typed_references(pages: DataFrame, laws: DataFrame, cases: DataFrame) -> DataFrame:
    """(doc_id, page, type, context, target_doc, target_page): what the pages refer to, each once for a page.

    Articles, schedules, parts and appendices are looked up in the same document and count where they begin on
    another page. Laws (by number, or by a name of the dictionary) count where they are another document's. Cases are resolved by ``cases``
    (case_id, doc); those it lacks, court rules and papers stay without a target.
    """
    first = written(heading_pages(pages).groupBy("doc_id", "key").agg(F.min("page").alias("target_page")), "first-pages")
    found = lambda p: F.explode(T.found(F.col("text"), p)).alias("context")
    out = []
    for kind, p in {"article": P.ARTICLE, "schedule": P.SCHEDULE, "part": P.PART, "appendix": P.APPENDIX}.items():
        rows = pages.select("doc_id", "page", found(p)).withColumn("key", F.concat(F.lit(f"{kind}_"), F.regexp_extract("context", p, 1)))
        hits = rows.join(first, ["doc_id", "key"]).where("target_page <> page")
        out.append(hits.select("doc_id", "page", F.lit(f"internal_{kind}").alias("type"), "context", F.col("doc_id").alias("target_doc"), "target_page"))
    none = F.lit(None).cast("int").alias("target_page")
    external = lambda rows: rows.where("target_doc <> doc_id").select("doc_id", "page", F.lit("external_law").alias("type"), "context", "target_doc", none)
    numbered = laws.groupBy(F.col("number").cast("string").alias("number"), F.col("year").cast("string").alias("year")).agg(F.min_by("doc_id", F.struct("name", "doc_id")).alias("target_doc"))
    by_number = pages.select("doc_id", "page", found(P.LAW_NUMBER)).withColumns({"number": F.regexp_extract("context", P.LAW_NUMBER, 1), "year": F.regexp_extract("context", P.LAW_NUMBER, 2)})
    out.append(external(by_number.join(numbered, ["number", "year"])))
    by_name = pages.select("doc_id", "page", found(P.NAMED_LAW))
    known = latest_editions(laws)
    resolved = M.named(by_name.select("context").distinct(), known, "context", "context", "name").join(known.select("name", F.col("doc_id").alias("target_doc")), "name")
    resolved = resolved.groupBy("context").agg(F.min_by("target_doc", F.struct((-F.col("size")).alias("k"), "name")).alias("target_doc"))
    out.append(external(by_name.join(resolved, "context")))
    case_of = pages.select("doc_id", "page", F.explode(T.case_ids(F.col("text"))).alias("context")).join(cases.select(F.col("case_id").alias("context"), F.col("doc").alias("target_doc")), "context", "left")
    out.append(case_of.select("doc_id", "page", F.lit("case_ref").alias("type"), "context", "target_doc", none))
    open_ = lambda rows, kind, context: rows.select("doc_id", "page", F.lit(kind).alias("type"), context.alias("context"), F.lit(None).cast("long").alias("target_doc"), none)
    out.append(open_(pages.select("doc_id", "page", F.explode(T.found(F.col("text"), P.COURT_RULE, 1)).alias("n")), "rdc_rule", F.concat(F.lit("RDC "), "n")))
    papers = pages.select("doc_id", "page", found(P.PAPER))
    year = F.regexp_extract("context", P.PAPER, 2)
    out.append(open_(papers, "consultation_paper", F.concat(F.lit("Consultation Paper No. "), F.regexp_extract("context", P.PAPER, 1), F.when(year != "", F.concat(F.lit(" of "), year)).otherwise(""))))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.distinct()


def reference_degrees(edges: DataFrame) -> DataFrame:
    """(doc_id, refs, cited_docs, citing_docs, unresolved): of each document that refers or is referred to."""
    out = edges.groupBy("doc_id").agg(F.count("*").alias("refs"), F.count_distinct(F.when(F.col("target_doc") != F.col("doc_id"), F.col("target_doc"))).alias("cited_docs"), F.count_if(F.col("target_doc").isNull()).alias("unresolved"))
    into = edges.where("target_doc <> doc_id").groupBy(F.col("target_doc").alias("doc_id")).agg(F.count_distinct(edges["doc_id"]).alias("citing_docs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "doc_id", "full").select("doc_id", zero("refs"), zero("cited_docs"), zero("citing_docs"), zero("unresolved"))


def law_name_scores(names: DataFrame, docs: DataFrame, corpus_size: int) -> DataFrame:
    """(name, doc_id, score, rank): documents (doc_id, text) by how prominently a law's name stands in them.

    A mention as whole words counts ten, another one. A document that begins like a law counts a thousand times; court
    documents count only where nothing else has the name. Of a name's documents those with a tenth of the best score
    stay, at most 6, 8 or 12 in a corpus of up to 50, up to 150 or more documents. The name is found by its n-grams.
    """
    start = F.substring("text", 1, 200)
    law = F.contains(start, F.lit("[document:")) & T.contains_any(start, ["difc law", "law/enactment", "enactment", "regulation"])
    unit = F.struct("doc_id", F.when(law, 1000).otherwise(1).alias("times"), F.contains(start, F.lit("court case")).alias("court"))
    # every text is made and read once: a place comes with what its document is and with the characters beside it
    low = docs.select("doc_id", F.explode(F.array(F.lower("text"))).alias("text")).select(unit.alias("unit"), "text")
    hits = M.occurrences(low, names.select("name").distinct(), "unit", "text", "name", "name", beside=True)
    whole = ~F.col("before").rlike(r"\w") & ~F.col("after").rlike(r"\w")
    scored = hits.select("name", "unit.*", F.when(whole, 10).otherwise(1).alias("points"))
    scored = written(scored.groupBy("name", "doc_id").agg((F.sum("points") * F.max("times")).alias("score"), F.bool_or("court").alias("court")), "name-scores")
    known = scored.groupBy("name").agg(F.bool_and("court").alias("only_court"), F.max(F.when(~F.col("court"), F.col("score"))).alias("best"))
    kept = scored.join(known, "name").where((~F.col("court") & (F.col("score") >= 0.1 * F.col("best"))) | F.col("only_court"))
    most = 6 if corpus_size <= 50 else 8 if corpus_size <= 150 else 12
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "doc_id")))
    return ranked.where(F.col("rank") <= most).select("name", "doc_id", "score", "rank")


# Topics of consultation papers and the words that tell them.
PAPER_TOPICS = {
    "strata title": ["strata title"], "hotel operating": ["hotel operat"], "data protection law": ["data protection law", "new data protection"],
    "data protection regulation": ["data protection regulation", "amended data protection"], "intellectual property law": ["intellectual property law", "new intellectual property"],
    "intellectual property regulation": ["intellectual property regulation"], "employment law": ["employment law"], "employment regulation": ["employment regulation"],
    "companies law": ["companies law", "new companies"], "companies regulation": ["companies regulation"], "trust law": ["trust law", "new trust"],
    "leasing law": ["leasing law", "new leasing"], "leasing regulation": ["leasing regulation"], "netting law": ["netting law"], "operating regulation": ["operating regulation"],
    "real property": ["real property"], "financial collateral": ["financial collateral"], "law of security": ["law of security"], "security regulation": ["security regulation"],
    "electronic transactions": ["electronic transactions"], "prescribed company": ["prescribed company"], "venture studio": ["venture studio"], "family office": ["family office"],
    "family arrangement": ["family arrangement"], "ultimate beneficial ownership": ["ultimate beneficial ownership"], "non profit": ["non profit", "non-profit"],
    "variable capital": ["variable capital"], "common reporting": ["common reporting"], "law amendment": ["law amendment", "amendment law"], "insolvency": ["insolvency"],
    "foundations": ["foundations"], "difc legislation": ["difc legislation"],
}


def topics(text: Column, known: dict[str, list[str]] | None = None) -> Column:
    """The topics whose words a text has."""
    low = F.lower(text)
    each = [F.when(T.contains_any(low, words), F.lit(topic)) for topic, words in (known or PAPER_TOPICS).items()]
    return F.filter(F.array(*each), lambda t: t.isNotNull())


def asked_papers(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, doc): the consultation papers that a question (qid, question) is about; ``papers`` has doc, number, year and text.

    By number and year; by number alone if one paper has it, else those of them that share a topic with the question, or all if
    none does. A question that speaks of such a paper and leads to none by a number gets the papers with most of its topics, ties included.
    """
    told = papers.select("doc", F.col("number").cast("long").alias("number"), F.col("year").cast("long").alias("year"), topics(F.col("text")).alias("held"))
    asked = questions.select("qid", "question", topics(F.col("question")).alias("topics"))
    numbers = asked.select("qid", "topics", F.explode(T.found(F.col("question"), P.PAPER)).alias("m"))
    numbers = numbers.select("qid", "topics", F.regexp_extract("m", P.PAPER, 1).cast("long").alias("number"), F.regexp_extract("m", P.PAPER, 2).try_cast("long").alias("asked_year"))
    met = numbers.join(told, "number").where("asked_year is null or asked_year = year").withColumn("fits", F.arrays_overlap("topics", "held"))
    per = met.groupBy("qid", "number").agg(F.count("*").alias("n"), F.bool_or("fits").alias("any"))
    by_number = written(met.join(per, ["qid", "number"]).where("asked_year is not null or n = 1 or fits or not any").select("qid", "doc").distinct(), "numbered-papers")
    spoken = asked.where(F.col("question").rlike(r"(?i)\b(?:consultation\s+paper|difc\s+document)\b")).join(by_number.select("qid").distinct(), "qid", "left_anti")
    # questions with the same topics get the same papers
    shared = spoken.select("topics").distinct().select("topics", F.explode("topics").alias("topic")).join(told.select("doc", F.explode("held").alias("topic")), "topic").groupBy("topics", "doc").agg(F.count("*").alias("k"))
    shared = written(shared, "shared-topics")
    best = shared.groupBy("topics").agg(F.max("k").alias("k"))
    return by_number.unionByName(spoken.select("qid", "topics").join(shared.join(best, ["topics", "k"]), "topics").select("qid", "doc"))


#: How much of the question before an order's number tells its court.
LEFT = 60


def asked_orders(questions: DataFrame, orders: DataFrame) -> DataFrame:
    """(qid, kind, doc): the court orders that a question (qid, question) names; ``orders`` has kind (court, sct, rules_of_court,
    dra), number, year and doc.

    The sixty characters before the number tell the court: rules of court, small claims, else the court's own. An order that this
    one does not have is taken from the first court that has it. DRA orders are a kind of their own.
    """
    marks, between = T.found(F.col("question"), P.COURT_ORDER), F.split("question", P.COURT_ORDER)
    before = lambda i: F.concat(F.array_join(F.flatten(F.transform(F.slice(between, 1, i), lambda x, k: F.array(x, F.get("marks", k)))), ""), F.get(between, i))
    rows = questions.withColumn("marks", marks).select("qid", F.transform("marks", lambda m, i: F.struct(m.alias("m"), F.lower(F.concat(F.right(before(i), F.lit(LEFT)), m)).alias("left"))).alias("every"))
    rows = rows.select("qid", F.inline("every"))
    kind = F.when(F.contains("left", F.lit("rules of court")), "rules_of_court").when(F.contains("left", F.lit("small claims")), "sct").otherwise("court")
    part = lambda g: F.regexp_extract("m", P.COURT_ORDER, g).cast("long")
    asked = rows.select("qid", kind.alias("asked"), part(1).alias("number"), part(2).alias("year")).distinct()
    keyed = orders.select("kind", F.col("number").cast("long").alias("number"), F.col("year").cast("long").alias("year"), "doc")
    met = asked.join(keyed.where("kind <> 'dra'"), ["number", "year"])
    order = F.when(F.col("kind") == F.col("asked"), 0).when(F.col("kind") == "court", 1).when(F.col("kind") == "sct", 2).otherwise(3)
    first = met.groupBy("qid", "number", "year", "asked").agg(F.min(F.struct(order.alias("o"), "kind", "doc")).alias("b")).select("qid", "b.kind", "b.doc")
    dra = questions.select("qid", F.explode(T.found(F.col("question"), P.DRA_ORDER)).alias("m"))
    dra = dra.select("qid", F.regexp_extract("m", P.DRA_ORDER, 1).cast("long").alias("number"), F.regexp_extract("m", P.DRA_ORDER, 2).cast("long").alias("year"))
    return first.unionByName(dra.join(keyed.where("kind = 'dra'"), ["number", "year"]).select("qid", "kind", "doc")).distinct()


def assembled(routes: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """(qid, docs, pages): an ordered union of routes. Each is (qid, ord, doc) with, perhaps, (qid, doc, page) of pages it names.

    Documents stand in the order of the routes and of ``ord`` in them, each where it first comes; a page that a later
    route names for a document replaces an earlier one's. ``pages`` are structs (doc, page) in the order of documents.
    """
    docs, pages = None, None
    for i, (found, told) in enumerate(routes):
        part = found.select("qid", F.col("doc").cast("long").alias("doc"), F.struct(F.lit(i).alias("route"), F.col("ord").cast("long").alias("ord"), F.col("doc").cast("long").alias("doc")).alias("place"))
        docs = part if docs is None else docs.unionByName(part)
        if told is not None:
            part = told.select("qid", F.col("doc").cast("long").alias("doc"), F.lit(i).alias("route"), F.col("page").cast("int").alias("page"))
            pages = part if pages is None else pages.unionByName(part)
    first = docs.groupBy("qid", "doc").agg(F.min("place").alias("place"))
    named = pages.groupBy("qid", "doc").agg(F.max_by("page", F.struct("route", "page")).alias("page")) if pages is not None else None
    rows = first.join(named, ["qid", "doc"], "left") if named is not None else first.withColumn("page", F.lit(None).cast("int"))
    every = F.array_sort(F.collect_list(F.struct("place", "doc", "page")))  # of one question
    return rows.groupBy("qid").agg(every.alias("r")).select(
        "qid", F.transform("r", lambda x: x["doc"]).alias("docs"),
        F.transform(F.filter("r", lambda x: x["page"].isNotNull()), lambda x: F.struct(x["doc"].alias("doc"), x["page"].alias("page"))).alias("pages"),
    )
