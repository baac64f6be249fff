"""Column functions over texts: tokens, references, entities, cleaning. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of one of its groups, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more characters without stop words; repeats stay."""
    return F.filter(found(F.lower(text), P.WORD), lambda w: ~w.isin(P.STOP_WORDS))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Matches as structs of their groups g0, g1, ..."""
    return F.arrays_zip(*[found(text, pattern, i + 1).alias(f"g{i}") for i in range(n)])


def reference_tokens(text: Column) -> Column:
    """Compound tokens of legal references with their parts: enforcement and other cases, articles, laws, schedules, regulations."""
    lit, cat = F.lit, F.concat
    enf = F.transform(_groups(text, P.TOKEN_ENF, 2), lambda m: F.array(cat(lit("enf_"), m["g0"], lit("_"), m["g1"]), m["g0"], m["g1"]))
    case = F.transform(
        F.filter(_groups(text, P.TOKEN_CASE, 3), lambda m: m["g0"] != "ENF"),
        lambda m: F.array(cat(F.lower(m["g0"]), lit("_"), m["g1"], lit("_"), m["g2"]), m["g1"], m["g2"]),
    )

    def article(m: Column) -> Column:
        one = cat(lit("article_"), m["g0"])
        two = cat(one, lit("_"), m["g1"])
        return F.filter(
            F.array(one, F.when(m["g1"] != "", two), F.when(m["g1"] != "", m["g1"]), F.when(m["g2"] != "", cat(two, lit("_"), m["g2"])), F.when(m["g2"] != "", m["g2"])),
            lambda x: x.isNotNull(),
        )

    law = F.transform(_groups(text, P.TOKEN_LAW, 3), lambda m: F.array(cat(F.lower(m["g0"]), lit("_law_"), m["g1"], lit("_"), m["g2"])))
    schedule = F.transform(found(text, P.TOKEN_SCHEDULE, 1), lambda x: F.array(cat(lit("schedule_"), F.lower(x))))
    regulation = F.transform(found(text, P.TOKEN_REGULATION, 1), lambda x: cat(F.array(cat(lit("regulation_"), F.replace(x, lit("."), lit("_")))), F.split(x, r"\.")))
    every = F.flatten(F.concat(enf, case, F.transform(_groups(text, P.TOKEN_ARTICLE, 3), article), law, schedule, regulation))
    return F.when(text.rlike(P.TOKEN_ANY), every).otherwise(F.array().cast("array<string>"))


def index_tokens(text: Column) -> Column:
    """What the lexical index holds of a text."""
    return F.concat(tokens(text), reference_tokens(text))


def entities(text: Column) -> Column:
    """Distinct legal entities of a chunk, lower-cased, in order."""
    every = F.concat(*[found(text, p) for p in P.ENTITIES])
    return F.array_sort(F.array_distinct(F.transform(every, lambda e: F.lower(F.regexp_replace(F.trim(e), r"\s+", " ")))))


def without_boilerplate(text: Column, title: Column | None = None) -> Column:
    """The text that is embedded: no title, court headers, page numbers or lone dates, blank lines collapsed."""
    if title is not None:
        quoted = F.concat(F.lit(r"(?i)\Q"), title, F.lit(r"\E"))
        text = F.when(title != "", F.regexp_replace(text, quoted, F.lit(""))).otherwise(text)
    for p in P.BOILERPLATE:
        text = F.regexp_replace(text, p, "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether one of a few literal strings stands in the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many of a few literal strings stand in the text."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def document_kind(text: Column) -> Column:
    """CASE, LAW or REGULATION by counts of their marks."""
    low = F.lower(text)
    case, law, regulation = (count_contained(low, w) for w in (P.CASE_SIGNALS, P.LAW_SIGNALS, P.REGULATION_SIGNALS))
    return F.when(case >= 3, "CASE").when(law >= 3, "LAW").when(regulation >= 2, "REGULATION").when(case > law, "CASE").otherwise("LAW")


def title(text: Column) -> Column:
    """The first of up to ten filled lines that is longer than ten characters, no number and no heading mark; else the first line."""
    lines = F.filter(F.transform(F.split(F.substring(text, 1, 2000), "\n"), stripped), lambda x: x != "")
    good = F.filter(F.slice(lines, 1, 10), lambda x: (F.length(x) > 10) & ~x.rlike(r"^\d+$") & ~x.startswith("#"))
    return F.coalesce(F.substring(F.get(good, F.lit(0)), 1, 200), F.substring(F.get(lines, F.lit(0)), 1, 200), F.lit("Untitled"))


def metadata_kind(question: Column) -> Column:
    """The first kind of metadata whose patterns the question fits; null if none."""
    kinds = [F.when(question.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(kind)) for kind, ps in P.METADATA.items()]
    return F.coalesce(*kinds)


def case_id(text: Column) -> Column:
    """The canonical form of the first case number: upper-case prefix, at least three digits, year; the trimmed text without one."""
    prefix, number, year = (F.regexp_extract(text, P.CASE_ID, i) for i in (1, 2, 3))
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))
    return F.when(prefix != "", F.concat(F.upper(prefix), F.lit(" "), padded, F.lit("/"), year)).otherwise(F.trim(text))


def case_ids(text: Column) -> Column:
    """All distinct case numbers of a text in order, in canonical form."""
    return F.array_distinct(F.transform(found(text, P.CASE_ID), case_id))


def article_keys(text: Column) -> Column:
    """Keys of articles, schedules, parts and appendices, in that order, distinct."""
    of = lambda name, p: F.transform(found(text, p, 1), lambda x: F.concat(F.lit(f"{name}_"), x))
    return F.array_distinct(F.concat(of("article", P.ARTICLE), of("schedule", P.SCHEDULE), of("part", P.PART), of("appendix", P.APPENDIX)))


def is_foreign(question: Column, source: Column | None = None) -> Column:
    """Whether a question asks about a concept of another jurisdiction: by a word that settles it; unless a case is named, by
    looser marks, or by a concept that the retrieved ``source`` text lacks."""
    low = F.lower(question)
    loose = question.rlike(P.FOREIGN_LOOSE)
    if source is not None:
        text = F.lower(F.coalesce(source, F.lit("")))
        loose = loose | ((text != "") & contains_any(low, P.FOREIGN_CONCEPTS) & ~contains_any(text, P.FOREIGN_CONCEPTS))
    return contains_any(low, P.FOREIGN) | (~question.rlike(P.FOREIGN_CASE) & loose)


def page_override(question: Column, pages: Column, law: Column) -> Column:
    """The page a question names in a document of so many pages, null if none: an explicit number, else the last ordinal that
    the document has, else the first page for a question about a law's official number."""
    number = F.element_at(F.transform(found(question, P.PAGE_OF, 1), lambda x: x.try_cast("int")), -1)
    ordinals = F.transform(found(question, P.ORDINAL_PAGE, 1), F.lower)

    def page(word: Column) -> Column:
        far = F.when(word == "second", 2).when(word == "third", 3)
        return F.when((word == "last") & (pages > 0), pages).when(word.isin("first", "title", "cover"), 1).when(far <= pages, far)

    last = F.element_at(F.filter(F.transform(ordinals, page), lambda p: p.isNotNull()), -1)
    official = F.when(law & question.rlike(P.OFFICIAL_NUMBER), 1)
    some = lambda a, value: F.when(F.size(a) > 0, value)
    return F.coalesce(some(found(question, P.PAGE_OF, 1), number), some(F.filter(F.transform(ordinals, page), lambda p: p.isNotNull()), last), official)


def identifiers(text: Column) -> Column:
    """Distinct case and law numbers of a text in one canonical spelling each."""
    return F.array_distinct(F.concat(case_ids(text), F.transform(found(text, P.LAW_NO, 1), lambda n: F.concat(F.lit("LAW "), n))))


def years(text: Column) -> Column:
    """Distinct years of a text, in order."""
    return F.array_distinct(found(text, P.YEAR))


def is_case_question(question: Column) -> Column:
    """Whether a question is about a case: by a case number, or by words that go before one."""
    return contains_any(F.lower(question), P.CASE_WORDS) | question.rlike(P.CASE_IN_QUESTION)


def compares_cases(question: Column, words: Iterable[str]) -> Column:
    """Whether a question names two case numbers (or one twice) and has a word of comparison."""
    return (F.size(found(question, P.CASE_IN_QUESTION)) >= 2) & contains_any(F.lower(question), words)


def prompt_kind(question: Column, answer_type: Column) -> Column:
    """Which prompt a question gets: by its type of answer; names by what they compare, free answers by what they are about."""
    name = F.when(compares_cases(question, P.DATE_WORDS), "name_by_date").when(compares_cases(question, P.VALUE_WORDS), "name_by_value").otherwise("name")
    free = F.when(contains_any(F.lower(question), P.FOREIGN), "free_trick").when(is_case_question(question), "free_case").otherwise("free_law")
    return F.when(answer_type.isin("boolean", "number", "names", "date"), answer_type).when(answer_type == "name", name).otherwise(free)


def answer_tokens(answer_type: Column) -> Column:
    """How many tokens an answer may have: free ones may reason, and so may names that compare."""
    return F.when(answer_type == "free_text", 1500).when(answer_type == "name", 280).otherwise(80)
