"""Column functions over answers: cleaning, parsing by type, and the format guard. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions.text import contains_any, stripped

# Words that stand for an absent answer, refusals, dates as they are written.
NULL_WORDS = ["null", "n/a", "none", "unanswerable"]
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "y", "1"], ["false", "no", "n", "0"]
DATE_FORMATS = ["yyyy-M-d", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy"]
DEFLECTIONS = [
    "i cannot answer based on the provided passages", "cannot answer based on the provided", "none of the passages", "no passage contains", "passages do not contain",
    "passages don't contain", "not mentioned in any", "no relevant information", "cannot be answered",
]
NOT_MENTIONED = ["notmentioned", "not_mentioned", "not mentioned"]


def without_artifacts(text: Column) -> Column:
    """The answer without source, page and quote lines, bracketed numbers and a closing source note."""
    text = F.regexp_replace(text, r"(?im)^(?:SOURCES|PAGES|PAGES_USED|QUOTE)\s*:.*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"(?i)\s*\(Source:[^)]*\)\s*$", "")
    return stripped(text)


def parse_boolean(text: Column) -> Column:
    low = F.lower(stripped(F.regexp_replace(text, r"[*_`]", "")))
    return F.when(low.rlike(r"^(?:true|yes)"), True).when(low.rlike(r"^(?:false|no\b)"), False)


def parse_number(text: Column) -> Column:
    """The first number of an answer: currencies dropped, blanks and commas between thousands joined."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?i)AED|USD|EUR|GBP|\$", ""), r"(\d)[ ,](\d{3})\b", "$1$2")
    clean = F.regexp_replace(clean, r"(\d)[ ,](\d{3})\b", "$1$2")
    return F.regexp_extract(clean, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def parse_date(text: Column) -> Column:
    """ISO form of an answer that is a date, else the text as it is."""
    return F.coalesce(fix_date(text), stripped(text))


def fix_date(text: Column) -> Column:
    """ISO form of a date in one of the known forms, else null."""
    text = stripped(text)
    tried = [F.try_to_timestamp(F.when(text.rlike(_SHAPES[f]), text), F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(*tried).cast("string")


_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "d MMMM yyyy": r"^\d{1,2} [A-Z][a-z]{2,} \d{4}$", "MMMM d, yyyy": r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
}


def fix_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def fix_number(text: Column) -> Column:
    """A number after dropping currency letters and signs, commas and blanks; null if anything else is left."""
    return F.regexp_replace(text, r"[AED$£€¥US,\s]", "").try_cast("double")


def fix_name(text: Column) -> Column:
    """A name without a leading article and sentence around it."""
    text = F.regexp_replace(stripped(text), r"(?i)^(?:the answer is|it is|this is)\s+", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)^(?:the|an?)\s+", ""), r"\.$", "")


def fix_names(text: Column) -> Column:
    """Names of a comma list, each trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), stripped), lambda x: x != "")


def fix_free_text(text: Column) -> Column:
    """A free answer without markdown and without a closing caveat."""
    return stripped(F.regexp_replace(F.regexp_replace(text, r"\*\*|__|`", ""), r"(?is)\s*Caveat:.*$", ""))


def is_null_word(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(NULL_WORDS)


def answer_case_id(text: Column) -> Column:
    """An enforcement number in dashes as prefix, number and year; a sub-case and everything else as it is."""
    return F.when(text.rlike(r"^[A-Z]{2,4}-\d+-\d{4}$"), F.regexp_replace(text, r"^([A-Z]{2,4})-(\d+)-(\d{4})$", "$1 $2/$3")).otherwise(text)


def plain_letters(text: Column) -> Column:
    """Cyrillic look-alikes as Latin letters."""
    return F.translate(text, *P.HOMOGLYPHS)


def is_deflection(text: Column) -> Column:
    return contains_any(F.lower(text), DEFLECTIONS)


def nli_label(text: Column) -> Column:
    """The label of a model's answer: on its last line, else anywhere in it; not mentioned if there is none."""
    low = F.lower(stripped(text))
    last = F.element_at(F.split(low, "\n"), -1)
    is_in = lambda x, name: F.when(F.contains(x, F.lit(name)), F.lit(name))
    absent = lambda x: F.when(contains_any(x, NOT_MENTIONED), F.lit("not_mentioned"))
    return F.coalesce(is_in(last, "entailment"), is_in(last, "contradiction"), absent(last), absent(low), is_in(low, "entailment"), is_in(low, "contradiction"), F.lit("not_mentioned"))


def keeps_grounding(text: Column) -> Column:
    """Whether a free answer is left as it is: it quotes, is long enough, and shows no reasoning."""
    leaked = F.ltrim(text).startswith("1.") | contains_any(text, P.LEAKED)
    return contains_any(text, ["'", '"']) & (F.length(text) >= 300) & ~leaked


def cited(text: Column, passages: Column) -> Column:
    """Distinct zero-based numbers of ``[P1]`` marks within the number of passages."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[P(\d+)\]"), F.lit(1)), lambda x: x.cast("int") - 1)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda i: (i >= 0) & (i < passages))))


def pages_used(text: Column) -> Column:
    """Page numbers of a ``PAGES_USED:`` line."""
    line = F.regexp_extract(text, r"(?i)PAGES_USED\s*:\s*\[?([\d,\s]*)\]?", 1)
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def answer_keywords(answer: Column, answer_type: Column, most: int = 20) -> Column:
    """What to look for on a page that supports an answer: ways to write a number or a date, names, or the telling words of a
    free answer (at most ``most``, each once). A boolean has none."""
    answer = F.trim(answer)
    array = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    number = answer.try_cast("double")
    short = F.when(answer.endswith(".0"), F.substring(answer, F.lit(1), F.length(answer) - 2))
    thousands = F.when((number == F.floor(number)) & (number >= 1000), F.format_number(number, 0))
    day = F.try_to_timestamp(F.when(answer.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), answer), F.lit("yyyy-M-d"))
    dates = [F.date_format(day, f) for f in ("dd MMMM yyyy", "dd MMM yyyy", "MMMM dd, yyyy", "d MMMM yyyy", "dd/MM/yyyy")]
    known = (answer != "") & (F.lower(answer) != "null")
    words = F.filter(F.regexp_extract_all(answer, F.lit(P.ANSWER_WORD), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(P.ANSWER_STOP_WORDS))
    low = F.transform(words, F.lower)
    once = F.slice(F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)
    none = F.array().cast("array<string>")
    found = F.when(answer_type == "number", array(answer, short, thousands)).when(answer_type == "date", array(answer, *dates))
    found = found.when((answer_type == "name") & known, F.array(answer)).when((answer_type == "names") & known, fix_names(answer)).when(answer_type == "free_text", once)
    return F.coalesce(found, none)


def says_absent(question: Column, answer: Column) -> Column:
    """Whether a question asks if something is addressed, without naming a case, and the start of the free answer says that it is not."""
    low = F.lower(question)
    asks = low.startswith("does") & F.contains(low, F.lit("address")) & ~question.rlike(P.CASE_IN_QUESTION)
    return asks & contains_any(F.lower(F.substring(answer, 1, 150)), P.ABSENT_ANSWER)


def topic_absent(question: Column) -> Column:
    """Whether a question asks if a law, not one of its articles, deals with a topic."""
    return contains_any(F.lower(question), P.ABSENT_TOPIC) & ~question.rlike(r"(?i)\bArticle\s+\d")


def several_cases(question: Column) -> Column:
    """Whether a question names two or more different case numbers."""
    return F.size(F.array_distinct(F.regexp_extract_all(question, F.lit(P.CASE_NUMBER), F.lit(0)))) >= 2


def truncated_sentence(text: Column, limit: int = 705) -> Column:
    """The text up to the last whole sentence within the limit, else to the last blank of its second half, else cut."""
    window = F.substring(text, 1, limit)
    sentence = F.regexp_extract(window, r"(?s)^(.*[.!?])(?=\s|$)", 1)
    blank = F.regexp_extract(window, r"(?s)^(.*)\s", 1)
    short = F.when(F.length(sentence) > limit // 2, sentence).when(F.length(blank) > limit // 2, stripped(blank)).otherwise(window)
    return F.when(F.length(text) <= limit, text).otherwise(short)
