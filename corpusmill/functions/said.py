"""What models and hand-made files say, as columns: JSON in several shapes, inside other text, or broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import stripped

_NONE = "array<string>"


def _filled(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.array().cast(_NONE)), lambda x: x.isNotNull() & (x != ""))


def party_names(raw: Column) -> Column:
    """Names of a party in JSON: a list of objects with a name, one object with ``name`` and ``names``, or a string; blank names are dropped, anything else has none."""
    raw = F.trim(raw)
    kind = F.substring(raw, 1, 1)
    listed = F.transform(F.from_json(raw, "array<struct<name string>>"), lambda x: x["name"])
    one = F.from_json(raw, "name string, names array<string>")
    own = F.concat(F.array(one["name"]), F.coalesce(one["names"], F.array().cast(_NONE)))
    text = F.array(F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), _NONE), F.lit(0)))
    return F.when(kind == "[", _filled(listed)).when(kind == "{", _filled(own)).when(kind == '"', _filled(text)).otherwise(F.array().cast(_NONE))


def passage_text(raw: Column, place: Column) -> Column:
    """The text of the passage at ``place`` (from zero) in JSON: its field ``cite_{place + 1}``, else the first ``cite_`` field, trimmed; a passage that is no
    object, or has no such field, as it is."""
    fields = F.from_json(raw, "map<string,string>")
    own = F.try_element_at(fields, F.concat(F.lit("cite_"), (place + 1).cast("string")))
    cited = F.get(F.map_values(F.map_filter(fields, lambda k, v: k.startswith("cite_"))), F.lit(0))
    return F.when(F.ltrim(raw).startswith("{"), F.coalesce(F.trim(own), F.trim(cited), raw)).otherwise(raw)


def object_in(text: Column, schema: str) -> Column:
    """The object between the outermost braces of an answer; null without one, or where it can't be read."""
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.from_json(braces, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return F.when(parsed["_broken"].isNull(), parsed)


def unfenced(text: Column) -> Column:
    """An answer without the code fence around it."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def question_answers(text: Column) -> Column:
    """Pairs (q, a) of a fenced JSON list; entries that lack either are dropped, and what is no list has none."""
    pairs = F.from_json(unfenced(text), "array<struct<q string, a string>>")
    return F.filter(F.coalesce(pairs, F.array().cast("array<struct<q:string,a:string>>")), lambda p: p["q"].isNotNull() & p["a"].isNotNull())


def page_scores(text: Column, n: Column) -> Column:
    """Scores by number, from one to ``n``, of the first flat object of an answer; a comma before its end is forgiven, other keys and values are dropped."""
    flat = F.regexp_replace(F.regexp_extract(text, r"\{[^{}]+\}", 0), r",\s*\}", "}")
    told = F.coalesce(F.from_json(F.nullif(flat, F.lit("")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = F.transform(F.map_entries(told), lambda e: F.struct(e["key"].try_cast("int").alias("item"), e["value"].try_cast("double").alias("score")))
    return F.filter(pairs, lambda p: p["item"].between(1, n) & p["score"].isNotNull())


def blended(told: Column, other: Column, share: float = 0.7) -> Column:
    """A model's score, held to 0 to 1 and a half if missing, blended with the logistic of another scorer's."""
    return share * F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), told)), F.lit(0.5)) + (1 - share) / (1 + F.exp(-other))
