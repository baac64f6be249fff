"""Submission records and the rules they are held against, over all answers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.answers import plain_letters

PAGE = "struct<doc_id: string, page_numbers: array<int>>"


def record(question_id: Column, answer: Column, ttft: Column, total: Column, tokens_in: Column, tokens_out: Column, pages: Column, model: Column) -> Column:
    """One answer as the JSON that is submitted: times and token counts at least one, the total not below the first token,
    pages without a document or a number from one dropped, Cyrillic look-alikes in the answer made Latin."""
    one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1)).cast("long"))
    first = one(ttft)
    whole = F.greatest(first, one(total))
    numbered = F.transform(pages, lambda p: F.struct(p["doc_id"].alias("doc_id"), F.filter(p["page_numbers"], lambda n: n >= 1).alias("page_numbers")))
    kept = F.filter(numbered, lambda p: p["doc_id"].isNotNull() & (F.size(p["page_numbers"]) > 0))
    telemetry = F.struct(
        F.struct(first.alias("ttft_ms"), (whole - first).alias("tpot_ms"), whole.alias("total_time_ms")).alias("timing"),
        F.struct(one(tokens_in).alias("input_tokens"), one(tokens_out).alias("output_tokens")).alias("usage"),
        F.struct(kept.alias("retrieved_chunk_pages")).alias("retrieval"),
        F.coalesce(model, F.lit("unknown")).alias("model_name"),
    )
    entry = F.struct(question_id.cast("string").alias("question_id"), plain_letters(answer).alias("answer"), telemetry.alias("telemetry"))
    return F.to_json(entry, {"ignoreNullFields": "false"})


def errors(entries: DataFrame) -> DataFrame:
    """(position, error) of parsed entries: position, question_id, answer (as JSON text; null: the field is missing), telemetry
    (struct of timing, usage, retrieval and model_name, any of them null). Each rule that an entry breaks is a row."""
    t = F.col("telemetry")
    timing, usage, retrieval, model = (t[n] for n in ("timing", "usage", "retrieval", "model_name"))
    pages = retrieval["retrieved_chunk_pages"]
    again = F.row_number().over(Window.partitionBy("question_id").orderBy("position")) > 1
    # strings of a list are blanked before its other items are looked for
    bare = F.regexp_replace("answer", r'"(?:[^"\\]|\\.)*"', '"')
    broken = {
        "missing question_id": F.col("question_id").isNull(),
        "duplicate question_id": F.col("question_id").isNotNull() & F.col("again"),
        "missing answer": F.col("answer").isNull(),
        "answer has an invalid type": F.col("answer").startswith("{"),
        "an item of the answer is no string": F.col("answer").startswith("[") & bare.rlike(r'[\[,]\s*[^"\s\]]'),
        "missing telemetry": t.isNull(),
    }
    inside = {"missing timing": timing.isNull(), "missing usage": usage.isNull(), "missing retrieval": retrieval.isNull()}
    for part, fields in ((timing, ("ttft_ms", "tpot_ms", "total_time_ms")), (usage, ("input_tokens", "output_tokens"))):
        for f in fields:
            inside[f"missing {f}"] = part.isNotNull() & part[f].isNull()
            inside[f"{f} is negative"] = part[f] < 0
    inside |= {
        "total_time_ms is below ttft_ms": F.coalesce(timing["total_time_ms"], F.lit(0)) < F.coalesce(timing["ttft_ms"], F.lit(0)),
        "total_time_ms is 0": timing.isNotNull() & (F.coalesce(timing["total_time_ms"], F.lit(0)) == 0),
        "missing retrieved_chunk_pages": retrieval.isNotNull() & pages.isNull(),
        "pages without doc_id": F.exists(pages, lambda p: p["doc_id"].isNull()),
        "pages without page_numbers": F.exists(pages, lambda p: p["page_numbers"].isNull()),
        "a page number is below 1": F.exists(pages, lambda p: F.exists(p["page_numbers"], lambda n: n < 1)),
        "missing model_name": model.isNull(),
        "model_name is empty": F.trim(model) == "",
    }
    every = [F.when(rule, name) for name, rule in broken.items()] + [F.when(t.isNotNull() & rule, name) for name, rule in inside.items()]
    return entries.withColumn("again", again).select("position", F.explode(F.array(*every)).alias("error")).where("error is not null")
