"""Metrics over all answers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import answers as A


def precision_recall(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets; all one if both are empty."""
    same = F.size(F.array_intersect(predicted, gold)).cast("double")
    p, r = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    empty = (p == 0) & (r == 0)
    precision = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(same, p), F.lit(0.0)))
    recall = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(same, r), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return precision, recall, f1


def f_beta(precision: Column, recall: Column, beta: float = 2.5) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def found_gold(questions: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, hit): whether any of a question's ``gold`` (qid, unit) is among the ``found`` (qid, unit); null for a question (qid) without gold."""
    held = found.select("qid", "unit").distinct().withColumn("held", F.lit(True))
    hits = gold.join(held, ["qid", "unit"], "left").groupBy("qid").agg(F.bool_or(F.coalesce("held", F.lit(False))).alias("hit"))
    return questions.select("qid").join(hits, "qid", "left")


def reranked_gold(questions: DataFrame, gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, hit, dropped): whether a question's gold is still there after a second scorer, and whether that scorer lost it."""
    had = found_gold(questions, gold, before).withColumnRenamed("hit", "had")
    return found_gold(questions, gold, after).join(had, "qid").select("qid", "hit", (F.col("had") & ~F.col("hit")).alias("dropped"))


def relevant_citations(answers: DataFrame) -> DataFrame:
    """(qid, has_relevant, deflected, n_cited, precision, recall, f1, raf) of ``answers`` (qid, response, relevant: a flag for each passage).

    ``raf``: without a relevant passage one for declining and nothing for an answer; else nothing for declining or citing nothing, and the
    share of relevant ones among the cited passages."""
    relevant = F.filter(F.transform("relevant", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    rows = answers.select("qid", relevant.alias("gold"), A.cited(F.col("response"), F.size("relevant")).alias("cited"), A.is_deflection(F.col("response")).alias("deflected"))
    p, r, f1 = precision_recall(F.col("cited"), F.col("gold"))
    has, n = F.size("gold") > 0, F.size("cited")
    raf = F.when(~has, F.col("deflected").cast("double")).when(F.col("deflected") | (n == 0), 0.0).otherwise(p)
    return rows.select("qid", has.alias("has_relevant"), "deflected", n.alias("n_cited"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), raf.alias("raf"))


def citation_summary(scores: DataFrame) -> DataFrame:
    """One row of the means of ``relevant_citations``; ``eligibility``: answers that cite, ``true_rate`` and ``false_rate``: declined
    questions, of those with and without relevant passages; nothing where there are none."""
    has, declined = F.col("has_relevant"), F.col("deflected").cast("int")
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    means = [F.avg(c).alias(c) for c in ("raf", "precision", "recall", "f1")]
    answered = ((F.col("n_cited") > 0) & ~F.col("deflected")).cast("int")
    return scores.agg(
        F.count("*").alias("n"), F.count_if(has).alias("with_relevant"), *means, share(F.when(has, answered)).alias("eligibility"),
        share(F.when(~has, declined)).alias("true_rate"), share(F.when(has, declined)).alias("false_rate"),
    )


# Weights of exact and of free answers.
EXACT, FREE = 0.7, 0.3


def total_score(graded: DataFrame) -> DataFrame:
    """(exact, free, grounding, telemetry, speed, total) of ``graded`` (answer_type, quality, grounding, telemetry, speed: numbers for each question).

    Exact and free answers are weighted by their mean qualities (one without questions counts nothing), and the sum is multiplied by the means of the other three."""
    free = F.col("answer_type") == "free_text"
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    parts = graded.agg(mean(F.when(~free, F.col("quality"))).alias("exact"), mean(F.when(free, F.col("quality"))).alias("free"), *[mean(c).alias(c) for c in ("grounding", "telemetry", "speed")])
    return parts.withColumn("total", (EXACT * F.col("exact") + FREE * F.col("free")) * F.col("grounding") * F.col("telemetry") * F.col("speed"))


def class_metrics(pairs: DataFrame, gold: str, predicted: str, by: str) -> DataFrame:
    """(overall, by, label, precision, recall, f1, support): every label for each ``by`` and, where ``overall`` (``by`` is null there), for all rows.

    One pass over the rows: a confusion table of both levels as grouping sets."""
    named = pairs.select(F.col(by).alias("by"), F.col(gold).alias("g"), F.col(predicted).alias("p"))
    table = named.groupingSets([[F.col("by"), F.col("g"), F.col("p")], [F.col("g"), F.col("p")]], "by", "g", "p").agg(F.count("*").alias("n"), (F.grouping("by") == 1).alias("overall"))
    sides = table.select("overall", "by", F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit(1).alias("gold"), F.lit(0).alias("pred")), F.struct(F.col("p").alias("label"), F.lit(0).alias("gold"), F.lit(1).alias("pred")))).alias("s"), "g", "p", "n")
    per = sides.groupBy("overall", "by", "s.label").agg(
        F.sum(F.col("n") * F.col("s.gold")).alias("support"), F.sum(F.col("n") * F.col("s.pred")).alias("claimed"),
        F.sum(F.when((F.col("g") == F.col("p")) & (F.col("s.gold") == 1), F.col("n")).otherwise(0)).alias("tp"),
    )
    precision, recall = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col(c)), F.lit(0.0)) for c in ("claimed", "support"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return per.select("overall", F.col("by").alias(by), "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp")


def class_summary(metrics: DataFrame, by: str) -> DataFrame:
    """(overall, by, n, accuracy, macro_f1) of the rows of ``class_metrics``; labels without support do not count for the mean."""
    return metrics.groupBy("overall", by).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"))


def run_statistics(runs: DataFrame, by: str, value: str, shares: dict[str, float], input_price: float, output_price: float) -> DataFrame:
    """(overall, by, ...): statistics of answered questions for each ``by`` and for all, as grouping sets.

    Counts, null answers, pages a question, questions without a page, tokens and their cost (prices are for a million); of
    the positive values of ``value`` mean, largest and exact quantiles (zero-based rank ``min(int(share * n), n - 1)``), for which values are counted first."""
    both = lambda df, *keys: df.groupingSets([[F.col(by), *map(F.col, keys)], [F.col(k) for k in keys]], by, *keys)
    level = (F.grouping(by) == 1).alias("overall")
    timed = F.when(F.col(value) > 0, F.col(value))
    totals = both(runs).agg(
        level, F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("nulls"), F.avg("n_pages").alias("pages_per_question"), F.count_if(F.col("n_pages") == 0).alias("without_pages"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg(timed).alias("mean"), F.max(timed).alias("top"),
    )
    counted = both(runs.where(F.col(value) > 0), value).agg(level, F.count("*").alias("c"))
    group = ["overall", by]
    w = Window.partitionBy(*group)
    ranked = counted.withColumns({"end": F.sum("c").over(w.orderBy(value)), "all": F.sum("c").over(w)})
    at = lambda share: F.least(F.floor(share * F.col("all")), F.col("all") - 1)
    ranks = ranked.groupBy(*group).agg(*[F.min(F.when(F.col("end") > at(share), F.col(value))).alias(name) for name, share in shares.items()])
    cost = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000
    same = (totals["overall"] == ranks["overall"]) & totals[by].eqNullSafe(ranks[by])
    return totals.join(ranks, same, "left").select(*[totals[c] for c in totals.columns], *shares, cost.alias("cost"))


def merged_spans(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching half-open spans of a group as one (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def with_every(rows: DataFrame, stated: DataFrame, block: int = 1_000) -> DataFrame:
    """Every row with every row of a stated set, which is sent to the tasks in blocks of about ``block``."""
    blocks, out = max(1, -(-stated.count() // block)), None
    for i in range(blocks):
        part = rows.join(F.broadcast(stated.where(F.pmod(F.xxhash64(*stated.columns), F.lit(blocks)) == i)))
        out = part if out is None else out.union(part)
    return out


def char_overlap(spans: DataFrame, qid: str, file: str, kind: str, start: str, end: str) -> DataFrame:
    """(qid, precision, recall) of the characters of spans of kind ``pred`` against those of kind ``gold``; nothing where a side is empty."""
    merged = merged_spans(spans, [qid, file, kind], start, end)
    size = F.sum(F.col(end) - F.col(start))
    pred, gold = merged.where(F.col(kind) == "pred"), merged.where(F.col(kind) == "gold")
    other = gold.select(qid, file, F.col(start).alias("gs"), F.col(end).alias("ge"))
    met = pred.join(other, [qid, file]).where((F.col(start) < F.col("ge")) & (F.col("gs") < F.col(end)))
    both = met.groupBy(qid).agg(F.sum(F.least(end, "ge") - F.greatest(start, "gs")).alias("s"))
    sides = pred.groupBy(qid).agg(size.alias("p")).join(gold.groupBy(qid).agg(size.alias("g")), qid, "full").join(both, qid, "left")
    part = lambda c: F.coalesce(F.try_divide(F.col("s"), F.col(c)), F.lit(0.0))
    return sides.select(qid, part("p").alias("precision"), part("g").alias("recall"))


def padded(labels: Column, n: int) -> Column:
    """The first ``n`` labels, false where there are fewer."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit(False), n)), 1, n)
