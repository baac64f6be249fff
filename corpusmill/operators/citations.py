"""Citations: verification, replacement, caps and clearing rules over all answers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIRMED, WEAK, NO_SUPPORT = "CONFIRMED", "WEAK", "NO_SUPPORT"
#: Shares of keywords for a confirmed and for a weak page, by type of answer; without one, any keyword confirms.
SHARES = {"boolean": (0.5, 0.25), "names": (0.5, 0.000001), "free_text": (0.4, 0.2)}


def page_status(answer_type: Column, keywords: Column, text: Column) -> Column:
    """How far a page supports an answer: by the share of the answer's keywords that stand in it."""
    low = F.lower(text)
    held = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    share = held / F.size(keywords)
    status = F.when(held > 0, CONFIRMED).otherwise(NO_SUPPORT)
    for kind, (confirmed, weak) in SHARES.items():
        status = F.when(answer_type == kind, F.when(share >= confirmed, CONFIRMED).when(share >= weak, WEAK).otherwise(NO_SUPPORT)).otherwise(status)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", NO_SUPPORT).when(F.size(keywords) == 0, WEAK).otherwise(status)


def scan_position(page: Column, cited: Column) -> Column:
    """The order in which other pages are tried: one before, one after, two before, two after, then from the first."""
    near = F.when(page == cited - 1, 1).when(page == cited + 1, 2).when(page == cited - 2, 3).when(page == cited + 2, 4)
    return F.coalesce(near, page + 4)


def best_pages(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The page that replaces an unsupported one: the first confirmed, else the first weak in scan order."""
    order = F.when(F.col("status") == CONFIRMED, 0).otherwise(1)
    w = Window.partitionBy(*by).orderBy(order, "position", "page")
    return candidates.where(F.col("status") != NO_SUPPORT).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def grouped(pages: DataFrame, by: list[str]) -> DataFrame:
    """Distinct pages of each document in order, as one array."""
    return pages.groupBy(*by).agg(F.sort_array(F.collect_set("page")).alias("pages"))


def validated(cited: DataFrame, retrieved: DataFrame, keys: list[str], qid: str = "qid") -> DataFrame:
    """Citations that were retrieved; for an answer that has none left, all that was retrieved."""
    kept = cited.join(retrieved.select(*keys), keys, "left_semi")
    bare = retrieved.join(kept.select(qid).distinct(), qid, "left_anti").join(cited.select(qid).distinct(), qid, "left_semi")
    return kept.select(*keys).union(bare.select(*keys))


def capped(pages: DataFrame, qid: str, most: int) -> DataFrame:
    """If an answer cites more than ``most`` pages: the first page of its first ``most`` documents; else all."""
    total = F.count("*").over(Window.partitionBy(qid))
    first = F.row_number().over(Window.partitionBy(qid, "doc").orderBy("page"))
    ranked = pages.withColumns({"total": total, "first": first})
    doc = F.dense_rank().over(Window.partitionBy(qid).orderBy("doc"))
    return ranked.withColumn("nth", doc).where((F.col("total") <= most) | ((F.col("first") == 1) & (F.col("nth") <= most))).drop("total", "first", "nth")


def overridden(answers: DataFrame, fixes: DataFrame, answer: str, fix: str) -> DataFrame:
    """``answers`` (qid, answer) with ``overridden``: an answer checked by hand (``fixes``: qid, fix; a null one says that there is none) takes the place of the given one."""
    own = fixes.select("qid", F.col(fix).alias("_fix"), F.lit(True).alias("_fixed"))
    known = F.coalesce("_fixed", F.lit(False))
    return answers.join(own, "qid", "left").select("qid", F.when(known, F.col("_fix")).otherwise(F.col(answer)).alias(answer), known.alias("overridden"))
