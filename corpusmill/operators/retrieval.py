"""Lexical, dense and fused retrieval over all questions at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

#: Parameters of the usual BM25 variant with a logarithm that stays positive.
K1, B = 1.5, 0.75
RRF_K = 60
#: Query vectors are laid against all vectors in blocks of this size, so what is sent to every task is bounded.
QUERY_BLOCK = 2_000


def identifier_docs(questions: DataFrame, docs: DataFrame, qid: str = "qid", unit: str = "doc_id") -> DataFrame:
    """(qid, unit): documents (unit, text) that hold a case or law number of the question (qid, text), in any spelling. If any
    of a question's documents has one of its years, only such documents stay. Numbers meet by equality in canonical form."""
    asked = questions.select(qid, T.years(F.col("text")).alias("asked"), F.explode(T.identifiers(F.col("text"))).alias("key"))
    held = docs.select(unit, T.years(F.col("text")).alias("held"), F.explode(T.identifiers(F.col("text"))).alias("key"))
    hits = asked.join(held, "key").groupBy(qid, unit).agg(F.bool_or(F.arrays_overlap("asked", "held")).alias("in_year"))
    known = hits.groupBy(qid).agg(F.bool_or("in_year").alias("any_in_year"))
    return hits.join(known, qid).where("in_year or not any_in_year").select(qid, unit)


def top_k(scores: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from one; a partial limit runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def reranked(candidates: DataFrame, qid: str, before: str, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` candidates of each question by a scorer's ``score``, ties in their order ``before``; where there are no
    more than ``k`` they stay in that order."""
    few = F.count("*").over(Window.partitionBy(qid)) <= k
    return top_k(candidates.withColumn("_few", few), [qid], [F.when(F.col("_few"), 0.0).otherwise(-F.round(score, 9)), F.col(before)], k).drop("_few")


def best_first(score: str = "score", *ties: str) -> list[Column]:
    """Order by score, on nine digits so that the order of summing does not decide, then by ids."""
    return [F.round(F.col(score), 9).desc(), *[F.col(t).asc() for t in ties]]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector at unit length; zeros stay."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def dense_top_k(queries: DataFrame, units: DataFrame, qid: str, unit: str, vector: str, k: int, block: int = QUERY_BLOCK, rank: str = "rank") -> DataFrame:
    """(qid, unit, score, rank): the ``k`` units with the largest exact inner product for each query of a stated set.

    Every task scores its units against a block of queries as matrix products and keeps the best ``k`` of each query
    (ties by unit), so that only these meet. Ids are longs."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())  # a row without a whole vector is not found and finds nothing
    asked = queries.where(whole).select(F.col(qid).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("q"))
    blocks = max(1, -(-asked.count() // block))
    rows, out = units.where(whole).select(F.col(unit).cast("long"), F.col(vector).cast("array<double>")), None
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).orderBy("qid").collect()  # a bounded block
        if not mine:
            continue
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r.qid for r in mine], np.int64), np.array([r.q for r in mine], float)))
        part = rows.mapInArrow(_best_of_task(sent, k), "qid long, unit long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "qid long, unit long, score double")
    out = out.withColumnsRenamed({"qid": qid, "unit": unit})
    return top_k(out, [qid], best_first("score", unit), k, rank)


def _best_of_task(sent, k: int):
    def run(batches):
        import pyarrow as pa

        ids, vectors = sent.value
        kept = {at: (np.full((len(ids[at : at + _AT_ONCE]), 0), 0.0), np.full((len(ids[at : at + _AT_ONCE]), 0), 0, np.int64)) for at in range(0, len(ids), _AT_ONCE)}
        for batch in batches:
            units = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy().reshape(len(units), -1)
            for first in range(0, len(units), 4096):
                part, there = units[first : first + 4096], flat[first : first + 4096].T
                for at, (best, named) in kept.items():  # so many queries that their scores stay small
                    scores = np.concatenate([best, vectors[at : at + _AT_ONCE] @ there], axis=1)
                    names = np.concatenate([named, np.broadcast_to(part, (len(best), len(part)))], axis=1)
                    order = np.lexsort((names, -scores.round(9)))[:, :k]
                    kept[at] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)
        for at, (best, named) in kept.items():
            m = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + _AT_ONCE], m)), pa.array(named.ravel()), pa.array(best.ravel())], ["qid", "unit", "score"])

    return run


#: Stands for a null group inside a task; scores of a batch are made for this many queries at a time.
_NO_GROUP, _AT_ONCE = -(2**63), 256


def dense_group_max(queries: DataFrame, units: DataFrame, qid: str, groups: tuple[str, str], vector: str, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, groups, score): for each query of a stated set the largest exact inner product with a unit of each group, such as a page.

    Every task scores its units against a block of queries and keeps one row for each query and group of a batch; pairs of queries and
    units never become rows. Ids are longs; a group of nulls is one group; rows without a whole vector don't count."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    asked = queries.where(whole).select(F.col(qid).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("q"))
    blocks, out = max(1, -(-asked.count() // block)), None
    rows = units.where(whole).select(*[F.coalesce(F.col(g).cast("long"), F.lit(_NO_GROUP)) for g in groups], F.col(vector).cast("array<double>"))
    schema = "qid long, a long, b long, score double"
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # a bounded block
        if not mine:
            continue
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r.qid for r in mine], np.int64), np.array([r.q for r in mine], float)))
        part = rows.mapInArrow(_best_of_groups(sent), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema)
    known = lambda c, name: F.when(F.col(c) != _NO_GROUP, F.col(c)).alias(name)
    best = out.groupBy("qid", "a", "b").agg(F.max("score").alias("score"))
    return best.select(F.col("qid").alias(qid), known("a", groups[0]), known("b", groups[1]), "score")


def _best_of_groups(sent):
    def run(batches):
        import pyarrow as pa

        ids, vectors = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            flat = batch.column(2).flatten().to_numpy().reshape(len(a), -1)[order]
            for at in range(0, len(ids), _AT_ONCE):
                part = ids[at : at + _AT_ONCE]
                best = np.maximum.reduceat(vectors[at : at + _AT_ONCE] @ flat.T, starts, axis=1)
                columns = np.repeat(part, len(starts)), np.tile(a[starts], len(part)), np.tile(b[starts], len(part)), best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "a", "b", "score"])

    return run


def fused_documents(signals: dict[str, DataFrame], weights: dict[str, float], qid: str, doc: str, pool: int, most: int = 3, gap: float = 0.15) -> DataFrame:
    """(qid, doc, score, rank): documents by weighted reciprocal ranks over several signals (qid, doc, score), of each its
    ``pool`` best; of the fused ranking the first and up to ``most`` whose score is within ``gap`` of it."""
    rankings = [(top_k(s, [qid], best_first("score", doc), pool), weights[name]) for name, s in signals.items()]
    return gap_select(rrf(rankings, qid, doc), qid, gap, most, doc)


def rrf(rankings: list[tuple[DataFrame, float]], qid: str, unit: str, rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """(qid, unit, score): weighted reciprocal ranks (counted from one) of several rankings, summed."""
    out = None
    for ranking, weight in rankings:
        part = ranking.select(qid, unit, (F.lit(float(weight)) / (k + F.col(rank))).alias("w"))
        out = part if out is None else out.union(part)
    return out.groupBy(qid, unit).agg(F.sum("w").alias("score"))


def additive(dense: DataFrame, lexical: DataFrame, qid: str, unit: str, weight: float = 0.3) -> DataFrame:
    """Dense scores plus weighted lexical ones, of units that have either."""
    both = dense.select(qid, unit, F.col("score").alias("d")).join(lexical.select(qid, unit, F.col("score").alias("l")), [qid, unit], "full")
    return both.select(qid, unit, (F.coalesce("d", F.lit(0.0)) + weight * F.coalesce("l", F.lit(0.0))).alias("score"))


def gap_select(scores: DataFrame, by: str, gap: float, most: int, *ties: str) -> DataFrame:
    """The best unit and those whose score lies within ``gap`` of it, in proportion, at most ``most``."""
    w = Window.partitionBy(by).orderBy(*best_first("score", *ties))
    top = F.first("score").over(w)
    ranked = scores.withColumns({"rank": F.row_number().over(w), "top": top})
    return ranked.where((F.col("rank") <= most) & ((F.col("rank") == 1) | ((F.col("top") - F.col("score")) / F.col("top") <= gap))).drop("top")


def round_robin(hits: DataFrame, by: str, group: str, each: int, *order: Column) -> DataFrame:
    """The first ``each`` hits of every group, dealt in turn: ``position`` counts from one."""
    inner, outer = Window.partitionBy(by, group).orderBy(*order), Window.partitionBy(by)
    dealt = hits.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= each)
    return dealt.withColumn("position", F.row_number().over(outer.orderBy("turn", group)))
