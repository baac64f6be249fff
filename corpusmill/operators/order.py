"""Totals in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, key: str, *ties: str, amount: Column | None = None, out: str = "position") -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` (rows, if none is given) over all rows up to this one, in ascending order
    of an integer ``key`` (nulls last), then of ``ties``.

    Keys are cut into about as many runs as there are shuffle partitions; each run is summed by itself, and the totals of
    the runs before it, one row a run, are added. Rows that share one key lie in one run.
    """
    amount = F.lit(1) if amount is None else amount
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n for i in range(1, n)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, F.array(*map(F.lit, cuts)), F.lit(10_000))).first()[0] or [])) if cuts else []
    below = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    rows = df.withColumns({"_run": F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(below), "_amount": amount.cast("long")})
    totals = rows.groupBy("_run").agg(F.sum("_amount").alias("_total"))  # one row for each run
    before = Window.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_run", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn(out, F.sum("_amount").over(inside)).join(F.broadcast(offsets), "_run")
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop("_run", "_amount", "_before")
