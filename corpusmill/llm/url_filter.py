"""URL filters: host suffixes and path prefixes, joined on short hash prefixes, confirmed by full digests. [native]

Every URL is expanded into (host suffix, path prefix) expressions and looked up among the rules by
the first four bytes of the expression's SHA-256; hits are confirmed by the whole digest. Only those
depths of host suffix and lengths of path prefix are expanded which some rule has, so the work for a
URL is bounded by the shapes of rules, not by its own length, and every rule is found: a rule that
fits has one of these shapes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many rows are broadcast (a row is under 200 bytes without its strings, which are checked too).
BROADCAST_RULES = 20_000
BROADCAST_BYTES = 8_000_000
#: Rows of one expression are spread over this many keys if rules and URLs are joined by a shuffle.
SALTS = 32


def host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    found = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(
    urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    ``rules`` has verdict, host, path. A rule fits its host and all subdomains, if the URL's path
    starts with the rule's. Of those that fit, the longest (host and path together) decides, then
    the one with the longer host; of two rules for one place that disagree, ``allow``. Rules with a
    null are ignored. Without a rule the verdict is ``default``. Every row of ``urls`` comes back
    once, repeated and null ones too; an empty table of either kind gives a result as well.

    The rules are broadcast if they are at most ``broadcast_rules`` and ``BROADCAST_BYTES``; larger
    ones are joined by a shuffle with salted keys, so that an expression which a third of all URLs
    share is spread over ``SALTS`` tasks. URLs with equal host and path are judged once.
    """
    rules = rules.select("verdict", "host", "path").dropna()
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("_v"))  # allow before block
    shape = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("depths"),
        F.collect_set(F.length("path")).alias("lengths"),
        F.count("*").alias("n"),
        F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes"),
    ).first()

    # the input row in a struct, so that no name can clash
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = urls.select(F.struct(*kept).alias("input") if kept else F.struct(F.lit(0).alias("none")).alias("input"), host(url).alias("host"), path(url).alias("path"))
    told = lambda df, rule, verdict: df.select(*[F.col("input")[c].alias(c) for c in kept], "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    if not shape["n"]:
        return told(base, F.lit(None).cast("string"), F.lit(default))

    depth = F.size(F.split("host", r"\."))
    expressions = (
        base.select("host", "path").distinct()
        .withColumn("_d", F.explode(F.array(*map(F.lit, sorted(shape["depths"])))))
        .where(F.col("_d") <= depth)
        .withColumn("_suffix", F.expr("substring_index(host, '.', -_d)"))
        .withColumn("_n", F.explode(F.array(*map(F.lit, sorted(shape["lengths"])))))
        .where(F.col("_n") <= F.length("path"))
        .withColumn("_digest", _digest(F.col("_suffix"), F.expr("left(path, _n)")))
        .select("host", "path", "_digest", F.substring("_digest", 1, 8).alias("_key"))
    )
    listed = rules.select(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("_host_length"),
        F.col("_v").alias("verdict"),
        _digest(F.col("host"), F.col("path")).alias("_full"),
    ).withColumn("_key", F.substring("_full", 1, 8))
    if shape["n"] <= broadcast_rules and shape["bytes"] <= BROADCAST_BYTES:
        hits = expressions.join(F.broadcast(listed), "_key")
    else:
        salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = expressions.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        hits = spread.join(salted, ["_key", "_salt"])
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "_host_length"))
    decided = hits.where(F.col("_digest") == F.col("_full")).groupBy("host", "path").agg(best.alias("_best"))
    return told(base.join(decided, ["host", "path"], "left"), F.col("_best.rule"), F.coalesce("_best.verdict", F.lit(default)))
