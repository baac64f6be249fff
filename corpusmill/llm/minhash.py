"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing. [native]

Every five-word shingle is hashed once. The upper bits of a hash name one of ``BINS`` bins, and a bin
keeps its smallest hash. An empty bin has an order of its own in which it tries the others, by a hash
of (its number, the other's number), and borrows from the first filled one; what it borrows depends on
the filled bins alone, so it agrees in two texts as often as any filled bin does. The low eight bits of each bin
are packed into the fingerprint. Two fingerprints agree in a bin by chance once in 256 cases, which
the likeness corrects for.

Shingles are exploded, hashed and reduced to their bins in generated code; documents are only moved to
bring neighbours together, and the rest are array expressions over the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import partitions, range_bounds, stored

SHINGLE, BINS, LOW_BITS = 5, 128, 8
#: Runs of documents for each shuffle partition: several, so that the tasks are even.
RUNS = 8
_BIN_BITS = BINS.bit_length() - 1


def shingle_minima(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, least) of ``texts`` (keys, side, text): the smallest hash of each bin, code being the bin's number plus
    ``BINS`` for each side before; a text without words has one row with nulls.

    Words are what white space separates; a text of fewer words than a shingle is one shingle. Shingles
    are rows here, hashed and reduced to their bins in one generated loop before anything is shuffled.
    """
    words = texts.select(*keys, "side", F.when(F.col("text").rlike(r"\S"), F.split("text", r"\s+")).alias("words"))
    placed = words.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - SHINGLE))))
    # a word beyond the end is null, which xxhash64 passes over
    shingle = F.xxhash64(*[F.get(F.col("words"), F.col("i") + k) for k in range(SHINGLE)])
    hashed = placed.select(*keys, "side", F.when(F.col("words").isNotNull(), F.shiftrightunsigned(shingle, 1)).alias("h"))
    code = F.shiftright("h", 63 - _BIN_BITS).cast("int") + F.col("side") * BINS
    return hashed.select(*keys, code.alias("code"), "h").groupBy(*keys, "code").agg(F.min("h").alias("least"))


def with_bins(df: DataFrame, minima: str, side: int, out: str) -> DataFrame:
    """``df`` with ``out``: the low bits of all bins of one side of ``minima`` (array of code and least), empty bins filled;
    an empty array for a text without words."""
    filled, codes, leasts = (f"_{out}_{x}" for x in ("filled", "codes", "leasts"))
    df = df.withColumn(filled, F.filter(minima, lambda x: F.shiftright(x["code"], _BIN_BITS) == side))
    # columns of their own, made once for each row: a field of an array of structs would be made anew for each bin
    df = df.withColumns({codes: F.transform(filled, lambda x: x["code"] - side * BINS), leasts: F.transform(filled, lambda x: x["least"])})
    own = lambda b: F.get(leasts, (F.array_position(F.col(codes), b) - 1).cast("int"))
    tried = lambda b: F.zip_with(codes, leasts, lambda c, v: F.struct(F.xxhash64(b, c).alias("order"), v.alias("least")))
    low = lambda b: F.coalesce(own(b), F.array_min(tried(b))["least"]).bitwiseAND((1 << LOW_BITS) - 1).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))
    return df.withColumn(out, F.when(F.size(codes) > 0, F.transform(numbers, low)).otherwise(F.array().cast("array<int>"))).drop(filled, codes, leasts)


def packed(bins: Column) -> Column:
    """Two hexadecimal digits for each bin; empty for a text without words."""
    return F.array_join(F.transform(bins, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, 0 to 1: agreement of the bins, less what agrees by chance. Two texts without words are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    found = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(found)


def _runs(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``run``, the number of a run of doc_ids, and how many runs there are; every run has a document."""
    bounds = range_bounds(rows, "doc_id", RUNS * partitions(rows.sparkSession))
    if bounds and bounds[0] == rows.agg(F.min("doc_id")).first()[0]:
        bounds = bounds[1:]
    # the number of bounds at or below the id, without a lambda: the optimizer overlooks columns in one when it infers filters from joins on ``run``
    after = F.try_add(F.col("doc_id"), F.lit(1).cast("long"))
    place = F.array_position(F.sort_array(F.array_append(F.array(*[F.lit(b).cast("long") for b in bounds]), after)), after) - 1 if bounds else F.lit(0)
    run = F.coalesce(place.cast("int"), F.when(F.col("doc_id").isNull(), 0).otherwise(len(bounds)))
    return rows.withColumn("run", run), len(bounds) + 1


def with_next(rows: DataFrame, runs: int, order: list[str], column: str, out: str) -> DataFrame:
    """``rows`` (with ``run``) with ``out``: ``column`` of the next row in descending order; after the last the first.

    ``order`` starts with an integer. A task holds one run. The neighbour of a run's first row is the last one of the run
    before it; those few rows are picked by their number where they lie, so that ``rows`` is shuffled once."""
    w = Window.partitionBy("run").orderBy(*order)
    placed = rows.withColumns({"_before": F.lag(column).over(w), "_number": F.row_number().over(w)})
    last = rows.groupBy("run").agg(F.max(order[0]).alias("_last")).withColumnRenamed("run", "_run")  # one row for each run
    # one key of both: from two equalities the optimizer infers a filter on ``_last`` out of what ``run`` is made of, and that filter can be wrong
    key = lambda run, place: F.struct(F.col(run).alias("run"), F.col(place).alias("place"))
    ends = rows.join(F.broadcast(last), key("run", order[0]).eqNullSafe(key("_run", "_last")))
    ends = ends.groupBy("run").agg(F.max_by(column, F.struct(*order)).alias("_end"))
    ends = ends.select(F.pmod(F.col("run") + 1, F.lit(runs)).alias("_run"), "_end")
    found = placed.join(ends, (F.col("run") == F.col("_run")) & (F.col("_number") == 1), "left")
    return found.withColumn(out, F.when(F.col("_number") == 1, F.col("_end")).otherwise(F.col("_before"))).drop("_before", "_run", "_end").withColumnRenamed("_number", "number")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text; other columns are ignored) and of their edited texts, one row for each of theirs.

    The edited text is the text with its last half (rounded down, in code points) replaced by the
    start of the next document of the same length, or all of it if it is shorter. The next document
    is that in descending order of doc_id, after the last the first; a null doc_id comes last, rows
    that share a doc_id are ordered by text. Null texts are empty. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows, runs = _runs(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(rows, runs, ["doc_id", "text"], "text", "next_text").select("run", "number", "doc_id", "text", edited.alias("edited"))
    # a row for each text, and one for what is told of the document
    none = lambda kind: F.lit(None).cast(kind)
    side = lambda i, text: F.struct(F.lit(i).alias("side"), text.alias("text"), none("long").alias("id"), none("int").alias("n"), none("string").alias("sha"))
    told = F.struct(F.lit(-1).alias("side"), F.lit("").alias("text"), F.col("doc_id").alias("id"), F.length("text").alias("n"), F.sha2("edited", 256).alias("sha"))
    texts = rows.select("run", "number", F.inline(F.array(told, side(0, F.col("text")), side(1, F.col("edited")))))
    minima = shingle_minima(texts, ["run", "number", "id", "n", "sha"])
    whole = minima.groupBy("run", "number").agg(
        F.max("id").alias("doc_id"), F.max("n").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "least"))).alias("minima"),
    )
    for i, out in enumerate(("own", "changed")):
        whole = with_bins(whole, "minima", i, out)
    found = whole.select(
        "run", "number", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), F.col("own").cast("array<smallint>").alias("bins"),
    )
    after = with_next(stored(found, "fingerprints").withColumnRenamed("number", "place"), runs, ["place"], "bins", "next_bins")
    return after.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
