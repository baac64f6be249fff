"""Spelling variants: words one edit apart, found by their three rarest positional bigrams.

One inserted, deleted or replaced code point changes at most two bigrams of a word, and moves those behind it by at most
one place. So, in any order of all bigrams, two words at one edit share one of their first three (those of one
bigram in the order of their places): at equal length at the same place, else at the same place or, in the longer word,
one further. The order is by how many words have a bigram, the rarest first, so that few words meet.

Words are joined on (bigram, place, length) of these three and held to one edit while they are joined, so no other
pair leaves the join.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget_encoders, stored

#: Words of the dictionary: code points at least, and occurrences at least.
LENGTH, TIMES = 6, 5
#: One run in so many loses a code point.
DAMAGED = 199
#: A word is a variant of a near word that is so many times as frequent.
RATIO = 5
#: Rarest bigrams of a word that are joined: one more than an edit can change.
RAREST = 3
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Different words that a task counts before it hands them on.
COUNTED = 300_000


def words_of(doc_id: int | None, text: str | None) -> dict[str, int]:
    """The words of one text with their numbers: runs of letters, A-Z in lower case, some without a code point.

    Of a run whose checksum with the doc_id (a null one is written as nothing) is a multiple of ``DAMAGED``, the code point at
    that checksum modulo its length is left out. A null text has no words.
    """
    own, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), {}
    runs = _RUN.findall((text or "").encode().translate(_LOWER).decode())
    times: dict[str, int] = {}
    for run in runs:
        times[run] = times.get(run, 0) + 1
    for run, n in times.items():
        h = zlib.crc32(run.encode(), own)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] = out.get(run, 0) + n
    return out


def word_counts(docs: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n) of the words with at least ``length`` code points and ``times`` occurrences in all ``docs`` (doc_id, text).

    Every task adds up its own words first, so a very frequent word is one row for each task.
    """

    def run(batches):
        import pyarrow as pa

        forget_encoders()
        counts: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    if len(word) >= length:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def rarest(words: DataFrame) -> DataFrame:
    """(word, n, length, bigram, place) of ``words`` (word, n): the three rarest positional bigrams of each word, all of a shorter one.

    How many words have a bigram is counted over all of them; that table has at most the square of the
    alphabet's rows (under 10,000 for the letters of ``words_of``), so the tasks take it along.
    """
    place = F.sequence(F.lit(0), F.length("word") - 2)
    bigrams = F.array_distinct(F.transform(place, lambda i: F.substring("word", i + 1, F.lit(2))))
    found = words.where(F.length("word") >= 2).select(F.explode(bigrams).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("k"))
    rank = {bigram: i for i, (_, bigram) in enumerate(sorted((r.k, r.bigram) for r in found.collect()))}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))[:RAREST]
                out += [(word, n, len(word), word[i : i + 2], i) for _, i in first]
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "n", "length", "bigram", "place"])

    return words.mapInArrow(run, "word string, n long, length int, bigram string, place int")


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n) that one edit tells apart, once; b is longer, or behind in order."""
    marks = rarest(words)
    # the shorter word looks for the same place at its own length and one more, and for the next place at one more
    asked = F.array(*[F.struct(F.lit(i).alias("more"), F.lit(j).alias("next")) for i, j in ((0, 0), (1, 0), (1, 1))])
    left = marks.withColumnRenamed("word", "a").withColumnRenamed("n", "a_n").select("a", "a_n", "bigram", "length", "place", F.inline(asked))
    left = left.select("a", "a_n", "bigram", (F.col("length") + F.col("more")).alias("length"), (F.col("place") + F.col("next")).alias("place"), "more")
    right = marks.withColumnRenamed("word", "b").withColumnRenamed("n", "b_n")
    met = left.join(right, ["bigram", "length", "place"])
    ordered = (F.col("more") == 1) | (F.col("a") < F.col("b"))
    return met.where(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following the forms ends. Each form is ``RATIO`` times as frequent as its
    word, so chains are short; every round doubles the steps that are behind."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        moved = after.where("moved").limit(1).count()
        now = after.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the dictionary of ``docs`` (doc_id, text; other columns are ignored).

    n_near words are one edit away. form is the most frequent of them (ties: the first in code-point order) if it occurs
    ``ratio`` times as often, form_n its number; root is where following forms ends, the word itself without a form.
    Null texts and texts without letters add nothing, repeated rows count again, an empty table gives no rows.
    """
    words = stored(word_counts(docs, length, times), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n"))
    varied = F.col("near_n") >= ratio * F.col("n")
    found = stored(found.select("word", F.when(varied, F.col("near")).alias("form"), "n", "n_near", F.when(varied, F.col("near_n")).alias("form_n")), "variants")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
