"""Strings inside texts, and names inside questions, by joins on n-grams instead of comparing every pair.

``occurrences`` is for substrings: each phrase is looked up by one of its n-grams, the rarest in the texts, at every place
where a text holds that n-gram, and the whole phrase is compared there. ``named`` is for a dictionary: the word n-grams of a
question are joined with names, and a name inside a longer one that is found gives way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from corpusmill.storage import written

#: Characters of an n-gram; a shorter phrase is looked up whole.
GRAM = 6
#: Characters of a text that are cut into n-grams at a time.
BLOCK = 1024
#: Characters of a phrase set, or different n-grams of it, up to which they are sent to every task.
GRAMS_SENT = 500_000
#: Names of a dictionary up to which it is sent to every task.
NAMES_SENT = 100_000
#: Words of a run that is looked up: of a longer name the first ones.
NAME_WORDS = 8


def _grams(df: DataFrame, text: str, size: int, margin: int | None = None) -> DataFrame:
    """Every n-gram of ``text`` with its place ``at``, from one on.

    Texts are cut into blocks first, as finding a place in a text takes time in proportion to it. With ``margin`` rows come with
    ``block``, the text from that many characters before the n-gram's block to as many behind it, and its place ``from``."""
    beside = margin or 0
    blocks = df.withColumn("base", F.explode(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(BLOCK)))).withColumn("from", F.greatest(F.lit(1), F.col("base") - beside))
    blocks = blocks.withColumn("block", F.substring(text, F.col("from"), F.col("base") - F.col("from") + BLOCK + max(beside, size - 1)))
    blocks = blocks.withColumn("last", F.least(F.col("base") + BLOCK - 1, F.col("from") + F.length("block") - size)).where("last >= base")
    if margin is not None:
        blocks = blocks.drop(text)  # the block goes on, not the text
    placed = blocks.withColumn("at", F.explode(F.sequence(F.col("base"), F.col("last")))).drop("base", "last")
    grams = placed.withColumn("gram", F.substring("block", F.col("at") - F.col("from") + 1, F.lit(size)))
    return grams if margin is not None else grams.drop("block", "from")


def occurrences(texts: DataFrame, phrases: DataFrame, unit: str, text: str, pid: str, phrase: str, size: int = GRAM, beside: bool = False) -> DataFrame:
    """(pid, unit, at): every place (from one on) at which a phrase stands in a text; null and empty phrases stand nowhere. With ``beside`` also the
    character ``before`` and ``after`` the phrase there, empty at an end of the text.

    Texts are read once for a set that is sent to the tasks. For a larger one they are read twice: once to count the n-grams that any phrase has, and once for the places of the rarest of
    each phrase; a phrase with an n-gram that no text has is dropped at once.
    """
    held = texts.select(F.col(unit).alias("unit"), F.col(text).alias("body")).where("body is not null")
    asked = phrases.select(F.col(pid).alias("pid"), F.col(phrase).alias("phrase")).where("phrase <> ''")
    asked = written(asked.withColumn("size", F.least(F.length("phrase"), F.lit(size))), "phrases")
    if 0 < (asked.agg(F.sum(F.length("phrase"))).first()[0] or 0) <= GRAMS_SENT:
        return _sent_occurrences(held, asked, beside).withColumnsRenamed({"pid": pid, "unit": unit})
    kinds = asked.groupBy("size").agg(F.max(F.length("phrase")).alias("longest")).collect()  # at most ``size`` rows
    out = None
    for n, longest in sorted(kinds):
        mine = written(_grams(asked.where(F.col("size") == n).withColumn("own", F.col("phrase")), "own", n).select("pid", "phrase", "gram", "at"), "grams")
        known = mine.select("gram").distinct()
        small = F.broadcast if known.count() <= GRAMS_SENT else (lambda df: df)
        counts = _grams(held.select("body"), "body", n).select("gram").join(small(known), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        counted = mine.join(counts, "gram", "left")
        rarest = counted.groupBy("pid", "phrase").agg(F.min_by(F.struct("gram", "at"), F.struct("n", "at")).alias("g"), F.count_if(F.col("n").isNull()).alias("lacking"))
        keys = written(rarest.where("lacking = 0").select("pid", "phrase", F.col("g.gram").alias("gram"), F.col("g.at").alias("offset")), "keys")
        # an n-gram's place less its place in the phrase is the phrase's; the block reaches over the longest phrase
        hits = _grams(held, "body", n, longest).join(small(keys), "gram").withColumn("start", F.col("at") - F.col("offset") + 1)
        same = (F.col("start") >= 1) & (F.substring("block", F.col("start") - F.col("from") + 1, F.length("phrase")) == F.col("phrase"))
        next_to = {"before": F.when(F.col("start") == 1, "").otherwise(F.substring("block", F.col("start") - F.col("from"), F.lit(1))), "after": F.substring("block", F.col("start") - F.col("from") + 1 + F.length("phrase"), F.lit(1))}
        part = hits.where(same).select("pid", "unit", F.col("start").alias("at"), *[c.alias(k) for k, c in next_to.items() if beside])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = asked.select("pid").join(held.select("unit"), F.lit(False)).withColumns({"at": F.lit(0)} | ({"before": F.lit(""), "after": F.lit("")} if beside else {}))
    return out.withColumnsRenamed({"pid": pid, "unit": unit})


def _sent_occurrences(held: DataFrame, asked: DataFrame, beside: bool) -> DataFrame:
    """(pid, unit, at), and with ``beside`` (before, after), of ``held`` (unit, body) for a bounded set ``asked`` (pid, phrase): no part of a text becomes a row."""
    spark, rows = asked.sparkSession, asked.select("pid", "phrase").collect()
    pids = spark.createDataFrame([(i, r.pid) for i, r in enumerate(rows)], Y.StructType([Y.StructField("i", Y.LongType()), asked.schema["pid"]]))
    sent = spark.sparkContext.broadcast([r.phrase.encode() for r in rows])
    next_to = ["before", "after"] if beside else []
    schema = Y.StructType([Y.StructField("i", Y.LongType()), held.schema["unit"], Y.StructField("at", Y.IntegerType()), *[Y.StructField(c, Y.StringType()) for c in next_to]])
    return held.mapInArrow(_places(sent, beside), schema).join(F.broadcast(pids), "i").select("pid", "unit", "at", *next_to)


#: Bytes of a phrase that are compared at once, and bytes of texts that are looked through at a time.
_WORD, _STRETCH = 8, 1 << 20


def _places(sent, beside: bool):
    """Every place of the phrases ``sent`` in a task's texts: by eight bytes (all of a shorter phrase) that few phrases share, then whole."""

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        phrases = sent.value
        kinds = {}
        for i, p in enumerate(phrases):
            kinds.setdefault(min(_WORD, len(p)), []).append(i)
        tables = []
        for n, mine in kinds.items():
            cuts = {i: [int.from_bytes(phrases[i][o : o + n], "little") for o in range(len(phrases[i]) - n + 1)] for i in mine}
            held = Counter(g for every in cuts.values() for g in set(every))
            keyed = sorted((*min((held[g], o, g) for o, g in enumerate(every))[:0:-1], i) for i, every in cuts.items())  # (gram, offset, phrase)
            grams, starts = np.unique(np.array([k[0] for k in keyed], np.uint64), return_index=True)
            marks = np.zeros(1 << 20, bool)
            marks[_slot(grams)] = True
            tables.append((n, grams, np.r_[starts, len(keyed)], np.array([k[1] for k in keyed]), np.array([k[2] for k in keyed]), marks))
        sizes = np.array([len(p) for p in phrases])
        for batch in batches:
            texts = batch.column(1)
            buffers = texts.buffers()
            if not len(texts) or buffers[2] is None:
                continue
            ends = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = memoryview(buffers[2]).cast("B")
            data = np.frombuffer(buffers[2], np.uint8)
            hits = []
            for at in range(int(ends[0]), int(ends[-1]), _STRETCH):
                for n, grams, starts, offsets, which, marks in tables:
                    part = data[at : min(int(ends[-1]), at + _STRETCH + n - 1)]
                    m = len(part) - n + 1
                    if m <= 0:
                        continue
                    word = part[:m].astype(np.uint64)
                    for k in range(min(n, m) if n == _WORD else 0):  # whole words lie there already, at eight places in turn
                        word[k::n] = np.frombuffer(part, "<u8", (m - k + n - 1) // n, k)
                    for k in range(1, n if n < _WORD else 0):
                        word |= part[k : k + m].astype(np.uint64) << np.uint64(8 * k)
                    near = np.flatnonzero(marks[_slot(word)])
                    found = np.searchsorted(grams, word[near])
                    same = grams[np.minimum(found, len(grams) - 1)] == word[near]
                    near, found = near[same] + at, found[same]
                    many = starts[found + 1] - starts[found]
                    each = np.repeat(starts[found] - np.r_[0, np.cumsum(many)[:-1]] if len(many) else many, many) + np.arange(many.sum())
                    row = np.repeat(np.searchsorted(ends, near, side="right") - 1, many)
                    start, phrase = np.repeat(near, many) - offsets[each], which[each]
                    inside = (start >= ends[row]) & (start + sizes[phrase] <= ends[row + 1])
                    hits += [(p, r, s) for p, r, s in zip(phrase[inside].tolist(), row[inside].tolist(), start[inside].tolist(), strict=True) if n < _WORD or raw[s : s + len(phrases[p])] == phrases[p]]
            if not hits:
                continue
            phrase, row, start = (np.array(c) for c in zip(*hits, strict=True))
            # characters between the places of hits and the beginnings of their texts: bytes that begin one
            known = np.unique(np.r_[start, ends[row]])
            counts = np.add.reduceat((data[: int(ends[-1])] & 0xC0) != 0x80, known, dtype=np.int64)
            chars = np.r_[0, np.cumsum(counts)]
            place = chars[np.searchsorted(known, start)] - chars[np.searchsorted(known, ends[row])] + 1
            columns = {"i": pa.array(phrase), "unit": batch.column(0).take(pa.array(row)), "at": pa.array(place, pa.int32())}
            if beside:
                stop = start + sizes[phrase]
                columns["before"] = pa.array([_character(raw, s, int(ends[r]), -1) for s, r in zip(start.tolist(), row.tolist(), strict=True)], pa.string())
                columns["after"] = pa.array([_character(raw, e, int(ends[r + 1]), 1) for e, r in zip(stop.tolist(), row.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _character(raw, at: int, end: int, step: int) -> str:
    """The character that ends (``step`` -1) or begins (1) at a byte, empty at the text's ``end``."""
    other = at
    while other != end:
        other += step
        if other == end or raw[other] & 0xC0 != 0x80:
            break
    return bytes(raw[min(at, other) : max(at, other)]).decode(errors="replace")


def _slot(grams):
    """One of 2^20 slots for each n-gram."""
    import numpy as np

    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def containing(texts: DataFrame, phrases: DataFrame, unit: str, text: str, pid: str, phrase: str, size: int = GRAM) -> DataFrame:
    """(pid, unit): texts that hold a phrase, each once."""
    return occurrences(texts, phrases, unit, text, pid, phrase, size).select(pid, unit).distinct()


def words(text):
    """Lower-cased words and numbers of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def named(questions: DataFrame, names: DataFrame, qid: str, text: str, name: str, most: int | None = NAME_WORDS) -> DataFrame:
    """(qid, name, start, size): names whose words stand in a question's text one after the other, at each place (word ``start``,
    from zero); one that lies inside a longer one found there gives way. Names longer than ``most`` words are not found; without ``most`` all are,
    those of more than ``NAME_WORDS`` words by their first ones, with the others compared at the same place."""
    held = questions.select(F.col(qid).alias("qid"), words(F.col(text)).alias("w"))
    keys = names.select(F.col(name).alias("name"), words(F.col(name)).alias("w")).where(F.size("w") > 0)
    first = NAME_WORDS if most is None else most
    keys = keys.select("name", F.size("w").cast("int").alias("whole"), F.least(F.size("w"), F.lit(first)).cast("int").alias("size"), F.array_join(F.slice("w", 1, first), " ").alias("run"), F.array_join(F.slice("w", first + 1, F.greatest(F.size("w"), F.lit(1))), " ").alias("rest"))
    keys = written((keys if most is None else keys.where(F.col("whole") <= most)).distinct(), "names")
    sizes = {r.size: r.longest for r in keys.groupBy("size").agg(F.max("whole").alias("longest")).orderBy("size").collect()}  # at most ``first``
    if not sizes:
        return held.select(F.col("qid").alias(qid), F.lit("").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("size")).where("false")
    # every run of as many words as some name has, or begins with
    runs = held.select("qid", "w", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.size("w") >= F.col("size"))
    runs = runs.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    run = F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ").alias("run")
    over = sizes.get(first, first) - first  # words of the longest name behind its first ones
    after = [F.when(F.col("size") == first, F.array_join(F.slice("w", F.col("start") + first + 1, F.lit(over)), " ")).alias("after")] if over else []
    runs = runs.select("qid", "start", "size", run, *after)
    hits = runs.join(F.broadcast(keys) if keys.count() <= NAMES_SENT else keys, ["run", "size"])
    if over:
        hits = hits.where((F.col("whole") == F.col("size")) | F.startswith(F.concat("after", F.lit(" ")), F.concat("rest", F.lit(" "))))
    hits = hits.select("qid", "name", "start", F.col("whole").alias("size"))
    every = hits.groupBy("qid").agg(F.collect_list(F.struct("name", "start", "size")).alias("h"))  # of one question: names at its runs
    inside = lambda x, y: (y["start"] <= x["start"]) & (y["start"] + y["size"] >= x["start"] + x["size"]) & (y["size"] > x["size"])
    kept = every.select("qid", F.inline(F.filter("h", lambda x: ~F.exists("h", lambda y: inside(x, y)))))
    return kept.select(F.col("qid").alias(qid), "name", "start", "size")
