"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

A fingerprint has three segments, A and B of 23 bits and C of 18. The binary Golay code of length 23
is perfect, with covering radius three, so any two words at two or fewer differing bits lie within
four bits of a common codeword (the one nearest to a word between them). A word has one codeword
within four bits if it lies within two bits of one, else six. Indices of these codewords are the keys of a segment.

If two fingerprints differ in at most four bits, one of these holds (a, b, c: differing bits in A, B, C):

* a = 0, b <= 2:      A itself, and a codeword near B;
* b = 0, a <= 2:      a codeword near A, and B itself;
* 1 <= a, b <= 2:     codewords near A and near B, and one third of C (c <= 2);
* a >= 3, c = 0:      a codeword near B (b <= 1), and C;
* a >= 3, c = 1:      B itself (b = 0), and one half of C;
* b >= 3:             the same with A and B changed.

So fingerprints are joined on these composite keys of 30 to 41 bits and verified. Only distinct
fingerprints are joined, so groups of exact copies cost one row each.

``near_duplicates`` links fingerprints of 64 bits at up to four differing bits and misses none.
``similar_documents`` is for a similarity of texts instead: several fingerprints of each text are
joined in this way, one after the other, and a candidate pair is verified over the bits of all of
them, whose share of differing bits tells the cosine of the texts' shingle counts.
"""

from __future__ import annotations

from array import array
from functools import cache, reduce
from math import acos, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget_encoders, partitions, stored
from corpusmill.llm.components import forest, least_labels

#: Generator polynomial of the cyclic binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SHINGLE, BITS, SEED = 4, 4, 42
#: For similar texts: words of a shingle, cosine of shingle counts, fingerprints of each text, and of how many of these the keys are on disk at once.
WORDS, SIMILARITY, ROUNDS, AT_ONCE = 5, 0.8, 12, 2
#: A bucket is searched by one task up to this many fingerprints; larger ones are cut and all pairs of cuts are searched.
BUCKET = 20_000
#: Links that are thinned in one task's memory.
LINKS = 250_000
#: Where a key holds the number of its fingerprint: above the kind (58 to 60).
ROUND_AT = 61
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@cache
def _golay():
    """Remainders of the upper twelve bits, and for each remainder the six error patterns of up to four bits (the first repeated)."""
    from itertools import combinations

    import numpy as np

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << bit - 11
        return word

    upper = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            near = found[int(upper[word >> 11]) ^ (word & 2047)]
            if weight < 4 or near and near[0].bit_count() == 3:
                near.append(word)
    return upper, np.array([x + x[:1] * (6 - len(x)) for x in found], np.int64), np.array([len(x) for x in found])


def codewords(words):
    """For 23-bit words: indices of the codewords within four bits, (n, 6), and how many of the six are distinct."""
    upper, patterns, sizes = _golay()
    rest = upper[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[rest]) >> 11, sizes[rest]


def keys(fingerprints):
    """All composite keys of distinct fingerprints: (keys, which fingerprint each belongs to)."""
    import numpy as np

    f = fingerprints.astype(np.uint64)
    a, b, c = ((f >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    near_a, n_a = codewords(a)
    near_b, n_b = codewords(b)
    n, one = len(f), np.arange(6)
    in_a, in_b = one < n_a[:, None], one < n_b[:, None]
    out, owner = [], []

    def put(kind, key, where=None):
        key = np.broadcast_to(key, (n, *key.shape[1:])).reshape(n, -1)
        mine = np.broadcast_to(np.arange(n)[:, None], key.shape)
        on = slice(None) if where is None else np.broadcast_to(where, key.shape)
        out.append((key | kind << 58)[on].ravel())
        owner.append(mine[on].ravel())

    put(1, a[:, None] << 12 | near_b, in_b)
    put(2, b[:, None] << 12 | near_a, in_a)
    pair = (near_a[:, :, None] << 12 | near_b[:, None, :]).reshape(n, 36)
    both = (in_a[:, :, None] & in_b[:, None, :]).reshape(n, 36)
    for j in range(3):
        put(3, (pair << 2 | j) << 6 | (c[:, None] >> 6 * j & 63), both)
    put(4, near_b << 18 | c[:, None], in_b)
    put(5, near_a << 18 | c[:, None], in_a)
    for j in range(2):
        half = c[:, None] >> 9 * j & 511
        put(6, (b[:, None] << 1 | j) << 9 | half)
        put(7, (a[:, None] << 1 | j) << 9 | half)
    return np.concatenate(out), np.concatenate(owner)


def _mixed(hashes, k: int):
    """The k-th set of hashes of the same shingles: the hashes themselves, then ones mixed from them."""
    import numpy as np

    if not k:
        return hashes
    h = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


@cache
def _spread():
    """For each byte, its eight bits in the eight bytes of a word: sums of up to 255 such words hold eight counts each."""
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _majorities(hashes, starts, rounds: int):
    """(texts, rounds) fingerprints of texts whose hashes begin at ``starts`` (ascending; no text is without a hash)."""
    import numpy as np

    sizes = np.diff(np.append(starts, len(hashes)))
    runs = -(-sizes // 255)  # a text is added up in runs of at most 255 hashes
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * 255
    powers, spread = np.uint64(1) << np.arange(64, dtype=np.uint64), _spread()
    out = np.empty((len(starts), rounds), np.uint64)
    for k in range(rounds):
        own = np.ascontiguousarray(_mixed(hashes, k)).view(np.uint8).reshape(-1, 8)
        counts = np.stack([np.add.reduceat(spread[own[:, i]], at) for i in range(8)], axis=1)
        sums = np.add.reduceat(counts.view(np.uint8), first, axis=0, dtype=np.int64)
        out[:, k] = ((2 * sums > sizes[:, None]) * powers).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_texts(texts: list[str | None], shingle: int = SHINGLE, rounds: int = 1):
    """(texts, rounds) fingerprints (unsigned) of whole texts: the majority of each bit over all shingles, repeats included.

    The first is of the shingles' hashes, the others of hashes mixed from these."""
    import numpy as np
    import xxhash

    out = np.zeros((len(texts), rounds), np.uint64)
    hashes, starts, owners = array("Q"), [], []
    digest = xxhash.xxh64_intdigest

    def flush():
        if owners:
            out[owners] = _majorities(np.frombuffer(hashes, np.uint64), np.array(starts), rounds)

    for i, text in enumerate(texts):
        words = (text or "").encode().translate(_LOWER).split()  # bytes.split cuts at blanks and 09-0D
        if not words:
            continue
        starts.append(len(hashes))
        owners.append(i)
        n = len(words)
        if n < shingle:
            hashes.append(digest(b" ".join(words), SEED))
        else:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            begins = [0, *(ends[: n - shingle] + 1).tolist()]
            hashes.extend([digest(whole[x:y], SEED) for x, y in zip(begins, ends[shingle - 1 :].tolist(), strict=True)])
        if len(hashes) >= 1 << 17:
            flush()
            hashes, starts, owners = array("Q"), [], []
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, rounds: int = 1) -> DataFrame:
    """(doc_id, row, fp, fp1, ...) of ``docs`` (doc_id, text): row is a hash of the text, the others its fingerprints as signed longs."""
    names = ["doc_id", "row", "fp", *(f"fp{k}" for k in range(1, rounds))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            fp = fingerprint_texts(batch.column(2).to_pylist(), shingle, rounds)
            columns = (pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(rounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _forest(words, bits: int):
    """Edges of a spanning forest of the graph that links distinct words at up to ``bits`` bits, found by breadth; of 64
    words of the front the nearest one takes a new word."""
    import numpy as np

    left, out = words, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            apart = np.bitwise_count(block[:, None] ^ left[None, :])
            hit = apart.min(axis=0) <= bits
            if hit.any():
                out.append(np.stack([block[apart[:, hit].argmin(axis=0)], left[hit]]))
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)


def _searched(bits: int, bucket: int):
    """Rows (key, fp) ordered by both, of one task: verified links of each bucket, enough to connect what it links, with
    their round in place of a cut.

    A bucket of more than ``bucket`` rows comes out as its rows, numbered by cuts, with b null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def edges(found):
            pairs = np.ascontiguousarray(np.unique(np.concatenate(found, axis=1), axis=1))
            ends = (pa.array(x.view(np.int64)) for x in pairs[1:])
            return pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0].astype(np.int32)), *ends], ["key", "cut", "a", "b"])

        def put(found, key, a, b):
            found.append(np.stack([np.broadcast_to(key, a.shape).view(np.uint64) >> np.uint64(ROUND_AT), a, b]))

        def small(k, f, found):
            """Buckets that are whole in k and f."""
            cuts = np.flatnonzero(np.diff(k, prepend=k[:1] - 1))
            sizes = np.diff(np.append(cuts, len(k)))
            few = np.repeat(sizes <= 6, sizes)
            fk, ff = k[few], f[few]
            for d in range(1, 6):
                near = (fk[d:] == fk[:-d]) & (np.bitwise_count(ff[d:] ^ ff[:-d]) <= bits)
                if near.any():
                    put(found, fk[d:][near], ff[:-d][near], ff[d:][near])
            for at, n in zip(cuts[sizes > 6].tolist(), sizes[sizes > 6].tolist(), strict=True):
                put(found, k[at : at + 1], *_forest(f[at : at + n], bits))

        held_k, held_f, found, large, number = np.zeros(0, np.int64), np.zeros(0, np.uint64), [], None, 0
        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy()])
            f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
            if large is not None:  # the rest of a large bucket
                n = int(np.searchsorted(k, large, side="right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(k[:n]), pa.array(((number + np.arange(n)) // bucket).astype(np.int32)), pa.array(f[:n].view(np.int64)), pa.nulls(n, pa.int64())], ["key", "cut", "a", "b"])
                    number += n
                k, f = k[n:], f[n:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                large = None
            last = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
            small(k[:last], f[:last], found)
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > bucket:
                large, number, n = int(held_k[0]), 0, len(held_k)
                yield pa.RecordBatch.from_arrays([pa.array(held_k), pa.array((np.arange(n) // bucket).astype(np.int32)), pa.array(held_f.view(np.int64)), pa.nulls(n, pa.int64())], ["key", "cut", "a", "b"])
                number, held_k, held_f = n, held_k[:0], held_f[:0]
            if sum(x.shape[1] for x in found) > 500_000:
                yield edges(found)
                found = []
        small(held_k, held_f, found)
        if found:
            yield edges(found)

    return run


def _nearest(batches):
    """Links (round, a, b) of one slice: a spanning forest for each round, nearest pairs first."""
    import numpy as np
    import pyarrow as pa

    parts = [[c.to_numpy() for c in b.columns] for b in batches]
    if not parts:
        return
    every = [np.concatenate(c) for c in zip(*parts, strict=True)]
    for r in np.unique(every[0]):
        a, b = (c[every[0] == r] for c in every[1:])
        order = np.argsort(np.bitwise_count((a ^ b).view(np.uint64)), kind="stable")
        a, b = a[order], b[order]
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        kept = forest(place[: len(a)], place[len(a) :], len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), r, np.int32)), pa.array(a[kept]), pa.array(b[kept])], ["round", "a", "b"])


def links(words: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Verified links (round, a, b) between the distinct ``words`` (round, fp) of each round (0 to 7), enough to connect all
    that differ in at most ``bits`` bits.

    Up to four bits no link is missed. With more, every link that is found is verified, but those of more than four bits
    are found only where a key agrees; ``similar_links`` makes up for that by several fingerprints.

    A bucket gives a spanning forest of its links, so the rows are linear in the fingerprints even in
    a large group of near copies; every link of at most four bits lies in some bucket. What the buckets
    give is thinned once more in slices of about ``LINKS``: of each a spanning forest stays, nearest pairs first.
    """

    def expand(batches):
        import numpy as np
        import pyarrow as pa

        forget_encoders()
        for batch in batches:
            k, f = batch.column(0).to_numpy().astype(np.int64) << ROUND_AT, batch.column(1).to_numpy()
            for at in range(0, len(f), 1024):
                part, rounds = f[at : at + 1024], k[at : at + 1024]
                key, owner = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key | rounds[owner]), pa.array(part[owner])], ["key", "fp"])

    n = partitions(words.sparkSession)
    keyed = words.select(F.col("round").cast("int"), "fp").mapInArrow(expand, "key long, fp long")
    schema = "key long, cut int, a long, b long"
    met = stored(keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_searched(bits, bucket), schema), "links")
    link = ("cut as round", "a", "b")
    found = met.where("b is not null").selectExpr(*link)
    thinned = lambda df, n: df.coalesce(max(1, -(-n // LINKS))).mapInArrow(_nearest, "round int, a long, b long").distinct()
    # large buckets: every pair of cuts meets in a task of its own
    cut = met.where("b is null").select("key", "cut", F.col("a").alias("fp"))
    if not cut.head(1):
        return thinned(found, found.count())
    count = cut.groupBy("key").agg((F.max("cut") + 1).alias("cuts"))
    pairs = cut.join(count, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    mixed = F.xxhash64("key", F.least("cut", "other"), F.greatest("cut", "other"))
    low = F.lit((1 << ROUND_AT) - 1).cast("long")
    mixed = mixed.bitwiseAND(low).bitwiseOR(F.col("key").bitwiseAND(F.bitwise_not(low)))  # the round stays
    pairs = pairs.where("other <> cut or cuts = 1").select(mixed.alias("key"), "fp")
    rest = pairs.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_searched(bits, 1 << 62), schema)
    both = stored(found.union(rest.selectExpr(*link)), "links")
    return thinned(both, both.count())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row, fp, component_id) of ``docs`` (doc_id, text; other columns are ignored), one row for each of theirs.

    A-Z are lower-cased; words are runs other than blanks and the characters 09 to 0D; a text with
    fewer words than a shingle is one shingle, and one without words (or null) has fingerprint zero,
    which links like any other. component_id is the smallest doc_id that can be reached over links
    (null if none of them has a doc_id). Repeated rows are copies of each other; very long texts are
    hashed whole; an empty table gives no rows. ``bits`` of more than four would lose links and is refused.
    """
    if bits > BITS:
        raise ValueError(f"keys are complete up to {BITS} differing bits")
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = links(distinct.select(F.lit(0).alias("round"), "fp"), bits, bucket)
    labels = least_labels(distinct.withColumnRenamed("fp", "v"), found)
    return rows.join(labels.withColumnRenamed("v", "fp"), "fp").select("doc_id", "row", "fp", "component_id")


def similar_links(classes: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Verified links (a, b) between vertices of ``classes`` (v, fp, fp1, ...): pairs that share a key in one of the
    fingerprints and differ, over all fingerprints together, in no more bits than ``similarity`` allows."""
    names = [n for n in classes.columns if n not in ("v", "least")]
    share = acos(similarity) / pi
    words = classes.select("v", F.posexplode(F.array(*names)).alias("round", "fp"))
    first = stored(words.groupBy("round", "fp").agg(F.min("v").alias("first"), F.count("*").alias("n")), "words")
    # a key has room for the numbers 0 to 7, so rounds are numbered anew in each part
    part = lambda r: first.where(F.col("round").between(r, r + AT_ONCE - 1)).withColumn("round", F.col("round") - r)
    met = [links(part(r), int(64 * share), bucket).withColumn("round", F.col("round") + r) for r in range(0, len(names), AT_ONCE)]
    end = lambda name: first.select("round", F.col("fp").alias(name), F.col("first").alias(f"v{name}"))
    apart = reduce(DataFrame.union, met).join(end("a"), ["round", "a"]).join(end("b"), ["round", "b"]).select("va", "vb")
    same = words.join(first.where("n > 1").select("round", "fp", "first"), ["round", "fp"]).where("v <> first").select("first", "v")
    pairs = stored(apart.union(same).select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).distinct(), "candidates")
    told = lambda end: classes.select(F.col("v").alias(end), F.array(*names).alias(f"bits_{end}"))
    both = pairs.join(told("a"), "a").join(told("b"), "b")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return both.where(differ <= int(64 * len(names) * share)).select("a", "b")


def similar_documents(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, rounds: int = ROUNDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row, v, component_id) of ``docs`` (doc_id, text), one row for each of theirs: v is the class of texts with
    equal fingerprints, component_id the smallest doc_id that can be reached over links (null if none has a doc_id).

    Two texts link if the cosine of their shingle counts, as ``rounds`` fingerprints of 64 bits tell
    it, is ``similarity`` or more; texts of equal length with a Jaccard likeness of 0.8 have 0.89. A pair is found if
    its fingerprints of any round share a key. A large group gives spanning links, nearest first, of
    each bucket, not all pairs. Texts and words as in ``near_duplicates``.
    """
    rows = stored(fingerprints(docs, shingle, rounds), "fingerprints")
    names = rows.columns[2:]
    classes = stored(rows.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("v", F.monotonically_increasing_id()), "classes")
    labels = least_labels(classes.select("v", "least"), similar_links(classes, similarity, bucket))
    return rows.join(classes.join(labels, "v").select("v", "component_id", *names), names).select("doc_id", "row", "v", "component_id")


def deduplicated(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of ``similar_documents`` the one with the smallest
    doc_id stays (of those without a doc_id the one with the smallest text hash; of rows equal in both, one).

    Columns as they are, whatever their names; a null text is a text without words, and all of those are one group. An
    empty table gives an empty one.
    """
    from pyspark.sql import Window

    found = similar_documents(docs, shingle, similarity, rounds)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # a component without any doc_id is one of its own for this purpose, by class
    keep = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("v")).alias("own")).agg(F.min(first).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"))
    # the input row in a struct, so that no name can clash
    own = docs.select(F.struct(*docs.columns).alias("input"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("row"))
    kept = own.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")), "left_semi")
    w = Window.partitionBy("id", "row").orderBy(F.lit(1))
    return kept.withColumn("copy", F.row_number().over(w)).where("copy = 1").select("input.*")
