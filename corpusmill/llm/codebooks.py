"""Vector code compression: one small codebook for each part of a vector, searched with annular norm pruning.

A vector is cut into equal parts, and each part is replaced by the number of its nearest codebook entry. The
entries of a codebook are sorted by norm. An entry at a distance of at most d from a part has a norm within d
of the part's norm, so the best distance so far, at first that to the entries next in norm, bounds an annulus, two binary
searches find it, and only the entries inside it (its borders included) are compared exactly, in integers.

Codebooks are trained by rounds over all vectors: every task adds up the parts of each entry, so a round shuffles
at most one row for each entry's component and task, however often a vector repeats. What reaches the driver is
the codebooks, whose size is a parameter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors with a component of this size or more are dropped like ones that are not finite: squared distances would leave 64 bits.
LARGEST = 2.0**19
#: Entries on either side of a part's norm that are compared first, and how many comparisons are made at a time.
FIRST, SLICE = 2, 1 << 19
#: Up to so many labels are joined by a broadcast; beyond, both sides are salted.
MANY_LABELS, SALTS = 100_000, 16


def kept_vectors(vectors: DataFrame, column: str, key: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows of ``vectors`` with a usable vector, and its number of components (0 without any row).

    Dropped are null vectors, vectors with a null or non-finite component or one of ``LARGEST``, vectors that ``parts``
    does not divide, and those of another length than the one with the smallest key.
    """
    fine = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST)))
    whole = vectors.where(F.col(column).isNotNull() & fine & (F.size(column) > 0) & (F.size(column) % parts == 0))
    first = whole.orderBy(F.col(key).asc_nulls_last(), F.size(column)).select(F.size(column)).first()
    dim = first[0] if first else 0
    return whole.where(F.size(column) == dim), dim


def integers(column, dim: int):
    """(rows, dim) of the list column: floor(256 x) of each component."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, dim)


class Codebook:
    """The entries (k, width) of one part position, sorted by norm."""

    def __init__(self, entries):
        import numpy as np

        squared = (entries * entries).sum(axis=1)
        self.order = np.argsort(squared, kind="stable")
        self.entries, self.norms = entries[self.order], np.sqrt(squared[self.order].astype(np.float64))
        self.compared = 0  # pairs so far

    def annulus(self, norm, best):
        """The runs [low, high) of entries, by norm, that a best squared distance so far allows for parts of these norms; borders count."""
        import numpy as np

        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-6 + 1e-9 * (norm + reach)  # more than the roots are rounded by
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x):
        """(entry, squared distance) of each part of ``x``; ties go to the lower entry.

        The search starts at the entries next in norm and goes outwards; every step compares twice as many on either
        side, as far as the annulus of the best distance reaches by then."""
        import numpy as np

        n = len(x)
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        codes, errors = np.full(n, len(self.order)), np.full(n, np.iinfo(np.int64).max)
        low = high = np.searchsorted(self.norms, norm)  # what is compared so far
        first, last, step = np.zeros(n, np.int64), np.full(n, len(self.norms)), FIRST
        while True:
            rows = np.flatnonzero((first < low) | (last > high))
            if not len(rows):
                return codes, errors
            below, above = np.maximum(first[rows], low[rows] - step), np.minimum(last[rows], high[rows] + step)
            for start, end in ((below, low[rows]), (high[rows], above)):
                self._compare(x, rows, start, end, codes, errors)
            low, high = low.copy(), high.copy()
            low[rows], high[rows] = np.minimum(below, low[rows]), np.maximum(above, high[rows])
            first, last = self.annulus(norm, errors)
            step *= 2

    def _compare(self, x, rows, start, end, codes, errors) -> None:
        """Compares the parts at ``rows`` with the entries [start, end) of each and keeps the better ones."""
        import numpy as np

        some = end > start
        rows, start, times = rows[some], start[some], (end - start)[some]
        sums, at = np.cumsum(times), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE, "right")))
            n, own = times[at:to], rows[at:to]
            starts = np.cumsum(n) - n
            entry = np.repeat(start[at:to] - starts, n) + np.arange(n.sum())
            d = np.repeat(x[own], n, axis=0) - self.entries[entry]
            d = (d * d).sum(axis=1)
            least = np.minimum.reduceat(d, starts)
            code = np.minimum.reduceat(np.where(d == np.repeat(least, n), self.order[entry], len(self.order)), starts)
            better = (least < errors[own]) | (least == errors[own]) & (code < codes[own])
            errors[own[better]], codes[own[better]] = least[better], code[better]
            self.compared += len(d)
            at = to


def _coded(x, books):
    """(codes, errors), each (rows, parts), of the integer vectors ``x``."""
    import numpy as np

    cut = x.reshape(len(x), len(books), -1)
    found = [Codebook(book).nearest(cut[:, p]) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def _sums(column: str, books, dim: int):
    """For one task: (slot, place, total); slot is part times entries plus entry, place -1 the number of its parts, else a component's sum."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts, entries, width = books.shape
        count, total, any_row = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_row, x = True, integers(batch.column(0), dim)
            codes, _ = _coded(x, books)
            slots = (codes + np.arange(parts) * entries).ravel()
            count += np.bincount(slots, minlength=len(count))
            np.add.at(total, slots, x.reshape(-1, width))
        if any_row:
            used = np.flatnonzero(count)
            values = np.concatenate([count[used, None], total[used]], axis=1)
            places = np.broadcast_to(np.arange(-1, width), values.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, width + 1).astype(np.int32)), pa.array(places.ravel().astype(np.int32)), pa.array(values.ravel())], ["slot", "place", "total"]
            )

    return run


def train(kept: DataFrame, column: str, key: str, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """Codebooks (parts, entries, width) of the rows from ``kept_vectors``: they start as the parts of the ``entries``
    smallest keys (rows with one key by their components; null keys last), and each round moves an entry to the
    rounded-down mean of its parts; an entry without parts stays. With fewer rows there are fewer entries."""
    import numpy as np

    first = [r[0] for r in kept.orderBy(F.col(key).asc_nulls_last(), column).limit(entries).select(column).collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.floor(SCALE * np.array(first, np.float64)).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        found = kept.select(column).mapInArrow(_sums(column, books, dim), "slot int, place int, total long")
        flat, counts = books.reshape(-1, books.shape[2]).copy(), {}
        rows = found.groupBy("slot", "place").agg(F.sum("total").alias("total")).collect()  # at most one row for each component of the codebooks
        counts = {r.slot: r.total for r in rows if r.place < 0}
        for r in rows:
            if r.place >= 0:
                flat[r.slot, r.place] = r.total // counts[r.slot]
        books = flat.reshape(books.shape)
    return books


def encode(kept: DataFrame, column: str, books, dim: int) -> DataFrame:
    """The other columns of ``kept`` with ``code`` (two hex digits for each part) and ``error`` (squared distances, summed)."""
    others = [c for c in kept.columns if c != column]
    code, error = fresh("code", others), fresh("error", others)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = _coded(integers(batch.column(0), dim), books)
            text = codes.astype("uint8").tobytes().hex()
            step = 2 * codes.shape[1]
            texts = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(errors.sum(axis=1))], [*others, code, error])

    if len(books) and books.shape[1] > 256:
        raise ValueError("two hex digits tell at most 256 entries")
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([*(kept.schema[c] for c in others)]).add(code, StringType()).add(error, LongType())
    return kept.select(column, *others).mapInArrow(run, schema)


def decode(codes: DataFrame, books, out: str = "vector", column: str = "code") -> DataFrame:
    """``codes`` with the vectors that their codes stand for: the entries of all parts, divided by 256."""
    table = F.lit([[[v / SCALE for v in entry] for entry in book] for book in books.tolist()]) if len(books) and books.shape[1] else None
    if table is None:
        return codes.withColumn(out, F.lit(None).cast("array<double>"))
    number = lambda p: F.conv(F.substring(F.col(column), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out, F.concat(*[F.get(F.get(table, F.lit(p)), number(p)) for p in range(len(books))]))


def digest(books) -> str:
    """SHA-256 (lowercase hex) of all components by part, entry and place, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_totals(coded: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``coded`` with ``out``: the sum of ``value`` over all rows with an equal ``by``, nulls being equal.

    Values are added up before they are shuffled. Few different ``by`` are broadcast (they are counted first); many are
    joined by a shuffle that deals the rows of each over ``SALTS`` tasks.
    """
    totals = stored(coded.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(out)), "totals")
    if totals.count() <= MANY_LABELS:
        return coded.join(F.broadcast(totals), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64(*coded.columns), F.lit(SALTS)).cast("int"))
    copies = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_salt") == F.col("_part")), "left").drop("_by", "_salt", "_part")


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows of ``vectors`` with a usable vector.

    Which rows are dropped is told in ``kept_vectors``. Repeated rows stay, null keys and labels too (null labels are one
    label); columns beside the three are ignored, and an empty table gives no rows.
    """
    kept, dim = kept_vectors(vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("vector")), "vector", "vec_id", parts)
    books = train(kept, "vector", "vec_id", dim, parts, entries, rounds)
    coded = stored(encode(kept, "vector", books, dim), "codes")
    return with_totals(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(digest(books)))
