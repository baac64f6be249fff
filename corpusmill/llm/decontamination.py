"""Benchmark decontamination: spaced-seed hashing with substitution-tolerant verification.

Words are runs of letters, digits and underscores, lower-cased. A fixed mask looks at some of the
words of a window and ignores the others, so a passage with a word changed still gives the same hash
where the change falls on an ignored place. Hashes of all masks at all places of the benchmark items
are joined to those of the documents; around each hit the item is laid along the document and
compared word by word. A document is contaminated if ``window`` consecutive words of an item (all of
a shorter item) stand in it with at most a fifth of them changed. Items of fewer than ``MIN_WORDS`` words
are found whole and unchanged. The report of all items (``find_all``) has every copy of an item.

The masks of a window follow from its length and the words that may change in it (``masks``): for
every placement of the changed words some mask at some place of the window meets none of them, so no
such overlap is missed. That is tried for all placements when the masks are made.

Benchmarks are a stated query set: they are laid against all documents in blocks of at most
``block_words`` words, so what a task is sent has a fixed bound at any size of the benchmark.
Documents are never shuffled, and words that no item of the block has are dropped at once.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

WINDOW, CHANGED, MIN_WORDS, BLOCK_WORDS = 13, 0.2, 8, 500_000
#: Items of fewer words are no evidence of a leak and remove no document, unless a caller asks for it.
LEAST_WORDS = 5
#: Windows whose masks are tried over all placements of changed words; words that a mask looks at, its length, and how many masks a window may need.
LONGEST_WINDOW, WEIGHT, SPAN, MASKS = 25, 5, 8, 3
#: Hits that are laid along a document at once.
SLICE = 2_000_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _changed(n: int, window: int) -> int:
    """How many words of an overlap may be changed: none in items of fewer than ``MIN_WORDS`` words."""
    return 0 if n < MIN_WORDS else int(CHANGED * min(n, window))


@cache
def masks(window: int, changed: int) -> tuple[str, ...]:
    """Masks that ignore a place each, one of which keeps clear of any ``changed`` words of a window: the heaviest for which ``MASKS`` suffice.

    Windows of one or two words have a mask without an ignored place, and no changes."""
    from itertools import combinations

    import numpy as np

    if not 0 < window <= LONGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LONGEST_WINDOW} words")
    if window < 3:
        return ("1" * window,)
    placements = np.array([sum(1 << p for p in places) for places in combinations(range(window), changed)], np.int64)
    for weight in range(min(WEIGHT, window - 1), 0, -1):
        spans = range(weight + 1, min(SPAN, window) + 1) if weight > 1 else (1,)
        shapes = [(0, *inner, span - 1)[: max(weight, 1)] for span in spans for inner in combinations(range(1, span - 1), max(0, weight - 2))]
        clear = {}
        for shape in shapes:
            bits, span = sum(1 << p for p in shape), shape[-1] + 1
            clear["".join("1" if p in shape else "0" for p in range(span))] = np.any([placements & bits << at == 0 for at in range(window - span + 1)], axis=0)
        found, left = [], np.ones(len(placements), bool)
        while left.any() and len(found) < MASKS:
            best = max(clear, key=lambda m: int((clear[m] & left).sum()))
            found.append(best)
            left &= ~clear[best]
        if not left.any():
            return tuple(found)
    raise ValueError(f"{changed} of {window} words may be changed: no mask keeps clear of them")


class Items:
    """A block of items, ready to be searched for in documents."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int):
        import numpy as np

        self.window = window
        self.known: dict[str, int] = {}
        self.items = [(item, np.array([self.known.setdefault(w, len(self.known) + 1) for w in found], np.int64)) for item, found in items]
        self.longest = max((len(x) for _, x in self.items), default=0)
        hashes: dict[str, list[tuple]] = {}
        for i, (_, ids) in enumerate(self.items):
            size = min(len(ids), window)
            for mask in masks(size, _changed(len(ids), window)):
                h = self._hash(mask, ids, np.arange(len(ids) - len(mask) + 1))
                hashes.setdefault(mask, []).append((h, np.full(len(h), i), np.arange(len(h))))
        self.seeds = {}
        for mask, found in hashes.items():
            h, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            table = np.zeros(1 << max(16, int(16 * len(h)).bit_length()), bool)
            table[(h & np.uint64(len(table) - 1)).astype(np.int64)] = True
            self.seeds[mask] = h, item, at, table

    @staticmethod
    def _hash(mask: str, ids, at):
        import numpy as np

        h = np.zeros(len(at), np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                h = (h ^ ids[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, words of the overlap, of these unchanged), the best overlap for each pair."""
        import numpy as np

        get, gap, out = self.known.get, [-1] * self.longest, []
        ids, starts, held = [], [], []
        for i, text in enumerate(texts):
            own = [get(w, 0) for w in words(text)]
            starts.append(len(ids))
            held.append(i)
            ids += own
            ids += gap  # no window reaches from one text into the next
            if len(ids) > 400_000:
                out += self._hits(np.array(ids, np.int64), np.array(starts), held)
                ids, starts, held = [], [], []
        if held:
            out += self._hits(np.array(ids, np.int64), np.array(starts), held)
        return out

    def _hits(self, ids, starts, held):
        import numpy as np

        known, pairs = ids > 0, []
        for mask, (h, item, at, table) in self.seeds.items():
            n = len(ids) - len(mask) + 1
            if n <= 0:
                continue
            on = np.ones(n, bool)
            for i, c in enumerate(mask):
                if c == "1":
                    on &= known[i : i + n]
            place = np.flatnonzero(on)
            mine = self._hash(mask, ids, place)
            may = table[(mine & np.uint64(len(table) - 1)).astype(np.int64)]
            place, mine = place[may], mine[may]
            low, high = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            times, first = high - low, 0
            sums = np.cumsum(times)
            while first < len(times):  # repeated words hit often: a slice at a time, of which an item at a shift stays once
                end = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + SLICE, "right")))
                n, k = times[first:end], low[first:end]
                index = np.repeat(k, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.unique(np.stack([item[index], np.repeat(place[first:end], n) - at[index]]), axis=1))
                first = end
        if not pairs:
            return []
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)  # an item at a shift, once
        if not pairs.shape[1]:
            return []
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], pairs.shape[1]), strict=True):
            i = int(pairs[0, a])
            own = self.items[i][1]
            w = min(self.window, len(own))
            for c in range(a, b, 20_000):
                shift = pairs[1, c : min(b, c + 20_000)]
                at = shift[:, None] + np.arange(len(own))
                inside = (at >= 0) & (at < len(ids))
                same = (ids[np.where(inside, at, 0)] == own) & inside
                sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
                gaps = np.cumsum(np.pad(~inside | (ids[np.where(inside, at, 0)] < 0), ((0, 0), (1, 0))), axis=1)
                good = (sums[:, w:] - sums[:, :-w] >= w - _changed(len(own), self.window)) & (gaps[:, w:] == gaps[:, :-w])
                for r in np.flatnonzero(good.any(axis=1)):
                    first = int(good[r].argmax())
                    last = int(len(good[r]) - good[r][::-1].argmax()) - 1 + w
                    k = int(np.searchsorted(starts, shift[r] + first, "right")) - 1
                    text, begin = held[k], int(shift[r] + first - starts[k])
                    new = (last - first, int(sums[r, last] - sums[r, first]), -begin)
                    if (text, i) not in out or new > out[text, i]:
                        out[text, i] = new
        return [(t, self.items[i][0], -begin, n, m) for (t, i), (n, m, begin) in out.items()]


def _item_words(batches):
    import pyarrow as pa

    for batch in batches:
        found = pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["item_id", "words"])


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of all items."""
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_item_words, "item_id long, words array<string>")


def _distinct(benchmark: DataFrame, min_words: int) -> DataFrame:
    """(words, item_id) of the benchmark's distinct items, each with its smallest id; stored, as every block reads it."""
    return stored(_items(benchmark).where(F.size("words") >= min_words).groupBy("words").agg(F.min("item_id").alias("item_id")), "distinct-items")


def _blocks(items: DataFrame, block_words: int):
    """Distinct ``items`` (words, item_id) in blocks of about ``block_words`` words, collected one by one: whether there are several, and (item_id, words)."""
    blocks = max(1, -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    for b in range(blocks):
        found = items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        if found:
            yield blocks > 1, sorted(((r.item_id, list(r.words)) for r in found), key=str)


NAMES = ["doc_id", "item_id", "first_word", "n_words", "n_same"]


def _found(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """Overlaps of ``docs`` with distinct ``items`` (words, item_id). Of several blocks, each is run and released before the next is collected."""
    spark, out = docs.sparkSession, None
    schema = ", ".join(f"{n} long" for n in NAMES)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for several, block in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            import pyarrow as pa

            items = Items(sent.value, window)
            for batch in batches:
                found = items.search(batch.column(1).to_pylist())
                ids = batch.column(0).take(pa.array([r[0] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in found], pa.int64()) for k in range(1, 5))], NAMES)

        part = rows.mapInArrow(search, schema)
        if several:
            part = stored(part, "overlaps")
            sent.destroy()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def find_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, first_word (of the overlap, in the document), n_words, n_same: one row for each contaminated row of
    ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text); other columns are ignored.

    Of items with equal words the smallest item_id stands for all. Items of fewer than ``min_words``
    words, or null, match nothing: too little to tell a leak from chance (``find_all`` has them). Null texts and ids are
    fine; repeated rows of ``docs`` are reported each; of several overlaps of a pair the longest is.
    Texts are searched whole at any length; an empty table of either kind gives no rows. ``window`` is at most ``LONGEST_WINDOW``.
    """
    return _found(docs, _distinct(benchmark, min_words), window, block_words)


def find_all(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As ``find_contaminated``, for every item that has a word: those of fewer than ``MIN_WORDS`` words match whole and
    unchanged, and of items with equal words each has its own row."""
    items = stored(_items(benchmark).where(F.size("words") > 0), "items")
    distinct = stored(items.select("words").distinct().select("words", F.monotonically_increasing_id().alias("item_id")), "distinct-items")
    # narrow rows, stored so that their size is known to the join
    copies = stored(items.join(distinct.withColumnRenamed("item_id", "own").withColumnRenamed("words", "same"), F.col("words") == F.col("same")).select("own", "item_id"), "copies")
    found = _found(docs, distinct, window, block_words).withColumnRenamed("item_id", "own")
    return found.join(copies, "own").select(NAMES)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without its contaminated rows (those that ``find_contaminated`` reports), columns as they are, whatever their
    names. Nothing of the documents is shuffled; null texts stay; an empty benchmark removes nothing."""
    spark = docs.sparkSession
    for _, block in _blocks(_distinct(benchmark, min_words), block_words):
        sent, at = spark.sparkContext.broadcast(block), docs.columns.index("text")

        def clean(batches, sent=sent, at=at):
            import numpy as np
            import pyarrow as pa

            items = Items(sent.value, window)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in items.search(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
