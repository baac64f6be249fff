"""N-gram Jaccard join with set-relation skipping: documents whose sets of word shingles are alike, exactly.

Two sets x and y are linked if ``percent`` of their union lies in their intersection, so they share at least
need(x, y) = ceil(percent * (|x| + |y|) / (100 + percent)) shingles. All shingles are put in one order, rare ones first, and
linked sets share one of the first |x| - ceil(percent * |x| / 100) + 1 of each: these go into lists.

* Lists are sorted by size and by the shingle's place in its set: a block of one size is skipped whole, or
  searched up to the last place that leaves enough shingles behind it.
* Answers come from answers. Each set is first compared with one leader of each list, the first that
  its size and place allow. Sets that are near to one leader l meet there once more with what each of them lacks of l and has
  besides it: |y & z| = |l| - |(l - y) | (l - z)| + |(y - l) & (z - l)|, so their links follow from these differences alone. For other
  sets, what y and z share with l bounds what they share: at least |y & l| + |z & l| - |l|, at most
  min(|y & l|, |z & l|) + min(|y - l|, |z - l|). Sets that are connected already are not compared, and of the rest only those that all this leaves open.
* A comparison adds up the smaller counts of both sets in each of ``CELLS`` cells of the hash space; if even these are far too few, the
  sets are not linked, else they are intersected.

Shingles are 64-bit hashes. Sets are told apart by 128 bits, equal ones are one class, so copies cost nothing
after the first scan. The order needs no exact counts: it is by the number of shingles whose hash begins with the same
``ORDER_BITS`` bits over the whole corpus, a table of fixed size; any order gives the same links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bucketed, forget_encoders, partitions, stored
from corpusmill.llm.components import components, least_labels

SHINGLE, PERCENT, SEED = 3, 90, 42
ORDER_BITS, CELLS = 20, 512
#: Sets that a task compares at a time: a longer list is cut by a hash of the set. So many elements of differences from a leader likewise.
LIST, DIFFERENCES = 10_000, 1 << 20
#: A set is near to a leader at this share of the asked percentage.
NEAR = 0.8
#: Bits that tell which documents a list has; 262,144 numbers at most.
MARKS = 1 << 24
#: Pairs that a task looks at in one step, and rows whose blocks it searches in one.
STEP, ROWS = 1 << 19, 2000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()


def _mixed(h):
    import numpy as np

    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def shingle_set(text: str | None, width: int = SHINGLE):
    """Sorted distinct hashes of the text's shingles: A-Z in lower case, words between blanks and the characters 09 to 0D; fewer
    words than ``width`` are one shingle, no words (or null) none."""
    import numpy as np

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = h[: len(h) - width + 1]
    for k in range(1, width):
        out = _mixed(out) + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(out + np.uint64(width)))


def need(a, b, percent: int):
    """How many elements sets of ``a`` and ``b`` elements share at least if they are linked (integers, arrays of them)."""
    return -(-percent * (a + b) // (100 + percent))


def _need(a: str, b: str, percent: int) -> Column:
    return F.expr(f"({percent}L * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def _slices(batches, rows: int = 500):
    """The batches in slices, so that what is made of their texts stays small."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def described(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """A row for each of ``docs`` (doc_id, key, text): doc_id, key, n (size of its set), s1 and s2 (what tells the set apart); and
    one for each task: how many shingles (seen) begin with which ORDER_BITS bits (bits)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        forget_encoders()
        names = ["doc_id", "key", "n", "s1", "s2", "bits", "seen"]
        seen, far = np.zeros(1 << ORDER_BITS, np.int64), np.uint64(64 - ORDER_BITS)
        for batch in _slices(batches):
            sizes, marks = [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                mark = xxhash.xxh3_128_intdigest(s.tobytes())
                marks.append((mark >> 64, mark & (1 << 64) - 1))
                np.add.at(seen, (s >> far).astype(np.int64), 1)
            marks = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(marks[:, 0]), pa.array(marks[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sizes), pa.list_(pa.int32())), pa.nulls(len(sizes), pa.list_(pa.int64()))], names)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        some = np.flatnonzero(seen)
        told = pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([seen[some]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], *told], names)

    return docs.mapInArrow(run, "doc_id long, key long, n int, s1 long, s2 long, bits array<int>, seen array<long>")


def _prefixes(order, width: int, percent: int):
    """Texts of a task: (list, at, s1) of the first shingles of each set, rare ones first, once for equal sets; at is the set's size
    times 2 ** 32 plus the place."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        known, held, far = set(), [], np.uint64(64 - ORDER_BITS)

        def out():
            each = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in each], ["list", "at", "s1"])

        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, width)
                mark = xxhash.xxh3_128_intdigest(s.tobytes())
                if not len(s) or mark in known:
                    continue
                if len(known) > 500_000:
                    known.clear()  # equal sets are told apart again where lists are sorted
                known.add(mark)
                size = len(s)
                first = size + percent * size // -100 + 1
                common = order[(s >> far).astype(np.int64)]
                if first < len(s):  # only those that can be among the first are sorted
                    low = common <= np.partition(common, first - 1)[first - 1]
                    s, common = s[low], common[low]
                own = s[np.lexsort((s, common))[:first]]
                s1 = np.full(first, mark >> 64, np.uint64).view(np.int64)
                held.append((own.view(np.int64), (size << 32) + np.arange(first), s1))
            if held:
                yield out()

    return run


def _whole_lists(batches, keys: int):
    """Batches sorted by their first ``keys`` columns as lists of numpy arrays (other columns stay Arrow), cut between lists."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        now = [table.column(i).to_numpy() for i in range(keys)]
        last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in now]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None and len(held):
        yield held


class _Lists:
    """Whole lists sorted by (list, cut, n, place): blocks of one size in each, and what each entry can reach."""

    def __init__(self, table, percent: int):
        import numpy as np

        self.list, self.cut, self.n, self.place = (table.column(c).to_numpy().astype(np.int64) for c in ("list", "cut", "n", "place"))
        self.percent, rows = percent, len(self.n)
        new = np.ones(rows, bool)
        new[1:] = (self.list[1:] != self.list[:-1]) | (self.cut[1:] != self.cut[:-1])
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], rows)
        self.of = np.cumsum(new) - 1
        block = new.copy()
        block[1:] |= self.n[1:] != self.n[:-1]
        self.first = np.flatnonzero(block)  # of each block
        self.size, self.owner = self.n[self.first], self.of[self.first]
        self.block = np.cumsum(block) - 1
        self.key = (self.block << 32) + self.place
        self.names = (self.owner << 32) + self.size

    def reach(self, rows, back: bool = False):
        """For each of the ``rows``, its runs [low, high) of later entries of its list (``back``: of all) whose size and place leave
        enough in common: (row, low, high) with one entry for each block that is not skipped."""
        import numpy as np

        n, p = self.n[rows], self.percent
        low = np.searchsorted(self.names, (self.of[rows] << 32) + -(-p * n // 100)) if back else self.block[rows]
        high = np.searchsorted(self.names, (self.of[rows] << 32) + 100 * n // p, "right")
        times = high - low
        row = np.repeat(rows, times)
        block = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        wanted = need(self.n[row], self.size[block], p)
        fits = (self.place[row] <= self.n[row] - wanted) & (self.size[block] >= wanted)
        row, block, wanted = row[fits], block[fits], wanted[fits]
        end = np.searchsorted(self.key, (block << 32) + self.size[block] - wanted, "right")
        begin = self.first[block] if back else np.maximum(self.first[block], row + 1)
        some = end > begin
        return row[some], begin[some], end[some]


def _spread(row, begin, end):
    """Every (row, entry) of the runs."""
    import numpy as np

    n = end - begin
    return np.repeat(row, n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def _met(percent: int):
    """Rows (list, cut, n, place, s1) sorted by all: those that can be linked with another one of their list and cut, equal sets once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_lists(batches, 2):
            every = [table.column(i).to_numpy() for i in range(5)]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in every])
            table = table.filter(pa.array(np.append(True, ~same)))
            lists = _Lists(table, percent)
            open_, marks = np.zeros(len(table) + 1, np.int64), np.zeros(len(table), bool)
            for at in range(0, len(table), ROWS):
                row, begin, end = lists.reach(np.arange(at, min(at + ROWS, len(table))))
                np.add.at(open_, begin, 1)
                np.add.at(open_, end, -1)
                marks[row] = True
            marks |= np.cumsum(open_)[:-1] > 0
            whole = table.column("cuts").to_numpy() > 1  # the others of a cut list are elsewhere
            yield from table.filter(pa.array(marks | whole)).to_batches()

    return run


def _led(percent: int):
    """Rows (list, cut, n, place, v, component) sorted by the first four and v: each v with the first earlier one of its list and cut
    that it can be linked with and is not connected to."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_lists(batches, 2):
            lists, out = _Lists(table, percent), []
            v, component = (table.column(c).to_numpy() for c in ("v", "component"))
            sizes = lists.ends - lists.starts
            small = np.flatnonzero(np.repeat(sizes <= 64, sizes))
            i, j = _spread(*lists.reach(small))
            apart = component[i] != component[j]
            j, at = np.unique(j[apart], return_index=True)  # rows ascend, so the first is the smallest
            out.append((i[apart][at], j))
            for start, end in zip(lists.starts[sizes > 64].tolist(), lists.ends[sizes > 64].tolist(), strict=True):
                left = np.ones(end - start, bool)
                for i in range(start, end):
                    if not left[i - start + 1 :].any():
                        break
                    _, j = _spread(*lists.reach(np.array([i])))
                    j = j[left[j - start] & (component[j] != component[i])]
                    if len(j):
                        left[j - start] = False
                        out.append((np.full(len(j), i), j))
            i, j = (np.concatenate(x) for x in zip(*out, strict=True))
            pairs = np.unique(np.stack([v[i], v[j]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _steps(rows, begin, end, weight=1):
    """The runs in slices of about ``STEP`` entries, each counted ``weight`` times."""
    import numpy as np

    sums, first = np.cumsum((end - begin) * weight), 0
    while first < len(rows):
        to = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + STEP, "right")))
        yield rows[first:to], begin[first:to], end[first:to]
        first = to


def _lists_of(column):
    """(owner, flat values) of a list column; nulls are empty."""
    import numpy as np
    import pyarrow.compute as pc

    array = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(array)), sizes), array.flatten()


def _left_open(percent: int):
    """Rows (list, cut, n, place, v, component, home, main, answers) sorted by the first four and v: all pairs of a list that can be
    linked, are not connected, are not near to one leader, and are not decided by what both share with one. linked tells
    those that are linked for certain."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_lists(batches, 2):
            lists, found = _Lists(table, percent), []
            v, component, main, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("v", "component", "main", "home"))
            owner, told = _lists_of(table.column("answers"))
            leader, size, low, high, near = (told.field(c).to_numpy(zero_copy_only=False) for c in ("leader", "size", "low", "high", "near"))
            names, rank = np.unique(leader, return_inverse=True)
            code = owner * max(1, len(names)) + rank
            order = np.argsort(code, kind="stable")
            code, size, low, high, near = code[order], size[order], low[order], high[order], near[order]
            starts = np.searchsorted(owner, np.arange(len(v) + 1))
            rank = code - np.repeat(np.arange(len(v)), np.diff(starts)) * max(1, len(names))
            asking = np.flatnonzero(component != main)
            runs = (lists.reach(asking[at : at + ROWS], back=True) for at in range(0, len(asking), ROWS))
            for part in (x for r in runs for x in _steps(*r, weight=1 + starts[r[0] + 1] - starts[r[0]])):
                i, j = _spread(*part)
                on = home[j] & (component[i] != component[j])
                i, j = i[on], j[on]
                least, most = np.zeros(len(i), np.int64), np.minimum(lists.n[i], lists.n[j])
                # every answer of i, where j has one of the same leader
                pair, mine = _spread(np.arange(len(i)), starts[i], starts[i + 1])
                if len(code):
                    theirs = np.minimum(np.searchsorted(code, j[pair] * len(names) + rank[mine]), len(code) - 1)
                    both = code[theirs] == j[pair] * len(names) + rank[mine]
                    pair, mine, theirs = pair[both], mine[both], theirs[both]
                    np.maximum.at(least, pair, low[mine] + low[theirs] - size[mine])
                    np.minimum.at(most, pair, np.minimum(high[mine], high[theirs]) + np.minimum(lists.n[i[pair]] - low[mine], lists.n[j[pair]] - low[theirs]))
                    most[pair[near[mine] & near[theirs]]] = -1  # their differences tell
                wanted = need(lists.n[i], lists.n[j], percent)
                keep = most >= wanted
                i, j, sure = v[i[keep]], v[j[keep]], (least >= wanted)[keep]
                found.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j), sure]), axis=1))
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2] > 0)], ["a", "b", "linked"])

    return run


def _around(percent: int):
    """Rows (leader, cut, v, n, size, component, main, home, missing, added) sorted by the first three, of sets near to a leader of ``size``
    elements: links (a, b) between different components, one for each set and component that it is linked with there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def places(column):
            """For each value its members, as runs of one array; and the values' numbers of each member, as runs of another."""
            owner, flat = _lists_of(column)
            names, number = np.unique(flat.to_numpy(), return_inverse=True)
            order = np.argsort(number, kind="stable")
            return owner[order], np.searchsorted(number[order], np.arange(len(names) + 1)), number, owner

        for table in _whole_lists(batches, 2):
            every = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "cut", "v", "n", "size", "component", "main", "home")}
            new = np.append(True, (every["leader"][1:] != every["leader"][:-1]) | (every["cut"][1:] != every["cut"][:-1]))
            starts, out = np.flatnonzero(new), []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True):
                v, n, size, component, main, home = (every[c][start:end] for c in ("v", "n", "size", "component", "main", "home"))
                if (component == main).all():
                    continue
                parts = [places(table.column(c).slice(start, end - start)) for c in ("missing", "added")]
                sizes = [np.bincount(owner, minlength=len(v)) for *_, owner in parts]
                first = [np.searchsorted(owner, np.arange(len(v) + 1)) for *_, owner in parts]
                for i in np.flatnonzero(component != main).tolist():
                    shared = []
                    for (members, runs, number, _), at in zip(parts, first, strict=True):
                        mine = number[at[i] : at[i + 1]]
                        _, places_ = _spread(mine, runs[mine], runs[mine + 1])
                        shared.append(np.bincount(members[places_], minlength=len(v)))
                    common = size - (sizes[0][i] + sizes[0] - shared[0]) + shared[1]
                    linked = np.flatnonzero(home & (component != component[i]) & (common >= need(n[i], n, percent)))
                    _, one = np.unique(component[linked], return_index=True)
                    out.append(np.stack([np.full(len(one), v[i]), v[linked[one]]]))
            if out:
                pairs = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def cells(elements) -> bytes:
    """How many elements of a set lie in each of the cells, a byte for each; 255 is 255 or more."""
    import numpy as np

    return np.minimum(np.bincount((elements % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _compared(batches):
    """``most`` beside what tells the pair: the sum of the smaller counts of all cells, beyond any size where both counts are cut off."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("a_cells", "b_cells"))
        most = np.minimum(x, y)
        full = (most == 255).any(axis=1)
        most = most.sum(axis=1, dtype=np.int64)
        most[full] = 1 << 40
        names = ["a", "b", "a_n", "b_n", "a_key", "b_key", "a_id", "b_id"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(most)], [*names, "most"])


class _Join:
    """The classes of a corpus, their lists and their sets."""

    def __init__(self, docs: DataFrame, width: int, percent: int, longest: int):
        self.percent, self.longest = percent, longest
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
        self.at = ["key", "id"]  # where the text of a class is found
        self.n = partitions(docs.sparkSession)
        told = stored(described(rows, width), "sets")
        self.rows = told.where("seen is null").drop("bits", "seen")
        chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")  # a row that stands for its class
        one = self.rows.where("n > 0").groupBy("s1", "s2", "n").agg(chosen)
        one = one.select("s1", "s2", "n", F.col("one.doc_id").alias("least"), F.col("one.key").alias("key"), F.coalesce("one.doc_id", F.lit(0)).alias("id"))
        self.classes = stored(one.withColumn("v", F.monotonically_increasing_id()), "classes")
        self.lists = self._lists(rows, told, width)
        listed = self.lists.select("v").distinct().join(self.classes, "v").repartition(self.n, "v")
        self.listed = bucketed(listed, ["v"], self.n, "listed")
        self.sets = self._sets(rows, width)

    def _lists(self, rows: DataFrame, told: DataFrame, width: int) -> DataFrame:
        """(list, cuts, n, place, v): what stands in a list with another set that it could be linked with."""
        import numpy as np

        order = np.zeros(1 << ORDER_BITS, np.uint32)
        seen = told.where("seen is not null").select(F.inline(F.arrays_zip("bits", "seen"))).groupBy("bits").agg(F.sum("seen").alias("k"))
        seen = seen.select("bits", F.least("k", F.lit(2**32 - 1)).alias("k")).toArrow()  # a row for each of the ORDER_BITS bits at most
        order[seen["bits"].to_numpy()] = seen["k"].to_numpy()
        entries = stored(rows.select("text").mapInArrow(_prefixes(order, width, self.percent), "list long, at long, s1 long"), "entries")
        held = entries.groupBy("list").agg(F.count("*").alias("k")).where("k > 1")
        cuts = F.ceil(F.col("k") / self.longest).cast("int")
        n, place = F.shiftright("at", 32).cast("int").alias("n"), F.expr("cast(at & 4294967295L as int)").alias("place")
        met = entries.join(held, "list").select("list", F.pmod(F.xxhash64("s1"), cuts).cast("int").alias("cut"), n, place, "s1", cuts.alias("cuts"))
        met = met.repartition(self.n, "list", "cut").sortWithinPartitions("list", "cut", "n", "place", "s1").mapInArrow(_met(self.percent), met.schema)
        found = met.join(self.classes.select("s1", "n", "v"), ["s1", "n"]).select("list", "cuts", "n", "place", "v")
        return stored(found, "lists")

    def _sets(self, rows: DataFrame, width: int) -> DataFrame:
        """(key, id, v, cells, elements) of the listed classes, from a text of each; kept by key and id, so that no comparison moves all of them."""
        names = [*self.at, "v", "cells", "elements"]

        def run(batches):
            import numpy as np
            import pyarrow as pa
            import xxhash

            done = set()
            for batch in _slices(batches):
                out = []
                for key, id_, v, s1, s2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if v in done:  # a repeated row
                        continue
                    s = shingle_set(text, width)
                    mark = xxhash.xxh3_128_intdigest(s.tobytes())
                    if np.array([mark >> 64, mark & (1 << 64) - 1], np.uint64).view(np.int64).tolist() == [s1, s2]:  # texts with equal hashes can differ
                        done.add(v)
                        out.append((key, id_, v, cells(s), s.view(np.int64)))
                columns = zip(*out, strict=True) if out else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        # most documents stand in no list: a bit for each key of a listed class (at most MARKS bits are broadcast) spares their texts the shuffle
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
        marks = self.listed.select(slot("key").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        own = rows.withColumn("slot", slot("key"))
        met = (F.shiftright("slot", 6) == F.col("word")) & (F.expr("shiftrightunsigned(bits, cast(slot & 63 as int)) & 1") == 1)
        own = own.join(F.broadcast(marks), met, "left_semi").select("key", F.coalesce("doc_id", F.lit(0)).alias("id"), "text")
        texts = own.join(self.listed.select(*self.at, "v", "s1", "s2").hint("merge"), self.at).select(*self.at, "v", "s1", "s2", "text")
        return bucketed(texts.mapInArrow(run, "key long, id long, v long, cells binary, elements array<long>"), self.at, self.n, "elements")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, a_n, b_n, low, high, missing, added): how many elements the pairs (a, b) share at least and at most. Where it could be
        nearly enough, both are exact; missing and added are the differences of b from a, told of near sets."""
        told = lambda x: self.listed.select(F.col("v").alias(x), *[F.col(c).cast("long").alias(f"{x}_{c}") for c in ("n", *self.at)])
        held = lambda x, what: self.sets.select(*[F.col(c).alias(f"{x}_{c}") for c in (*self.at, "v", what)])
        # as differences, or v would be a third key of the joins and the buckets would not serve
        ends = lambda df, what: df.join(held("a", what), ["a_key", "a_id"]).join(held("b", what), ["b_key", "b_id"]).where("a_v - a = 0 and b_v - b = 0")
        met = ends(pairs.join(told("a"), "a").join(told("b"), "b"), "cells")
        first = stored(met.mapInArrow(_compared, "a long, b long, a_n long, b_n long, a_key long, b_key long, a_id long, b_id long, most long"), "compared")
        near = _need("a_n", "b_n", int(NEAR * self.percent))
        kinds = {"low": F.lit(0).cast("long"), "high": F.col("most"), "missing": F.lit(None).cast("array<long>"), "added": F.lit(None).cast("array<long>")}
        few = first.where(F.col("most") < near).withColumns(kinds).drop("most")
        both = ends(first.where(F.col("most") >= near), "elements")
        missing = F.array_except("a_elements", "b_elements")
        exact = both.select("a", "b", "a_n", "b_n", missing.alias("missing"), F.array_except("b_elements", "a_elements").alias("added"))
        exact = exact.withColumn("low", F.col("a_n") - F.size("missing")).withColumn("high", F.col("low"))
        told_of = lambda c: F.when(F.col("low") >= near, F.col(c)).alias(c)
        exact = exact.select("a", "b", "a_n", "b_n", "low", "high", told_of("missing"), told_of("added"))
        return stored(few.select(*exact.columns).unionByName(exact), "answers")

    def linked(self, answers: DataFrame) -> DataFrame:
        return answers.where(F.col("low") >= _need("a_n", "b_n", self.percent)).select("a", "b")

    def labelled(self, rows: DataFrame, edges: DataFrame | None) -> DataFrame:
        """``rows`` with the component of each v over ``edges``."""
        if edges is None:
            return rows.withColumn("component", F.col("v"))
        roots = components(edges).withColumnRenamed("root", "component")
        return stored(rows.join(roots, "v", "left").withColumn("component", F.coalesce("component", "v")), "labelled")

    def lead(self, lists: DataFrame, edges: DataFrame | None, turn: int) -> DataFrame:
        """Pairs (a, b) of a set and its leader in a list; long lists are cut anew each turn."""
        rows = self.labelled(lists, edges).withColumn("cut", F.pmod(F.xxhash64("v", F.lit(turn)), F.col("cuts")).cast("int"))
        rows = rows.select("list", "cut", "n", "place", "v", "component").repartition(self.n, "list", "cut")
        return rows.sortWithinPartitions("list", "cut", "n", "place", "v").mapInArrow(_led(self.percent), "a long, b long").distinct()

    def spread(self, rows: DataFrame, by: str) -> DataFrame:
        """``rows`` (with ``by``, v, component, cuts) of those groups that are not connected, with main, cut and home: what lies in
        a group's largest component is in one cut of it, all else in every cut, and at home in one."""
        sizes = rows.groupBy(by, "component").agg(F.count("*").alias("k"))
        main = sizes.groupBy(by).agg(F.count("*").alias("several"), F.max(F.struct("k", "component"))["component"].alias("main")).where("several > 1")
        place = F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int")
        cuts = F.when(F.col("component") == F.col("main"), F.array(place)).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
        return rows.join(main.drop("several"), by).withColumn("cut", F.explode(cuts)).withColumn("home", F.col("cut") == place)

    def around(self, edges: DataFrame, answers: DataFrame) -> DataFrame:
        """Links (a, b) between sets that are near to one leader."""
        near = answers.where("missing is not null")
        none = F.array().cast("array<long>")
        own = near.select(F.col("a").alias("leader"), F.col("a").alias("v"), F.col("a_n").alias("n"), F.col("a_n").alias("size"), none.alias("missing"), none.alias("added")).distinct()
        every = near.select(F.col("a").alias("leader"), F.col("b").alias("v"), F.col("b_n").alias("n"), F.col("a_n").alias("size"), "missing", "added").unionByName(own)
        rows = every.select("leader", "v", (F.size("missing") + F.size("added")).alias("volume"))  # differences come in when it is known where they are needed
        volume = F.greatest(F.count("*") / self.longest, F.sum("volume") / DIFFERENCES)
        cuts = rows.groupBy("leader").agg(F.greatest(F.lit(1), F.ceil(volume)).cast("int").alias("cuts"))
        rows = self.spread(self.labelled(rows.join(cuts, "leader"), edges), "leader").select("leader", "cut", "v", "component", "main", "home").join(every, ["leader", "v"])
        rows = rows.select("leader", "cut", "v", "n", "size", "component", "main", "home", "missing", "added").repartition(self.n, "leader", "cut")
        return stored(rows.sortWithinPartitions("leader", "cut", "v").mapInArrow(_around(self.percent), "a long, b long").distinct(), "around")

    def rest(self, edges: DataFrame, answers: DataFrame) -> DataFrame:
        """(a, b, linked): all pairs that nothing has decided."""
        near = F.col("missing").isNotNull().alias("near")
        own = answers.select(F.col("a").alias("v"), F.col("a").alias("leader"), F.col("a_n").alias("size"), F.col("a_n").alias("low"), F.col("a_n").alias("high"), F.lit(True).alias("near")).distinct()
        known = answers.select(F.col("b").alias("v"), F.col("a").alias("leader"), F.col("a_n").alias("size"), "low", "high", near).unionByName(own)
        known = known.groupBy("v").agg(F.collect_list(F.struct("leader", "size", "low", "high", "near")).alias("answers"))
        rows = self.spread(self.labelled(self.lists, edges), "list").join(known, "v", "left")
        rows = rows.select("list", "cut", "n", "place", "v", "component", "main", "home", "answers").repartition(self.n, "list", "cut")
        found = rows.sortWithinPartitions("list", "cut", "n", "place", "v").mapInArrow(_left_open(self.percent), "a long, b long, linked boolean")
        return stored(found.groupBy("a", "b").agg(F.max("linked").alias("linked")), "rest")


def similar_sets(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, longest: int = LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text; other columns are ignored), one row for each of theirs.

    Two documents link if 100 times the shingles that both have is at least ``percent`` times those that either has; no
    link is missed. component_id is the smallest doc_id that can be reached, its own included (null if none of
    them has one). A text with fewer words than ``width`` is one shingle; an empty or null text or one without words links
    with nothing. Repeated rows are copies of each other, texts are read whole, an empty table gives no rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0 and at most 100")
    join = _Join(docs, width, percent, longest)
    answers = join.compare(join.lead(join.lists, None, 0))
    edges = join.linked(answers)
    cut = join.lists.where("cuts > 1")
    if cut.head(1):  # leaders of other cuts connect what leaders of the first have led
        answers = answers.unionByName(join.compare(join.lead(cut, edges, 1)))
        edges = join.linked(answers)
    edges = edges.unionByName(join.around(edges, answers))
    rest = join.rest(edges, answers)
    edges = edges.unionByName(rest.where("linked").select("a", "b")).unionByName(join.linked(join.compare(rest.where("not linked").select("a", "b"))))
    labels = least_labels(join.classes.select("v", "least"), edges)
    labels = join.classes.select("v", "s1", "s2", "n").join(labels, "v").select("s1", "s2", "n", "component_id")
    full = join.rows.where("n > 0").select("doc_id", "s1", "s2", "n").join(labels, ["s1", "s2", "n"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.unionByName(join.rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
