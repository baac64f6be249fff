"""Sets and links against all pairs, with long lists cut and with groups that only chains connect."""

import random
import re

import numpy as np
import pytest

from corpusmill.llm import set_join


def by_definition(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=90):
    """(doc_id, size, component) of each row, over all pairs."""
    sets = [by_definition(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, n int, v int, `LIST` string, component int")
    return sorted([tuple(r) for r in set_join.similar_sets(docs, **options).collect()], key=str)


ODD = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "ONE\ttwo"), (None, "one two"), (6, "a b c d"), (6, "a b c d"), (7, "É é é É É"), (8, "x " * 20_000), (9, "\x1c \xa0"),
       (None, "only null here at all"), (10, "one"), (11, "two one"), (12, "c d a b c d a b c"), (13, " ".join(map(str, range(20_000))))]


def test_odd_texts(spark):
    for rows in (ODD, []):
        assert found(spark, rows) == brute(rows)


def crowd(seed):
    """Groups of edited texts around the threshold, chains of small steps, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for size, length, edits in ((60, 120, 3), (80, 40, 1), (40, 300, 6), (60, 12, 1)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            own = base.copy()
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(length)] = word()
            texts.append(own)
    chain = [word() for _ in range(100)]
    for i in range(40):
        chain = [*chain[2:], word(), word()]
        texts.append(chain)
    passage = [word() for _ in range(60)]
    texts += [[*passage, *[word() for _ in range(rng.randrange(30))]] for _ in range(60)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"longest": 15}, {"percent": 70}, {"percent": 100}])
def test_groups(spark, options):
    rows = crowd(4)
    want = brute(rows, options.get("percent", 90))
    assert len({c for *_, c in want}) < len(rows)
    assert found(spark, rows, **options) == want


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        found(spark, rows, percent=0)


def test_one_order_for_all(spark, monkeypatch):
    """Links do not depend on what the order knows."""
    rows = crowd(5)
    monkeypatch.setattr(set_join, "ORDER_BITS", 1)
    assert found(spark, rows) == brute(rows)


def test_blocks_reach_what_fits():
    """The runs of a list are the pairs whose size and place leave enough, forwards and in both directions."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted({(int(k), 0, int(n), int(rng.integers(0, n // 10 + 1))) for k, n in zip(rng.integers(0, 5, 400), rng.integers(1, 60, 400), strict=True)})
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("list", "cut", "n", "place"))})
    lists = set_join._Lists(table, 90)
    for back in (False, True):
        i, j = set_join._spread(*lists.reach(np.arange(len(rows)), back=back))
        want = set()
        for a, (ka, _, na, pa_) in enumerate(rows):
            for b, (kb, _, nb, pb) in enumerate(rows):
                w = set_join.need(na, nb, 90)
                if ka == kb and (b > a or back) and min(na, nb) >= w and pa_ <= na - w and pb <= nb - w and 90 * max(na, nb) <= 100 * min(na, nb):
                    want.add((a, b))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
