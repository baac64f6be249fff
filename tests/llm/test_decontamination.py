"""Spaced seeds against a comparison at every shift."""

import random
from itertools import combinations

import pytest

from corpusmill.llm import decontamination as D


def brute(texts, items, window=13):
    found = set()
    for d, t in texts:
        doc = D.words(t)
        for i, x in items:
            own = D.words(x)
            if len(own) < 8:
                continue
            w = min(window, len(own))
            for a in range(len(own) - w + 1):
                for p in range(len(doc) - w + 1):
                    if sum(u == v for u, v in zip(own[a : a + w], doc[p : p + w])) >= w - int(0.2 * w):
                        found.add((d, i))
                        break
    return found


@pytest.mark.parametrize("n", range(1, 21))
def test_masks_lose_nothing(n):
    subs = int(0.2 * n) if n >= 8 else 0
    masks = D.masks(n, subs)
    assert n < 3 or all("0" in m or len(m) == 1 for m in masks) and all(len(m) <= n for m in masks)
    for changed in combinations(range(n), subs):
        assert any(all(c == "0" or o + i not in changed for i, c in enumerate(m)) for m in masks for o in range(n - len(m) + 1))


def test_long_window_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w " * 40)], "item_id long, text string")
    with pytest.raises(Exception, match="a window has 1 to 25 words"):
        D.find_contaminated(docs, items, window=26).collect()


def test_repeated_words(spark):
    """An item and a text of one word over and over: every word hits every word."""
    docs = spark.createDataFrame([(1, "la " * 2_000), (2, "la " * 12 + "x")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "la " * 500), (6, "q la la la la la la la la la la la la")], "item_id long, text string")
    assert rows(D.find_contaminated(docs, items)) == {(1, 5), (1, 6), (2, 5), (2, 6)}


def rows(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_planted(spark, block_words):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdé", k=3)) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate((8, 9, 10, 11, 12, 13, 14, 20, 40, 60, 3, 0))] + [(12, None), (None, text(15))]
    items += [(99, items[6][1].upper() + "!!"), (98, items[7][1])]
    docs = [(None, text(30) + " " + items[8][1]), (1000, None), (1001, ""), (1002, "... --"), (1003, "ab " * 5000)]
    for d in range(150):
        own = D.words(items[rng.randrange(10)][1])
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = "changed"
        cut = own[rng.randrange(0, 4) :]
        docs.append((d, text(rng.randrange(0, 30)) + ", " + "; ".join(cut) + ". " + text(rng.randrange(0, 30))))
    docs.append(docs[-1])
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs, [x for x in items if x[0] not in (99, 98)])
    assert len(want) > 50
    assert rows(D.find_contaminated(df, bench, block_words=block_words)) == want
    kept = D.remove_contaminated(df, bench, block_words=block_words)
    assert kept.columns == df.columns
    bad = {d for d, _ in want}
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((d or -1) for d, _ in docs if d not in bad)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 1500]
    want = brute(texts, [(r.item_id, r.text) for r in bench.collect()])
    got = {r for r in rows(D.find_contaminated(docs, bench)) if r[0] in {d for d, _ in texts}}
    assert got == want and want


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contaminated(docs, bench).collect() == []
    assert D.remove_contaminated(docs, bench).count() == 1
    assert D.remove_contaminated(docs.where("false"), bench).count() == 0


def test_nothing_met(spark):
    docs = spark.createDataFrame([(1, "none of these " * 20), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    assert D.find_contaminated(docs, bench).collect() == []
    assert D.remove_contaminated(docs, bench).count() == 2


def test_equal_words_in_any_block(spark):
    own = [f"w{i}" for i in range(10)]
    items = [(k, sep.join(own)) for k, sep in enumerate((" ", ", ", "; ", "\n", " - ", "/"))] + [(9, " ".join(f"v{i}" for i in range(30)))]
    docs = spark.createDataFrame([(1, " ".join(own))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.find_contaminated(docs, bench, block_words=5)) == {(1, 0)}


@pytest.mark.parametrize("block_words", [500_000, 6])
def test_copies_and_short_items(spark, block_words):
    own = [f"w{i}" for i in range(10)]
    items = [(0, " ".join(own)), (1, ", ".join(own)), (None, "; ".join(own)), (0, "a b c"), (2, "A-B c"), (3, "solo"), (4, "p q r s t u v"), (5, "..."), (6, None), (7, "a b"), (8, "p q r s")]
    texts = [(1, "x " + " ".join(own[:9]) + " other y"), (2, "z a b c z a"), (3, "Solo."), (4, "p q r s t u v"), (5, "p q r changed t u v"), (6, "a changed c"), (7, None), (8, "b")]
    docs = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.first_word, r.n_words, r.n_same) for r in D.find_all(docs, bench, block_words=block_words).collect()]
    want = [(1, i, 1, 10, 9) for i in (0, 1, None)] + [(2, 0, 1, 3, 3), (2, 2, 1, 3, 3), (2, 7, 1, 2, 2), (3, 3, 0, 1, 1), (4, 4, 0, 7, 7), (4, 8, 0, 4, 4)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_report_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.find_all(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_query_reports_copies(spark, tmp_path):
    from corpusmill.llm import queries

    spark.createDataFrame([(1, "z a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "a b c"), (6, "a, b, c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(queries.QUERIES["op9_decontamination"](spark, str(tmp_path))) == {(1, 5), (1, 6)}
