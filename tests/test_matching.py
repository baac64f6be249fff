"""Substrings and names against plain comparison of every pair."""

import random

from corpusmill.operators import matching


def test_occurrences(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé 😀") for _ in range(rng.randrange(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(200)))) for i in range(60)] + [(60, None), (61, ""), (62, "abc"), (63, "abababab" * 400), (None, "abcé"), (64, "x" * 3000 + "the needle is here" + "y" * 3000)]
    phrases = [(i, t[rng.randrange(len(t)) :][: rng.randrange(1, 60)]) for i, (_, t) in enumerate(texts) if t] + [(900, "a"), (901, "ab"), (902, "abababab"), (903, None), (904, ""), (905, "nowhere at all"), (906, "needle is"), (907, "a"), (908, "x" * 2500)]
    left, right = spark.createDataFrame(texts, "unit long, body string"), spark.createDataFrame(phrases, "pid long, phrase string")
    want = sorted(((p, u, i + 1) for p, s in phrases if s for u, t in texts if t for i in range(len(t)) if t.startswith(s, i)), key=str)
    for sent, block in ((500_000, 1024), (0, 7)):
        monkeypatch.setattr(matching, "GRAMS_SENT", sent)
        monkeypatch.setattr(matching, "BLOCK", block)
        if block == 7:
            left, want = left.where("length(body) < 500 and unit is not null"), [w for w in want if w[1] is not None and len(dict(texts)[w[1]]) < 500]
        got = matching.occurrences(left, right, "unit", "body", "pid", "phrase")
        assert sorted(((r.pid, r.unit, r.at) for r in got.collect()), key=str) == want
    assert matching.containing(left, right.where("false"), "unit", "body", "pid", "phrase").collect() == []


def test_named(spark):
    names = spark.createDataFrame([("trust law",), ("new trust law",), ("law",), ("Data-Protection Law",), ("a b c d e f g h i",)], "name string")
    asked = [(1, "Does the New Trust Law or the trust law apply?"), (2, "data protection law, and the law"), (3, None), (4, ""), (5, "trustlaw"), (6, "a b c d e f g h i")]
    got = matching.named(spark.createDataFrame(asked, "qid long, text string"), names, "qid", "text", "name")
    want = {(1, "new trust law", 2, 3), (1, "trust law", 7, 2), (2, "Data-Protection Law", 0, 3), (2, "law", 5, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_sent_phrases_make_no_rows_of_text(spark):
    texts = spark.createDataFrame([(1, "😀é the needle and the needle"), (2, "nothing"), (None, "needle")], "unit long, body string")
    found = matching.occurrences(texts, spark.createDataFrame([("n", "the needle"), ("x", "é")], "pid string, phrase string"), "unit", "body", "pid", "phrase")
    assert sorted((r.pid, r.unit, r.at) for r in found.collect()) == [("n", 1, 4), ("n", 1, 19), ("x", 1, 2)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_characters_beside_phrases(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a needle"), (2, "😀needleé, needle"), (3, "xneedlex" * 3), (4, None)], "unit long, body string")
    phrases = spark.createDataFrame([(1, "needle"), (2, "x")], "pid long, phrase string")
    want = {(p, u, i + 1, t[i - 1 : i] if i else "", t[i + len(s) :][:1]) for p, s in ((1, "needle"), (2, "x")) for u, t in ((1, "a needle"), (2, "😀needleé, needle"), (3, "xneedlex" * 3)) for i in range(len(t)) if t.startswith(s, i)}
    for sent in (500_000, 0):
        monkeypatch.setattr(matching, "GRAMS_SENT", sent)
        monkeypatch.setattr(matching, "BLOCK", 5)
        got = matching.occurrences(texts, phrases, "unit", "body", "pid", "phrase", beside=True)
        assert {(r.pid, r.unit, r.at, r.before, r.after) for r in got.collect()} == want
