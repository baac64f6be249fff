"""Language ID: gradients by differences, held-out accuracy, odd rows."""

import zlib

import numpy as np

from corpusmill.llm import language_id as L


def test_gradients():
    rng = np.random.default_rng(1)
    data, want = rng.integers(0, 256, (5, 3), dtype=np.uint8), np.array([0, 1, 2])
    m = L.new_model(["a", "b", "c"], 4)

    def loss():
        p = L.probabilities(m, data)
        return -np.log(p[:, want, np.arange(3)].astype(float)).mean()

    f, tf = L._unit(m.x[0], m.u[0], data, True)
    b, tb = L._unit(m.x[1], m.u[1], data[::-1], True)
    p = L.probabilities(m, data)
    p[:, want, np.arange(3)] -= 1
    p /= data.size
    dx0, du0 = L._back(m.x[0], m.u[0], data, tf, np.matmul(m.out[0].T, p))
    dx1, du1 = L._back(m.x[1], m.u[1], data[::-1], tb, np.matmul(m.out[1].T, p)[::-1])
    for w, d in ((m.x[0], dx0), (m.u[0], du0), (m.x[1], dx1), (m.u[1], du1)):
        for at in [np.unravel_index(np.abs(d).argmax(), d.shape), *[tuple(rng.integers(0, s) for s in d.shape) for _ in range(5)]]:
            old, eps = w[at], 1e-2
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * eps) - d[at]) < 2e-3


def test_pooling_is_by_position():
    m = L.new_model(["a", "b"], 4)
    texts = [b"", b"x" * 130, "äöü".encode(), bytes(range(1, 65))]
    got = L.pooled(m, texts, batch=2)
    for t, p in zip(texts, got, strict=True):
        if not t:
            assert (p == 0).all()
            continue
        each = []
        for i in range(0, len(t), L.STEPS):
            w = np.zeros((L.STEPS, 1), np.uint8)
            part = np.frombuffer(t[i : i + L.STEPS], np.uint8)
            w[: len(part), 0] = part
            each.append(L.probabilities(m, w)[: len(part), :, 0])
        assert np.allclose(np.concatenate(each).mean(axis=0), p, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, per_language=80, epochs=5)
    got = L.predict(docs, model).select("doc_id", "lang", "lang_pred", "score", L.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.h and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat " * 20, "en", 1), (2, "el gato está en la casa " * 20, "es", 1), (3, None, "en", 1), (4, "", None, 1), (5, "123 -- !", "xx", 1), (None, "the dog", None, 1), (7, "the dog " * 50_000, None, 1), (7, "the dog " * 50_000, None, 1), (8, "ñ", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = L.fit(docs, epochs=2)
    assert model.languages == sorted({r[2] for r in rows[:2] if zlib.crc32(str(r[0]).encode()) % 5})
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {3, 4, 5} and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = L.identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 7, 8}
    assert L.fit(docs.where("false")) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}


def test_sample_with_repeated_ids(spark):
    """A language whose texts share one id, and one whose text is repeated, are learned like any other."""
    for doc_id in (7, 8, 11, 13):
        rows = [(doc_id, f"der Hund Nummer {i} und die Katze", "de") for i in range(3000)] + [(doc_id, "the same text", "en")] * 3000
        found = L.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert sum(lang == "de" for lang, _ in found) == 300 and sum(lang == "en" for lang, _ in found) == 1
