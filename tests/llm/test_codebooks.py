"""Codes against a plain search, over ties, equal entries, odd rows and short tables."""

import hashlib
import math

import numpy as np
import pytest

from corpusmill.llm import codebooks


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(k, v, lab) for k, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.float32(x) for x in r[1]]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = [[[math.floor(256 * float(np.float32(x))) for x in p] for p in np.array_split(np.array(v, object), parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda: [[min((apart(x, e), i) for i, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]
    for _ in range(rounds):
        codes = code()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes, strict=True) if k[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = code()
    errors = [sum(d for d, _ in k) for k in codes]
    total = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(k, lab, "".join(f"{i:02x}" for _, i in c), e, total[lab], sha) for (k, _, lab), c, e in zip(kept, codes, errors, strict=True)]


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, code int, `ERROR` string")
    return sorted(map(tuple, codebooks.compress(df).collect()), key=str)


def vectors(rng, n, dim, repeated=0.3):
    values = rng.normal(0, 0.2, (n, dim)).round(2)  # coarse, so that distances tie
    for i in np.flatnonzero(rng.random(n) < repeated):
        values[i] = values[rng.integers(0, max(1, i))]
    return [(int(i), [float(x) for x in v], None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(values)]


@pytest.mark.parametrize(("n", "dim"), [(300, 32), (40, 64), (1, 16), (200, 16)])
def test_codes(spark, n, dim):
    rows = vectors(np.random.default_rng(n), n, dim)
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    rows = vectors(np.random.default_rng(1), 90, 32)
    rows += [(5, None, 1), (6, [], 1), (7, [None, *[0.0] * 31], 1), (8, [float("nan"), *[0.0] * 31], None), (9, [float("inf"), *[0.0] * 31], 2), (10, [float("-inf"), *[0.0] * 31], 2),
             (11, [0.5] * 16, 1), (12, [0.5] * 17, 1), (None, [0.25] * 32, 1), (None, [0.125] * 32, None), (3, rows[3][1], 1), (3, rows[3][1], 1), (500, [1000.5] * 32, 9), (501, [-1000.5] * 32, 9)]
    assert found(spark, rows) == sorted(brute(rows), key=str)
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_annulus_leaves_out_no_nearest_entry():
    """Entries of equal norm all around, distances that tie, and borders that are met exactly."""
    rng = np.random.default_rng(4)
    for scale in (1, 3, 40, 2**26):
        entries = rng.integers(-4, 5, (64, 4)) * scale
        x = rng.integers(-6, 7, (2000, 4)) * scale
        codes, errors = codebooks.Codebook(entries).nearest(x)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (errors == d.min(axis=1)).all() and (codes == d.argmin(axis=1)).all()
    entries = rng.normal(0, 1000, (64, 4)).astype(np.int64)
    book = codebooks.Codebook(entries)
    book.nearest(rng.normal(0, 1000, (2000, 4)).astype(np.int64))
    assert book.compared < 2000 * 44  # it does leave entries out


def test_decoded(spark):
    df = spark.createDataFrame(vectors(np.random.default_rng(2), 120, 32), "vec_id long, embedding array<float>, label int")
    kept, dim = codebooks.kept_vectors(df, "embedding", "vec_id")
    books = codebooks.train(kept, "embedding", "vec_id", dim)
    coded = codebooks.encode(kept, "embedding", books, dim)
    given = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)) for r in df.collect()}
    for r in codebooks.decode(coded, books).collect():
        assert ((256 * np.array(r.vector) - given[r.vec_id]) ** 2).sum() == r.error


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "MANY_LABELS", 1)
    rows = vectors(np.random.default_rng(6), 80, 16)
    assert found(spark, rows) == sorted(brute(rows), key=str)
