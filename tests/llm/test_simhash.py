"""Fingerprints against the definition, links and components against all pairs."""

import numpy as np
import xxhash

from corpusmill.llm import simhash


def by_definition(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def all_pairs(fps, bits=4):
    fps = np.array(sorted(fps), np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {int(f): int(fps[find(i)]) for i, f in enumerate(fps)}


def near_words(rng, n=400):
    """Random fingerprints, each with some at up to six differing bits, and a dense group."""
    out = []
    for x in rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
        out.append(int(x))
        for d in range(1, 7):
            y = int(x)
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            out.append(y)
    base = out[0]
    for _ in range(600):
        y = base
        for b in rng.choice(20, rng.integers(0, 7), replace=False):
            y ^= 1 << int(b) * 3
        out.append(y)
    return sorted({*out, 0, 2**64 - 1})


def test_keys_meet_at_four_bits():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = int(rng.integers(0, 2**63)) * 2 + 1
        for a, b, c in ((4, 0, 0), (0, 4, 0), (0, 0, 4), (2, 2, 0), (1, 1, 2), (3, 1, 0), (3, 0, 1), (1, 3, 0), (0, 3, 1), (2, 1, 1), (1, 2, 1), (0, 2, 2), (2, 0, 2), (1, 0, 3), (0, 1, 3)):
            y = x
            for low, size, n in ((0, 23, a), (23, 23, b), (46, 18, c)):
                for bit in rng.choice(size, n, replace=False):
                    y ^= 1 << low + int(bit)
            key, owner = simhash.keys(np.array([x, y], np.uint64))
            assert {*key[owner == 0].tolist()} & {*key[owner == 1].tolist()}, (a, b, c)


def test_components_of_words(spark):
    words = near_words(np.random.default_rng(2))
    want = all_pairs(words)
    df = spark.createDataFrame([(5, int(np.uint64(w).view(np.int64))) for w in words], "round int, fp long")
    for bucket in (20_000, 40):  # 40: large buckets are cut and searched by pairs of cuts
        from corpusmill.llm.components import components

        got = {r.v: r.root for r in components(simhash.links(df, bucket=bucket)).collect()}
        groups, expected = {}, {}
        for w in words:
            s = int(np.uint64(w).view(np.int64))
            groups.setdefault(got.get(s, s), set()).add(w)
            expected.setdefault(want[w], set()).add(w)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


ODD = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "ONE\ttwo"), (None, "one two"), (6, "a b c d"), (6, "a b c d"), (7, "É é é É É"), (8, "x " * 20_000), (9, "\x1c \xa0"), (None, "only null here at all")]


def test_documents(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for rows in (ODD, table, []):
        docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, root string")
        got = simhash.near_duplicates(docs).collect()
        fps = [by_definition(t) for _, t in rows]
        root = all_pairs(set(fps)) if rows else {}
        least = {}
        for (d, _), f in zip(rows, fps, strict=True):
            if d is not None:
                least[root[f]] = min(d, least.get(root[f], d))
        want = [(d, f, least.get(root[f])) for (d, _), f in zip(rows, fps, strict=True)]
        assert sorted(((r.doc_id, int(np.int64(r.fp).view(np.uint64)), r.component_id) for r in got), key=str) == sorted(want, key=str)


def all_similar(texts, rounds=simhash.ROUNDS, similarity=simhash.SIMILARITY):
    """The smallest number that each text reaches over all pairs whose fingerprints, taken together, are similar enough."""
    fps = simhash.fingerprint_texts(texts, simhash.WORDS, rounds)
    limit, root = int(64 * rounds * np.arccos(similarity) / np.pi), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]).sum(axis=1) <= limit):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def nearly(got, want, text):
    """Whether all of ``want`` was kept, and nothing else that has a Jaccard likeness of 0.85 to something kept before it."""
    sets = {d: shingles(text[d]) for _, d in got}
    like = lambda a, b: len(a & b) / len(a | b)
    return set(want) <= set(got) and all(like(sets[d], sets[x]) < 0.85 for _, d in set(got) - set(want) for x in sets if x < d)


def test_deduplicated(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for rows in (ODD, table, []):
        docs = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], "doc_id long, text string, fp int, root string, row int, copy int, _row string")
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        root = all_similar([t for _, t in rows])
        want = sorted((rows[i][0] is None, rows[i][0] or 0) for i in set(root))
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
        assert got == want if rows != sorted(table) else nearly(got, want, {r[0]: r[1] for r in rows})


def edited(rng, words, changed):
    """The words with runs of new ones written over their end, so that ``changed`` of 200 five-word shingles are others."""
    out = words.copy()
    out[len(out) - changed :] = rng.integers(10**6, 10**7, changed)
    return out


def test_recall_of_similar_texts(spark):
    """Pairs of a known Jaccard likeness: links against true shingle sets, without keys."""
    rng, rows, pairs = np.random.default_rng(9), [], []
    for likeness, changed in ((0.8, 22), (0.85, 16), (0.9, 10), (0.4, 86)):
        for _ in range(250):
            a = rng.integers(10**6, 10**7, 204)
            b = edited(rng, a, changed)
            sets = [{tuple(x[i : i + 5]) for i in range(200)} for x in (a.tolist(), b.tolist())]
            j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            assert abs(j - likeness) < 0.01
            pairs.append((likeness, len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(map(str, a))), (len(rows) + 1, " ".join(map(str, b)))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {x: np.mean([got[a] == got[b] for y, a, b in pairs if y == x]) for x in (0.8, 0.85, 0.9, 0.4)}
    assert found[0.8] >= 0.9 and found[0.85] >= 0.97 and found[0.9] >= 0.99 and found[0.4] == 0, found
    assert len(set(got.values())) == 2 * len(pairs) - sum(got[a] == got[b] for _, a, b in pairs)


def test_components_in_slices(spark):
    """Long paths, a star and cliques, in one slice and in many."""
    from corpusmill.llm.components import components

    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1600)] + [(5000 + i, 5000 + j) for i in range(20) for j in range(i)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for size in (100_000, 50):
        got = {r.v: r.root for r in components(df, size).collect()}
        assert got == {**{i: 100 for i in range(100, 401)}, **{i: 1000 for i in range(1000, 1600)}, **{5000 + i: 5000 for i in range(20)}}
    assert components(df.where("false")).count() == 0


def test_forest():
    """The kept edges connect what all do, have no cycle, and are the best ones (against Kruskal)."""
    from corpusmill.llm.components import forest, roots

    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (2, 1), (50, 30), (50, 400), (300, 500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        own, want = list(range(n)), []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while own[x] != x:
                x = own[x]
            while own[y] != y:
                y = own[y]
            if x != y:
                own[y] = x
                want.append(i)
        kept = forest(a, b, n)
        assert np.flatnonzero(kept).tolist() == want
        assert (roots(a[kept], b[kept], n) == roots(a, b, n)).all()
