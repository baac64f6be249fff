"""One-permutation MinHash against the definition, neighbours and likeness against sets."""

import hashlib
import random
import re

import xxhash

from corpusmill.llm import minhash as M


def spark_hash(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def ints_hash(*values):
    """xxhash64 of ints, as Spark chains them."""
    mask, p1, p2, p3, p5 = 2**64 - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    rot = lambda x, r: (x << r | x >> 64 - r) & mask
    h = 42
    for v in values:
        h = (h + p5 + 4) & mask
        h ^= (v & 0xFFFFFFFF) * p1 & mask
        h = (rot(h, 23) * p2 + p3) & mask
        h ^= h >> 33
        h = h * p2 & mask
        h ^= h >> 29
        h = h * p3 & mask
        h ^= h >> 32
    return h - 2**64 if h >= 2**63 else h


def by_definition(text):
    if not re.search(r"[^ \t\n\x0b\x0c\r]", text):
        return ""
    words = re.split(r"[ \t\n\x0b\x0c\r]+", text)
    bins = {}
    for i in range(max(1, len(words) - 4)):
        h = spark_hash(words[i : i + 5]) >> 1
        b = h >> 56
        bins[b] = min(h, bins.get(b, h))
    out = []
    for b in range(128):
        if b in bins:
            v = bins[b]
        else:
            v = bins[min(bins, key=lambda c: ints_hash(b, c))]
        out.append(f"{v & 255:02x}")
    return "".join(out)


ODD = [(5, None), (4, ""), (4, " \n"), (3, "one"), (2, "a b c d e f g"), (None, "no id é🙂x"), (7, "x " * 20_000), (7, "x " * 20_000), (-3, " lead and trail ")]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, run string")
    got = {}
    for r in M.fingerprint_edits(docs).collect():
        got.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append(r)
    ordered = sorted(((d is not None, d or 0, t or ""), d, t or "") for d, t in rows)[::-1]
    known = {}
    fp = lambda t: known.setdefault(t, by_definition(t))
    alike = lambda a, b: (1.0 if a == b else 0.0) if not a or not b else max(0.0, (sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128 - 1 / 256) / (1 - 1 / 256))
    assert sum(map(len, got.values())) == len(rows)
    for k, (_, d, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d, len(t), hashlib.sha256(edited.encode()).hexdigest()][0]
        assert (r.fingerprint, r.edited_fingerprint) == (fp(t), fp(edited)), (d, t[:50])
        assert abs(r.near_edited - alike(fp(t), fp(edited))) < 1e-9 and abs(r.near_next - alike(fp(t), fp(after))) < 1e-9


def test_odd(spark):
    check(spark, ODD)
    check(spark, ODD[3:4])
    check(spark, [])


def test_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_estimates(spark):
    words = [f"w{i}" for i in range(2000)]
    rows, want = [], {}
    for i, n in enumerate((0, 100, 500, 1000, 1900)):
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[n:] + [f"v{j}" for j in range(n)]))]
        common = 2000 - n - 4 if n else 1996
        want[2 * i + 1] = common / (2 * 1996 - common)
    got = {r.doc_id: r.near_next for r in M.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(abs(got[d] - j) < 0.13 for d, j in want.items())


def test_short_texts(spark):
    """Likeness of texts of 1 to 16 shingles against their sets: no bias from the bins they leave empty."""
    rng, rows, want = random.Random(4), [], []
    for n in (1, 2, 4, 8, 12, 16):
        for _ in range(120):
            same = rng.randrange(n + 1)
            own = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            other = own[: same + 4] + [f"v{rng.randrange(10**9)}" for _ in range(n - same)] if same else [f"v{rng.randrange(10**9)}" for _ in range(n + 4)]
            rows += [(2 * len(want), " ".join(other)), (2 * len(want) + 1, " ".join(own))]
            want.append((n, same / (2 * n - same)))
    got = {r.doc_id: r.near_next for r in M.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = [(n, got[2 * i + 1] - j) for i, (n, j) in enumerate(want)]
    assert abs(sum(e for _, e in errors)) / len(errors) < 0.02
    for size in (1, 2, 4, 8, 12, 16):
        own = [e for n, e in errors if n == size]
        assert abs(sum(own)) / len(own) < 0.05, (size, sum(own) / len(own))


def test_fresh_sessions():
    """The result does not hang on how many columns a session has made before."""
    import subprocess
    import sys

    code = """
import sys
from corpusmill.session import local_session
from corpusmill.llm.queries import QUERIES
s = local_session(2, "fresh")
for _ in range(int(sys.argv[1])):
    s.range(1)
found = QUERIES["op4_fingerprints"](s, "/root/testdata/sf0.001")
print("rows", found.count())
"""
    for made in (0, 1, 5):
        done = subprocess.run([sys.executable, "-c", code, str(made)], capture_output=True, text=True, timeout=300)
        assert "rows 200" in done.stdout, done.stderr[-2000:]
