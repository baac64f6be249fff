"""Words, near words, forms and roots against their definition over all pairs."""

import random
import re
import zlib
from collections import Counter

from corpusmill.llm import spelling


def counted(rows, length=6, times=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= times}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    out, form = [], {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out.append([w, form[w], None, n[w], len(near), n[best] if form[w] else None])
    for row in out:
        row[2] = row[0]
        while form[row[2]]:
            row[2] = form[row[2]]
    return sorted(map(tuple, out))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, word string, `Form` int")
    return sorted(map(tuple, spelling.spelling_variants(docs).collect()))


def test_variants(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abnéÀ") for _ in range(rng.randrange(5, 10))) for _ in range(40)] + ["anananana", "banananana", "aaaaaaaa", "aaaaaaa", "abababab", "ababab×b"]
    near = [w[:i] + rng.choice(["", "a", "bn", "é"]) + w[i + rng.randrange(2) :] for w in words for i in range(len(w) + 1)]
    weights = [rng.choice([1, 2, 30, 200]) for _ in words + near]
    texts = [" ".join(rng.choices(words + near, weights, k=300)).title() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (70, None), (71, ""), (72, "12 345 -- ß"), (73, "Straße-straße\x00straße " * 4000), (74, "q" * 50_000), (75, "chainword " * 250 + "chainwore " * 50 + "chainxore " * 10)]
    want = brute(counted(rows))
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)
    assert found(spark, rows) == want
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spark, rows) == brute(counted(rows))


def test_words_of_a_damaged_run():
    """The checksum is of the id, a colon and the run; some run of a thousand loses a letter."""
    runs = ["".join(chr(97 + int(c)) for c in str(10**7 + 7919 * i)) for i in range(1000)]
    got = spelling.words_of(12, " ".join(runs))
    assert got == counted([(12, " ".join(runs))], length=0, times=1) and 0 < len(set(got) - set(runs)) < 20


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(27)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w27" for w, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0
