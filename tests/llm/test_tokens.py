"""Token files, packing and token counts against the tokenizers library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing, token_counts, token_file
from corpusmill.llm.common import ChunkEncoder, blank_chunks, shared_dir, tokenizer_file

ODD = [
    (5, None), (3, ""), (3, "twice"), (3, "twice"), (None, "no id"), (9, "<|endoftext|>"), (8, " a  b   c \n d\n\n e\t f\r\n  "),
    (7, "It's <|endoftext|>  x <|endoftext|><|startoftext|> y's, 'll 1234.5 <| x"), (6, "a\xa0b  \xa0 c d\x1c e\x1d\x1ef \x85 g"),
    (4, "naïve Ǆ é ́x 漢字 かな. ١٢٣ ½² 🙂🙂 ≮ İı ΑΣ Σ"), (2, "word, " * 3000 + "end."), (1, ",. ,, .a,. é, Ω, 1, 2."), (0, " "), (10, "\n"),
    (11, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, i, "mine") for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, start string")


def library(name):
    t = Tokenizer.from_file(tokenizer_file(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.mark.parametrize("which", ["odd", "table"])
def test_counts(spark, docs, which):
    docs = docs if which == "odd" else texts(spark)
    ids = library("byte_bpe_50k.json")
    got = token_counts.count_tokens(docs, block_docs=7 if which == "odd" else 16_384)
    want = [(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for d, t in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_counts_of_nothing(spark, docs):
    assert token_counts.count_tokens(docs.where("false")).collect() == []


@pytest.mark.parametrize("which", ["odd", "table"])
def test_token_files(spark, docs, which):
    docs = docs if which == "odd" else texts(spark)
    ids = library("byte_bpe_50k.json")
    path = shared_dir(spark, "test")
    token_file.write_token_files(docs, path, segment_ids=900)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for d, t in rows:
        own = [*ids(t), 0]
        want.append((d, start, len(own), crc(own)))
        start += len(own)
    got = [tuple(r) for r in token_file.token_spans(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == want


def test_token_files_of_nothing(spark, docs):
    path = shared_dir(spark, "test")
    token_file.write_token_files(docs.where("false"), path)
    assert token_file.token_spans(spark, path).collect() == []


def test_any_id_is_addressable():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1], 5000).astype("<u4")
    blob = token_file.segment(0, 0, 0, [1], [len(ids)], ids) + b"\n"
    (s,) = token_file.segments(blob)
    assert s.ids().tolist() == ids.tolist()
    assert [s[i] for i in range(len(ids))] == ids.tolist()
    with pytest.raises(IndexError):
        s[len(ids)]


@pytest.mark.parametrize(("which", "window"), [("odd", 16), ("table", 4096), ("odd", 4096)])
def test_packing(spark, docs, which, window):
    docs = docs if which == "odd" else texts(spark)
    ids = library("word_bpe_49k.json")
    got = packing.pack_documents(docs, window).collect()
    want = sorted(((d, [*ids(t), 2]) for d, t in docs.select("doc_id", "text").collect()), key=str)
    # pieces follow each other without a gap, in whole windows
    place, whole = 0, []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * window + r.offset == place and r.offset + r.length <= window and r.length > 0
        place += r.length
        whole.append(r)
    # pieces of a document stand in order; cut its ids the same way and compare
    pieces, i = [], 0
    while i < len(whole):
        doc, n = [], whole[i].doc_tokens
        while sum(r.length for r in doc) < n:
            assert whole[i].start == sum(r.length for r in doc) and whole[i].doc_tokens == n
            doc.append(whole[i])
            i += 1
        pieces.append((doc[0].doc_id, [(r.start, r.length, r.ids_crc32) for r in doc], n))
    assert place == sum(len(x) for _, x in want)
    left = {}
    for d, x in want:
        left.setdefault(d, []).append(x)
    for d, cut, n in pieces:
        fit = next(x for x in left[d] if len(x) == n and all(crc(x[a : a + m]) == c for a, m, c in cut))
        left[d].remove(fit)
    assert not any(left.values())


def test_packing_of_nothing(spark, docs):
    assert packing.pack_documents(docs.where("false")).collect() == []


def test_chunks_are_the_text():
    for _, t in ODD:
        assert "".join(blank_chunks(t or "")) == (t or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_line_feeds(name):
    lines = "\n".join(f"word{i}" for i in range(5000))
    for text in (lines, "漢字\n" * 3000 + "か", f"a {lines}, b", "x\n\ny\nz\r\nend.\n\tq\n" * 1500, "\n a\nb\u3000\nc.\n,d"):
        own, ids = ChunkEncoder(tokenizer_file(name)), library(name)(text)
        encode = own.text if name.startswith("byte") else own.words
        for _ in range(2):
            assert np.frombuffer(encode(text), "<u4").tolist() == ids
        assert sum(map(len, [*own.bare, *own.spaced])) <= 2 * len(text)  # no suffixes are kept
