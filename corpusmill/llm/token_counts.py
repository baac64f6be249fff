"""Token counts: every distinct pre-token is counted once, and its count joined to the documents that hold it.

Documents of one task form blocks. A block is inverted: for each distinct pre-token one row with the
documents of the block that hold it and how often (three bytes a posting). These rows meet by
pre-token and group of ``GROUP`` input partitions; there every distinct pre-token is counted once and
the products are summed for each document. The groups keep a very common pre-token from meeting all of
the corpus in one task, whatever its size. Ids are never materialised, and of the texts only pre-tokens
are shuffled (a text without a blank is one). Pre-tokens that are one vocabulary
entry, which are the most frequent ones, are counted in the block itself.

A pre-token here is a chunk from ``blank_chunks``, less a comma or full stop at its end (a letter
never shares a piece with these), which the tokenizer treats independently of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LETTERS, blank_chunks, encoder, partitions, special_tokens, tokenizer_file

#: A block is closed at this many documents (less than 2**16) or characters.
BLOCK_DOCS, BLOCK_CHARS = 16_384, 24_000_000
#: A pre-token is counted once for so many partitions of the input.
GROUP_BITS = 6
GROUP = 1 << GROUP_BITS

_single: dict[str, frozenset[str]] = {}


def single_pieces(path: str) -> frozenset[str]:
    """Texts of vocabulary entries that the tokenizer gives back as one id; a fixed set, at most the vocabulary."""
    if path not in _single:
        known = encoder(path).tokenizer
        texts = [t for t in known.decode_batch([[i] for i in range(known.get_vocab_size())], skip_special_tokens=False) if t and "�" not in t and blank_chunks(t) == [t]]
        _single[path] = frozenset(t for t, e in zip(texts, known.encode_batch_fast(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)
    return _single[path]


def pre_tokens(text: str) -> dict[str, int]:
    """How often each pre-token occurs in a text without special strings."""
    from collections import Counter

    out: dict[str, int] = {}
    for x, n in Counter(blank_chunks(text)).items():
        if x[-1] in ",." and len(x) > 1 and x[-2] in LETTERS:
            out[x[-1]] = out.get(x[-1], 0) + n
            x = x[:-1]
        out[x] = out.get(x, 0) + n
    return out


def _inverted(tokenizer: str, block_docs: int, block_chars: int):
    def invert(batches):
        import re
        from array import array

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        file = tokenizer_file(tokenizer)
        one, specials = single_pieces(file), special_tokens(file)
        special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        part, number = TaskContext.get().partitionId(), 0
        names = ["pre_token", "block", "postings"]
        rows, word, where, often, vocabulary, chars = [], array("I"), array("H"), array("B"), {}, 0

        def flush():
            block = part << 24 | number
            order = np.argsort(np.frombuffer(word, np.uint32), kind="stable") if len(word) else np.zeros(0, int)
            packed = np.empty(len(order), np.dtype([("d", "<u2"), ("n", "u1")]))
            if len(order):
                packed["d"], packed["n"] = np.frombuffer(where, np.uint16)[order], np.frombuffer(often, np.uint8)[order]
            sizes = np.bincount(np.frombuffer(word, np.uint32), minlength=len(vocabulary)) if len(word) else np.zeros(0, int)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 3
            m, terms = len(vocabulary), list(vocabulary)
            for a in range(0, m, 20_000):
                b = min(m, a + 20_000)
                offsets = pa.py_buffer((ends[a : b + 1] - ends[a]).astype("<i4").tobytes())
                postings = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(packed[ends[a] // 3 : ends[b] // 3].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(terms[a:b], pa.string()), pa.array(np.full(b - a, block)), postings], names)
            own = np.array([(d or 0, d is None, n, t) for d, n, t in rows], _OWN).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block]), pa.array([own], pa.binary())], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, base, place = text or "", 0, len(rows)
                parts = [text]
                if special and "<|" in text:
                    parts = special.split(text)
                    base = len(parts) - 1
                for p in parts:
                    for x, n in pre_tokens(p).items():
                        if x in one:
                            base += n
                            continue
                        w = vocabulary.setdefault(x, len(vocabulary))
                        while n > 0:
                            word.append(w)
                            where.append(place)
                            often.append(min(n, 255))
                            n -= 255
                rows.append((doc_id, len(text.encode()), base))
                chars += len(text)
                if len(rows) >= block_docs or chars >= block_chars:
                    yield from flush()
                    number += 1
                    rows, word, where, often, vocabulary, chars = [], array("I"), array("H"), array("B"), {}, 0
        if rows:
            yield from flush()

    return invert


#: What a block's own row has of each document: its id, whether that is null, bytes, tokens counted in the block.
_OWN = [("doc_id", "<i8"), ("none", "u1"), ("n_bytes", "<i8"), ("n_tokens", "<i8")]
#: Sums of one task for the documents of a block.
_PART = [("place", "<u2"), ("n", "<u4")]


def _joined(tokenizer: str, most: int = 1_000_000):
    """Rows of one task, ordered by pre-token: counts each once and adds up the products for each document of each block.

    Out come one row for each block and flush, with the sums packed, and the rows of blocks as they are."""

    def join(batches):
        import numpy as np
        import pyarrow as pa

        names = ["block", "own", "parts"]
        known = encoder(tokenizer_file(tokenizer)).tokenizer
        keys, sums, held, last = [], [], 0, (None, 0)

        def flush():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            packed = np.empty(len(key), _PART)
            packed["place"], packed["n"] = key & 0xFFFF, np.bincount(at, np.concatenate(sums), len(key))
            blocks, first = np.unique(key >> 16, return_index=True)
            parts = [packed[a:b].tobytes() for a, b in zip(first, [*first[1:], len(key)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([False] * len(blocks)), pa.array(parts, pa.binary())], names)

        for batch in batches:
            docs = batch.filter(batch.column("pre_token").is_null())
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([docs.column("block"), pa.array([True] * docs.num_rows), docs.column("postings")], names)
            batch = batch.filter(batch.column("pre_token").is_valid())
            if not batch.num_rows:
                continue
            terms = batch.column("pre_token").to_pylist()
            counts = dict([last])
            fresh = [t for t in dict.fromkeys(terms) if t not in counts]
            counts.update((t, len(e.ids)) for t, e in zip(fresh, known.encode_batch_fast(fresh, add_special_tokens=False), strict=True))
            last = (terms[-1], counts[terms[-1]])  # the next batch may go on with it
            postings = batch.column("postings").to_pylist()
            sizes = np.array([len(x) for x in postings]) // 3
            packed = np.frombuffer(b"".join(postings), np.dtype([("d", "<u2"), ("n", "u1")]))
            keys.append(np.repeat(batch.column("block").to_numpy().astype(np.int64), sizes) << 16 | packed["d"])
            sums.append(np.repeat(np.array([counts[t] for t in terms], np.int64), sizes) * packed["n"])
            held += len(packed)
            if held >= most:
                yield flush()
                keys, sums, held = [], [], 0
        if keys:
            yield flush()

    return join


def _summed(batches):
    """Rows of one task, ordered by block: adds the parts of each block to what its own row has."""
    import numpy as np
    import pyarrow as pa

    block, sums, own = None, None, None

    def out():
        total = own["n_tokens"] + sums[: len(own)]
        doc_ids = pa.array(own["doc_id"].copy(), mask=own["none"].astype(bool))
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(own["n_bytes"].copy()), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for b, is_own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != block:
                if block is not None:
                    yield out()
                block, sums = b, np.zeros(1 << 16, np.int64)
            if is_own:
                own = np.frombuffer(data.as_buffer(), _OWN)
            else:
                packed = np.frombuffer(data.as_buffer(), _PART)
                sums[packed["place"]] += packed["n"]
    if block is not None:
        yield out()


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of ``docs`` (doc_id, text; other columns are ignored).

    One row for each row of ``docs``, null and repeated doc_ids included; a null text is empty. Special
    strings in a text count as one token each, as the library has it. Texts are counted whole at any length; an empty
    table gives no rows.
    """
    if not 0 < block_docs <= 65_535:
        raise ValueError("a block has at most 65,535 documents: their places take two bytes")
    spark = docs.sparkSession
    inverted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _inverted(tokenizer, block_docs, block_chars), "pre_token string, block long, postings binary"
    )
    # the row of a block has no pre-token: it is dealt by its own number
    deal = F.when(F.col("pre_token").isNull(), F.xxhash64("block")).otherwise(F.xxhash64("pre_token", F.shiftright("block", 24 + GROUP_BITS)))
    met = inverted.repartition(partitions(spark), deal).sortWithinPartitions("pre_token")
    parts = met.mapInArrow(_joined(tokenizer), "block long, own boolean, parts binary")
    whole = parts.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
