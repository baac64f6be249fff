"""Packing: documents concatenated and cut into fixed windows of token ids.

Two passes. The first encodes every document once and writes blocks of ids with the number of ids
before them in their partition; the totals of the partitions, one number for each task, are summed
into global offsets. The second cuts every block at multiples of the window and emits a boundary
record for each piece. No id is shuffled, and no task holds more than a block and one document.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import encoder, stored, tokenizer_file

#: A block is closed when it has this many ids (the last document may exceed it).
BLOCK_IDS = 500_000
#: Chunks that a task's encoder remembers: words repeat often enough for few, and the rest of the pipeline needs the memory.
REMEMBERED = 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def word_ids(path: str, text: str | None) -> bytes:
    """Ids of a whole text from a tokenizer that drops white space, so that words are encoded independently of each other."""
    if not text:
        return b""
    known = encoder(path, REMEMBERED)
    return known.whole(text) if "<|" in text else known.words(text)


def encoded_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of encoded documents: partition, before (ids before the block in its partition), total, doc_ids, sizes, ids (binary)."""
    schema = "partition int, before long, total long, doc_ids array<long>, sizes array<long>, ids binary"

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        file, end, part = tokenizer_file(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        doc_ids, sizes, ids, before, n = [], [], [], 0, 0

        def flush():
            flat = np.frombuffer(b"".join(ids), "<u4")
            small = not len(flat) or flat.max() < 1 << 16
            blob = (b"\2" if small else b"\4") + flat.astype("<u2" if small else "<u4").tobytes()
            columns = [pa.array([part], pa.int32()), pa.array([before]), pa.array([n]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["partition", "before", "total", "doc_ids", "sizes", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = word_ids(file, text) + end
                ids.append(own)
                doc_ids.append(doc_id)
                sizes.append(len(own) // 4)
                n += sizes[-1]
                if n >= block_ids:
                    yield flush()
                    before += n
                    doc_ids, sizes, ids, n = [], [], [], 0
        if doc_ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)


def pack_documents(docs: DataFrame, window: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Boundary records of ``docs`` (doc_id, text; other columns are ignored) packed into windows of ``window`` ids.

    One row for each piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset (in the sequence).
    Documents follow each other without gaps, so every sequence but the last is full. Null texts are
    empty and have only ``end_id``; null and repeated doc_ids are packed row by row; an empty table
    gives no rows.
    """
    blocks = stored(encoded_blocks(docs, tokenizer, end_id), "packed-ids")
    totals = blocks.groupBy("partition").agg(F.sum("total").alias("n")).collect()  # one row for each task of the first pass
    base, before = {}, 0
    for r in sorted(totals):
        base[r["partition"]] = before
        before += r["n"]

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for b in range(batch.num_rows):
                part, first, total, doc_ids, sizes, blob = (c[b] for c in batch.columns)
                raw = memoryview(blob.as_buffer())
                ids = np.frombuffer(raw[1:], "<u2" if raw[0] == 2 else "<u4").astype("<u4")
                doc_ids, sizes = doc_ids.values, sizes.values.to_numpy()
                g0 = base[part.as_py()] + first.as_py()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cuts = np.arange(-g0 % window or window, total.as_py(), window)
                at = np.union1d(starts, cuts)  # where pieces start
                doc = np.searchsorted(ends, at, side="right")
                length = np.diff(np.append(at, total.as_py()))
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                place = g0 + at
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (at - starts[doc], length)), pa.array(crc, pa.int64()), *(pa.array(x.astype(np.int64)) for x in (sizes[doc], place // window, place % window))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return blocks.mapInArrow(cut, PIECES)
