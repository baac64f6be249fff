"""Token ids in directly addressable files.

A file holds segments, each followed by one line feed. A segment holds the documents of a run of
ascending ids as *directly addressable codes*: level 0 has the low ``CHUNK_BITS`` bits of every id,
level k the next bits of those ids that need them. A bitmap beside each level says which codes
continue, and a rank directory (ones before each block of ``RANK_BITS`` bits) turns a position in
one level into its position in the next. So any id is read with a few lookups and nothing before it
is decoded.

All numbers are little-endian. A segment is: ``DAC1``, length of the rest (u64), partition (u32),
number in the partition (u32), ids before it in the partition (u64), documents (u64), ids (u64),
levels (u32), chunk bits (u32); doc_ids (i64 each), whether the doc_id is null (u8 each), end of each
document in ids of the segment (u64 each); per level: its length (u64), codes (u8 each), bitmap,
rank directory (u32 each, one per started block).

Files are written and read through Spark's own sources, so any Hadoop file system will do, and lost
tasks leave nothing behind. Ids up to 2**32 - 1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import encoder, partitions, stored, tokenizer_file

MAGIC, HEAD = b"DAC1", struct.Struct("<4sQIIQQQII")
CHUNK_BITS, RANK_BITS = 8, 512
#: A segment is closed when it has this many ids (the last document may exceed it).
SEGMENT_IDS = 2_000_000
#: A task begins a new file after so many segments (about 5 MB each), as a file is read as one value.
FILE_SEGMENTS = 16


def pack(ids):
    """The levels of an array of ids: (codes, bitmap, rank directory) each; at least one level."""
    import numpy as np

    ids = np.asarray(ids, "<u4")
    levels = []
    while True:
        more = ids >> CHUNK_BITS
        on = more != 0
        bits = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(((ids & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, ranks))
        ids = more[on]
        if not len(ids):
            return levels


def segment(partition: int, number: int, before: int, doc_ids: list[int | None], ends: list[int], ids) -> bytes:
    import numpy as np

    levels = pack(ids)
    body = [
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array(ends, "<u8").tobytes(),
    ]
    for codes, bits, ranks in levels:
        body += [struct.pack("<Q", len(codes)), codes.tobytes(), bits.tobytes(), ranks.tobytes()]
    body = b"".join(body)
    return HEAD.pack(MAGIC, len(body), partition, number, before, len(doc_ids), len(ids), len(levels), CHUNK_BITS) + body


class Segment:
    """One segment of a file's bytes, from ``at``; ``end`` is where the next one starts."""

    def __init__(self, data, at: int = 0):
        import numpy as np

        magic, size, self.partition, self.number, self.before, docs, self.n_ids, levels, self.bits = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at += HEAD.size
        self.end = at + size + 1
        take = lambda kind, n: np.frombuffer(data, kind, n, at)
        self.doc_ids = take("<i8", docs)
        at += 8 * docs
        self.null = take(np.uint8, docs)
        at += docs
        self.ends = take("<u8", docs).astype(np.int64)
        at += 8 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            codes = take(np.uint8, n)
            at += n
            bits = take(np.uint8, (n + 7) // 8)
            at += len(bits)
            ranks = take("<u4", -(-n // RANK_BITS))
            at += 4 * len(ranks)
            self.levels.append((codes, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``: one step for each level it uses."""
        import numpy as np

        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for codes, bits, ranks in self.levels:
            value |= int(codes[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            whole = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(whole).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += self.bits
        return value

    def ids(self):
        """All ids at once."""
        import numpy as np

        value = None
        for codes, bits, _ in reversed(self.levels):
            level = codes.astype("<u4")
            if value is not None:
                level[np.unpackbits(bits, count=len(codes), bitorder="little").astype(bool)] |= value << np.uint32(self.bits)
            value = level
        return value


def segments(data) -> Iterator[Segment]:
    """All segments of a file."""
    at = 0
    while at < len(data):
        found = Segment(data, at)
        yield found
        at = found.end


def text_ids(path: str, text: str | None) -> bytes:
    """Ids of a whole text as the library gives them, as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    known = encoder(path)
    return known.whole(text) if "<|" in text else known.text(text)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into files below ``path``, in ascending doc_id order.

    Null texts are empty; null doc_ids come first; rows that share a doc_id are ordered by text and
    all kept; an empty table gives files without segments. Every document ends with ``end_id``. ``tokenizer`` names a byte-level file of the
    public tokenizers. A partition is a run of doc_ids, a task holds one segment at a time, and a file
    has at most ``FILE_SEGMENTS``, so that neither grows with the partition.
    """

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        file, end, part = tokenizer_file(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        doc_ids, ends, ids, number, before, n = [], [], [], 0, 0, 0

        def flush():
            blob = segment(part, number, before, doc_ids, ends, np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["segment"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = text_ids(file, text) + end
                ids.append(own)
                n += len(own) // 4
                doc_ids.append(doc_id)
                ends.append(n)
                if n >= segment_ids:
                    yield flush()
                    number, before = number + 1, before + n
                    doc_ids, ends, ids, n = [], [], [], 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    # the text sink writes a string's bytes as they are; a line feed ends each segment
    ordered.mapInArrow(write, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, partition, number (of the segment), place (in it), first (ids before it in the
    partition), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    schema = "doc_id long, partition int, number int, place int, first long, n_tokens long, ids_crc32 long"

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column(0):
                for s in segments(memoryview(blob.as_buffer())):
                    data, starts = memoryview(s.ids().tobytes()), np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), s.ends.tolist(), strict=True)]
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.doc_ids, pa.int64(), mask=s.null.astype(bool)),
                            pa.array(np.full(n, s.partition, np.int32)),
                            pa.array(np.full(n, s.number, np.int32)),
                            pa.array(np.arange(n, dtype=np.int32)),
                            pa.array(starts + s.before),
                            pa.array(s.ends - starts),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "partition", "number", "place", "first", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("content").mapInArrow(read, schema)


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """``read_token_files`` with ``start``: the ids of all documents before this one, over all files.

    Within a partition the files themselves carry the sums; only one total for each partition goes
    through the driver, and there are no more of these than write tasks.
    """
    rows = stored(read_token_files(spark, path), "token-spans")
    totals = rows.groupBy("partition").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n")).orderBy("partition").collect()
    base, before = [], 0
    for r in totals:
        base.append((r["partition"], before))
        before += r["n"]
    bases = spark.createDataFrame(base, "partition int, base long")
    return rows.join(F.broadcast(bases), "partition").withColumn("start", F.col("base") + F.col("first")).drop("base")
