"""WARC archives: written with identical-payload revisits and segmented records, read back by reassembly.

Writing is plain DataFrame work into Spark's text sink (a record's bytes, then CR LF CR LF), so any
Hadoop file system will do and a lost task leaves nothing behind. A response is an HTTP message with
chunked transfer framing; messages longer than a segment are cut into a first record and
continuation records, which may stand in any file. Reading parses files record by record, groups the
segments of one origin, orders them by number, verifies the total length and undoes the framing.

A file is one gzip stream of records by default (``compression="none"`` for bare records).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import partitions

SEGMENT_BYTES, CHUNK_BYTES, SALTS = 16_384, 4_096, 32
#: A task begins a new file after so many records (at most about 17 KB each), as a file is read as one value.
FILE_RECORDS = 4_096
CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "origin string, segment int, total long, type string, page_id long, refers_to long, uri string, digest string, payload_bytes long, block binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as bare upper-case base32: five hex digits are four base32 digits."""
    digits = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pieces(data: Column, size: int, length: Column) -> Column:
    """Starts of the pieces of ``size`` bytes of some data of ``length`` bytes; at least one."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / size).cast("int")))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, compression: str = "gzip") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; other columns are ignored) below ``path``.

    The payload is the html in UTF-8, null: empty. Of rows with equal payloads of at least
    ``min_revisit_bytes`` the one with the largest page_id is a response and the others revisit it
    (rows that share that page_id are all responses; without any page_id, all are). Null page_ids
    and urls are written without their fields; repeated rows are records of their own.

    Payloads are compared by SHA-1 and length. The group of a payload may be large: its rows are
    spread over ``SALTS`` keys, and payloads that occur once are not joined at all.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload")})
    several = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("origin"), F.count("*").alias("copies")).where("copies > 1 and origin is not null")
    several = several.select("digest", "n", "origin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(several, ["digest", "n", "salt"], "left")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))

    framed = F.array_join(
        F.transform(
            _pieces(F.col("payload"), chunk_bytes, F.col("n")),
            lambda i: F.when(F.col("n") == 0, F.lit("")).otherwise(
                F.concat(F.lower(F.hex(F.least(F.lit(chunk_bytes), F.col("n") - i * chunk_bytes).cast("long"))), F.lit(CRLF), F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)).cast("string"), F.lit(CRLF))
            ),
        ),
        "",
    )
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), framed, F.lit("0\r\n\r\n"))).cast("binary")
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    name = F.concat(F.lit("<urn:uuid:00000000-0000-8000-"), F.substring(number, 1, 4), F.lit("-"), F.substring(number, 5, 12), F.lit(">"))
    rows = rows.withColumns({"revisit": revisit, "name": F.lower(name), "block": block})
    rows = rows.withColumn("total", F.octet_length("block"))
    rows = rows.withColumn("segments", F.size(_pieces(F.col("block"), segment_bytes, F.col("total"))))
    parts = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    parts = parts.withColumn("part", F.substring(F.col("block"), F.col("i") * segment_bytes + 1, F.lit(segment_bytes)))

    def line(field: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{field}: "), value.cast("string"), F.lit(CRLF))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    first, cut = F.col("i") == 0, F.col("segments") > 1
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, F.col("name")).otherwise(F.concat(F.expr("left(name, length(name) - 1)"), F.lit("#"), F.col("i") + 1, F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("X-Page-ID", F.col("page_id"), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        line("X-Payload-Length", F.col("n"), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("revisit")),
        line("X-Refers-To-Page-ID", F.col("origin"), F.col("revisit")),
        line("WARC-Segment-Number", F.col("i") + 1, cut),
        line("WARC-Segment-Origin-ID", F.col("name"), ~first),
        line("WARC-Segment-Total-Length", F.col("total"), cut & (F.col("i") == F.col("segments") - 1)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("part")),
        F.lit(CRLF),
        F.col("part").cast("string"),
    )
    parts.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record in a file's bytes, bare or as one or several gzip streams; a piece at a time."""
    import zlib

    def plain():
        if bytes(data[:2]) != b"\x1f\x8b":
            yield from (bytes(data[i : i + (1 << 20)]) for i in range(0, len(data), 1 << 20))
            return
        at, stream = 0, zlib.decompressobj(31)
        while at < len(data):
            piece = bytes(data[at : at + (1 << 18)])
            yield stream.decompress(piece)
            at += len(piece) - len(stream.unused_data)
            if stream.eof:
                stream = zlib.decompressobj(31)

    held, source = bytearray(), plain()

    def want(n: int) -> bool:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end, at = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            if not want(at + 1):
                if held.strip():
                    raise ValueError("a record is cut short")
                return
        version, *lines = bytes(held[:end]).decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        stop = end + 4 + int(fields["content-length"])
        if not want(stop + 4):
            raise ValueError("a record is cut short")
        block = bytes(held[end + 4 : stop])
        del held[: stop + 4]
        yield fields, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path`` as they stand: ``RECORDS``; origin is the first segment's id, segment null for whole records."""

    def parse(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        number = lambda f, k: int(f[k]) if k in f else None
        for batch in batches:
            for blob in batch.column(0):
                for f, block in records(memoryview(blob.as_buffer())):
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    rows.append((origin, number(f, "warc-segment-number"), number(f, "warc-segment-total-length"), f["warc-type"], number(f, "x-page-id"), number(f, "x-refers-to-page-id"), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(f, "x-payload-length"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(parse, RECORDS)


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def payload(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, uri, record_type (response or revisit), refers_to, digest, payload_bytes, payload (null for a revisit).

    Segments meet by origin, in order; a gap, a wrong total length or a payload that does not have its
    digest is an error. Records that are whole are not shuffled; files are parsed once for these and once for the segments.
    Files without records give no rows; page_id and uri are null where a record has none.
    """
    columns = "page_id long, uri string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"

    def assemble(batches):
        import base64
        import hashlib

        import pyarrow as pa

        names = [x.split()[0] for x in columns.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        rows, size, first, parts, origin, total = [], 0, None, [], None, None

        def done(r, block):
            found = None
            if r["type"] == "response":
                found = payload(block)
                if base64.b32encode(hashlib.sha1(found).digest()).decode() != r["digest"] or len(found) != r["payload_bytes"]:
                    raise ValueError(f"the payload of {r['origin']} does not have its digest")
            rows.append((r["page_id"], r["uri"], r["type"], r["refers_to"], r["digest"], r["payload_bytes"], found))
            return len(found or b"")

        def close():
            block = b"".join(parts)
            if total != len(block):
                raise ValueError(f"the segments of {origin} have {len(block)} bytes, not {total}")
            return done(first, block)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["segment"] is None:
                    size += done(r, r["block"])
                else:
                    if r["origin"] != origin:
                        if origin is not None:
                            size += close()
                        first, parts, origin, total = r, [], r["origin"], None
                    if r["segment"] != len(parts) + 1:
                        raise ValueError(f"segment {len(parts) + 1} of {origin} is missing")
                    parts.append(r["block"])
                    total = r["total"] if r["total"] is not None else total
                if size > 4 << 20:
                    yield out()
                    rows, size = [], 0
        if origin is not None:
            close()
        if rows:
            yield out()

    found = read_records(spark, path)
    whole = found.where("segment is null").mapInArrow(assemble, columns)
    cut = found.where("segment is not null").repartition(partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    return whole.union(cut.mapInArrow(assemble, columns))
