"""WARC: exact round trip with revisits and segments; broken archives are errors."""

import base64
import hashlib

import pytest

from corpusmill.llm import warc
from corpusmill.llm.common import shared_dir

ROWS = [
    (1, "https://a.example/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 10),
    (6, "u", "ü🙂" * 9000), (7, "v", "ü🙂" * 9000), (8, "w", "x" * 4096), (9, "w", "x" * 4097), (9, "w", "x" * 4097), (None, None, None), (10, "only", "\x00\x01\n\r\n"), (11, "z", "y" * 300_000),
]


def expected(rows, least=0):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, d in data:
        if p is not None:
            last[d] = max(p, last.get(d, p))
    for p, d in data:
        o = last.get(d) if len(d) >= least and sum(x == d for _, x in data) > 1 else None
        revisit = o is not None and p != o
        yield p, "revisit" if revisit else "response", o if revisit else None, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), None if revisit else d


@pytest.mark.parametrize(("compression", "least", "segment"), [("gzip", 0, 16_384), ("none", 6, 100)])
def test_round_trip(spark, compression, least, segment):
    path = shared_dir(spark, "warc-test")
    df = spark.createDataFrame([(*r, 1, "d") for r in ROWS], "page_id long, url string, html string, n int, digest string")
    warc.write_archives(df.repartition(3), path, least, segment_bytes=segment, chunk_bytes=33 if segment == 100 else 4096, compression=compression)
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(expected(ROWS, least), key=repr)
    kinds = {r.type for r in warc.read_records(spark, path).select("type").collect()}
    assert kinds == {"response", "revisit", "continuation"}


def test_missing_segments_are_errors(spark):
    path, other = shared_dir(spark, "warc-test"), shared_dir(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "x" * 1000)], "page_id long, url string, html string")
    warc.write_archives(df, path, segment_bytes=100, compression="none")
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    cut = text.split("WARC/1.1\r\n")
    spark.createDataFrame([("WARC/1.1\r\n".join(cut[:4] + cut[5:]),)], "value string").write.option("lineSep", "\n").text(other)
    with pytest.raises(Exception, match="is missing"):
        warc.read_archives(spark, other).collect()


def test_several_gzip_streams():
    import gzip

    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.records(gzip.compress(one) + gzip.compress(one * 2))] == [b"abc"] * 3
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(one[:-8]))


def test_empty(spark):
    path = shared_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []
