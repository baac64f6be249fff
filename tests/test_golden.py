"""Literal cases of column functions, chunks and readers."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import answers as A
from corpusmill.functions import models
from corpusmill.functions import text as T
from corpusmill.operators import corpus as C
from corpusmill.operators import indexes as X
from corpusmill.sources import files
from corpusmill.streaming.telemetry import windowed_counts

CASES = [
    (T.case_ids, "What is the Date of Issue of the document in case CFI 057/2025?", ["CFI 057/2025"]),
    (T.case_ids, "Do cases SCT 295/2025 and SCT 514/2025 involve any of the same legal entities?", ["SCT 295/2025", "SCT 514/2025"]),
    (T.case_ids, "ARB/31/2025 and ENF-1234-2023", ["ARB 031/2025", "ENF 1234/2023"]),
    (T.metadata_kind, "What is the Date of Issue of the document in case CFI 057/2025?", "date_of_issue"),
    (T.metadata_kind, "Do cases involve any of the same legal entities?", "parties"),
    (T.metadata_kind, "Who is the defendant in case ARB 034/2025?", "parties"),
    (T.metadata_kind, "Was the same judge involved in both case A and case B?", "judge"),
    (T.metadata_kind, "What do other rules say?", None),
    (T.article_keys, "Under Article 8(1) of the Operating Law 2018, Schedule 2", ["article_8", "schedule_2"]),
    (T.reference_tokens, "CFI 057/2025", ["cfi_057_2025", "057", "2025"]),
    (T.reference_tokens, "Article 28(1)(a)", ["article_28", "article_28_1", "1", "article_28_1_a", "a"]),
    (T.reference_tokens, "DIFC Law No. 4 of 2019", ["difc_law_4_2019"]),
    (T.reference_tokens, "Regulation 3.1", ["regulation_3_1", "3", "1"]),
    (T.tokens, "The court of a CASE, case no 7 x", ["court", "case", "case"]),
    (X.heading_key, "Article 28", "article_28"),
    (X.heading_key, "Schedule 3", "schedule_3"),
    (X.heading_key, "Article 5(1)", "article_5_sub_1"),
    (X.heading_key, "no heading", None),
    (A.answer_case_id, "ENF-316-2023/2", "ENF-316-2023/2"),
    (A.answer_case_id, "ENF-316-2023", "ENF 316/2023"),
    (A.pages_used, "PAGES_USED: [3, 7, 12]", [3, 7, 12]),
    (A.fix_date, "2 February 2026", "2026-02-02"),
    (A.fix_date, "February 2, 2026", "2026-02-02"),
    (A.fix_date, "02.02.2026", "2026-02-02"),
    (A.fix_date, "2026-2-2", "2026-02-02"),
    (A.fix_date, "soon", None),
    (A.fix_number, "AED 1,250.5", 1250.5),
    (A.fix_number, "EUR 5", None),
    (A.fix_boolean, "Yes", True),
    (A.fix_boolean, "maybe", None),
    (lambda c: A.answer_keywords(c, F.lit("number")), "50000", ["50000", "50,000"]),
    (lambda c: A.cited(c, F.lit(3)), "[P1] x [P3] [P9] [P1]", [0, 2]),
    (A.plain_letters, "СОР", "COP"),
    (T.title, "7\n# mark\n  A long enough title  \nnext", "A long enough title"),
    (A.truncated_sentence, "ok.", "ok."),
    (A.truncated_sentence, "a" * 400 + ". " + "b" * 400, "a" * 400 + "."),
    (C.chunks, "short", ["short"]),
    (C.chunks, "x" * 1200, ["x" * 500, "x" * 500, "x" * 200]),
    (C.chunks, "a" * 300 + "\nArticle 1\n" + "b" * 300, ["a" * 300, "Article 1\n" + "b" * 300]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(spark, i):
    f, text, want = CASES[i]
    got = spark.range(1).select(f(F.lit(text)).alias("x")).first().x
    assert got == want


def test_chunks_keep_all_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    for r in docs.select("text", C.chunks(F.col("text")).alias("c")).collect():
        assert all(len(x) <= 500 for x in r.c)
        assert "".join("".join(r.c).split()) == "".join(r.text.split())


def test_overlapping_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    text = {r.doc_id: r.text for r in docs.collect()}
    at = {}
    for r in sorted(C.overlapping_chunks(docs).collect()):
        assert r.text == text[r.doc_id][r.start : r.end].strip() and r.end - r.start <= 500
        assert r.start <= at.get(r.doc_id, 0)
        at[r.doc_id] = r.end
    assert all(not text[d][e:].strip() for d, e in at.items())


def test_readers(spark, tmp_path):
    (tmp_path / "q1.json").write_text(json.dumps([{"id": "1", "question": "a", "answer_type": "date"}]))
    (tmp_path / "q2.json").write_text(json.dumps({"questions": [{"id": "2", "question": "b", "answer_type": "name"}]}))
    assert [r.id for r in files.questions(spark, str(tmp_path / "q1.json")).collect()] == ["1"]
    assert [r.id for r in files.questions(spark, str(tmp_path / "q2.json")).collect()] == ["2"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"q": "x"}]}))
    assert [r.q for r in files.benchmark_items(spark, str(tmp_path / "b.json"), "q: string").collect()] == ["x"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"ok")
    assert [r.text for r in files.text_corpus(spark, str(tmp_path / "d")).collect()] == ["ok"]
    (tmp_path / "f" / "g").mkdir(parents=True)
    odd = b"a\xff b\xe2\x82 c\xc3\xa9 \xf0\x9f\x98"
    (tmp_path / "f" / "g" / "odd.txt").write_bytes(odd)
    assert [r.text for r in files.text_corpus(spark, str(tmp_path / "f")).collect()] == [odd.decode(errors="replace")]
    pages = files.page_files(spark, str(tmp_path / "d"), lambda b: [b.decode(), "x" * 100], "*.txt")
    assert sorted((r.doc_id, r.page, r.needs_ocr) for r in pages.collect()) == [("a", 1, True), ("a", 2, False)]
    (tmp_path / "e.json").write_text(json.dumps([{"question_text": "q", "answer": "a", "pages": [{"text": "t"}], "expected_answer": "g"}, {"question": "", "answer": "a"}]))
    assert [(r.question, r.contexts, r.ground_truth) for r in files.evaluation_samples(spark, str(tmp_path / "e.json")).collect()] == [("q", ["t"], "g")]


def test_models(spark):
    df = spark.createDataFrame([("a cat", "cat dog"), (None, "x")], "l string, r string")
    out = models.respond(models.score(models.encode(df, "l"), "l", "r"), "l").collect()
    assert [len(r.embedding) for r in out] == [256, 256] and [r.score for r in out] == [0.5, 0.0] and {r.response for r in out} == {"null"}


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(spark.table("counts").collect()) == key(windowed_counts(events).collect())
