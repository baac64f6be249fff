"""Readers of the input files: questions, JSON lines, benchmark layouts, text corpora, page files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id string, question string, answer_type string"
SAMPLE = "question string, question_text string, answer string, contexts array<string>, pages array<struct<text: string>>, ground_truth string, expected_answer string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A list of questions, bare or under ``questions``."""
    bare = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    nested = spark.read.schema(f"questions array<struct<{QUESTIONS.replace(' string', ': string')}>>").option("multiLine", True).json(path)
    inner = nested.select(F.explode("questions").alias("q")).select("q.*")
    return bare.where("id is not null").union(inner)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file with one JSON object in a line; blank lines give none."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def benchmark_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of a JSON file that is a list, or an object with the list under one of the usual names."""
    names = ["tests", "queries", "benchmarks", "items", "data"]
    lists = ", ".join(f"{n} array<struct<{item}>>" for n in names)
    found = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"array<struct<{item}>>").alias("bare"), F.from_json("value", lists).alias("named")
    )
    return found.select(F.explode(F.coalesce(*[F.col(f"named.{n}") for n in names], F.col("bare"))).alias("i")).select("i.*")


def text_corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text) of all text files below a folder; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def page_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """(doc_id, page, text, needs_ocr): pages of files by a given extractor; a page of under 100 characters needs OCR."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, i + 1, (t or "").strip()) for p, c in zip(frame["path"], frame["content"], strict=True) for i, t in enumerate(extract(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    pages = files.select("path", "content").mapInPandas(run, "path string, page int, text string")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return pages.select(stem.alias("doc_id"), "page", "text", (F.length("text") < 100).alias("needs_ocr"))


def evaluation_samples(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer, contexts, ground_truth) from any of the usual field names; samples without a question or answer are dropped."""
    raw = spark.read.schema(SAMPLE).option("multiLine", True).json(path)
    contexts = F.coalesce("contexts", F.transform("pages", lambda p: p["text"]))
    out = raw.select(F.coalesce("question", "question_text").alias("question"), "answer", contexts.alias("contexts"), F.coalesce("ground_truth", "expected_answer", "answer").alias("ground_truth"))
    return out.where((F.col("question") != "") & (F.col("answer") != ""))


def labelled_dataset(spark: SparkSession, path: str, documents: str, labels: str) -> DataFrame:
    """(file, documents, labels) of the first JSON file below a folder, by path, that has both; ``documents`` and ``labels`` are their types."""
    read = spark.read.schema(f"documents {documents}, labels {labels}").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    found = read.json(path).select(F.input_file_name().alias("file"), "documents", "labels").where("documents is not null and labels is not null")
    return found.orderBy("file").limit(1)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, one directory for each run."""
    results.write.mode("errorifexists").json(path)
