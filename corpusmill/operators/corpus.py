"""Documents, pages, chunks and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import found, stripped

#: Zero-width place before a legal heading on a new line.
HEADER_CUT = r"(?i)(?=\n(?:Article|Section|Part|Schedule|Appendix|Chapter)\s+[\dIVXivx]+)"


def pages_of(docs: DataFrame, lines: int = 4) -> DataFrame:
    """(doc_id, page, text): documents as pages of so many lines."""
    parts = F.split("text", "\n")
    n = F.ceil(F.size("p") / lines).cast("int")
    numbered = docs.select("doc_id", parts.alias("p")).withColumn("page", F.explode(F.sequence(F.lit(1), n)))
    return numbered.select("doc_id", "page", F.array_join(F.slice("p", (F.col("page") - 1) * lines + 1, F.lit(lines)), "\n").alias("text"))


def joined_pages(pages: DataFrame, piece: Column, separator: str, out: str = "text") -> DataFrame:
    """One text for each document: ``piece`` of its pages in order. A document's own text bounds the group."""
    parts = F.array_sort(F.collect_list(F.struct("page", piece.alias("piece"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), separator).alias(out))


def chunks(text: Column, size: int = 500) -> Column:
    """A page as chunks: whole if short, else cut at legal headings, or at blank lines if there are none, and packed greedily
    to ``size``; a part that is longer is cut into sentences, packed the same way, and at last by length."""
    at_headers = F.filter(F.transform(F.split(text, HEADER_CUT), stripped), lambda x: x != "")
    at_blanks = F.filter(F.transform(F.split(text, r"\n{2,}"), stripped), lambda x: x != "")
    parts = F.when(F.size(at_headers) >= 2, at_headers).otherwise(at_blanks)
    sentences = lambda x: F.filter(F.split(x, r"(?<=[.!?;])\s+"), lambda s: s != "")
    hard = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda i: F.substring(x, i * size + 1, F.lit(size)))
    small = F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= size, F.array(x)).otherwise(F.flatten(F.transform(sentences(x), lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(hard(s)))))))

    def put(state: Column, x: Column) -> Column:
        fits = F.length(state["last"]) + 2 + F.length(x) <= size
        empty = state["last"] == ""
        return F.struct(
            F.when(empty | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"]))).alias("done"),
            F.when(empty, x).when(fits, F.concat(state["last"], F.lit("\n\n"), x)).otherwise(x).alias("last"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"))
    packed = F.aggregate(small, start, put, lambda s: F.when(s["last"] != "", F.concat(s["done"], F.array(s["last"]))).otherwise(s["done"]))
    return F.when(F.length(text) < size, F.filter(F.array(stripped(text)), lambda x: x != "")).otherwise(packed)


def overlapping_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, start, end, text): chunks that overlap; each ends at the last blank line, sentence or blank past its middle, else by length."""

    def pieces(text: str):
        at = 0
        while at < len(text):
            end = min(len(text), at + size)
            if end < len(text):
                window, middle = text[at:end], size // 2
                for marks in (("\n\n",), (". ", ".\n"), (" ",)):
                    place = max(window.rfind(m) + len(m) for m in marks if m in window) if any(m in window for m in marks) else 0
                    if place > middle:
                        end = at + place
                        break
            piece = text[at:end].strip()
            if piece:
                yield at, end, piece
            if end >= len(text):
                return
            at = max(at + 1, end - overlap)

    def cut(batches):
        import pyarrow as pa

        rows: list = []

        def out():
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in pieces(text or ""):
                    rows.append((doc_id, *piece))
                    if len(rows) >= 5_000:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start int, end int, text string")


def repeated_edges(pages: DataFrame) -> DataFrame:
    """(doc_id, line, n): first or last lines longer than five characters that stand on half the pages of a document of three or more."""
    lines = F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x != "")
    edges = pages.select("doc_id", "page", F.explode(F.array_distinct(F.array(F.element_at(F.when(F.size(lines) > 0, lines), 1), F.element_at(F.when(F.size(lines) > 0, lines), -1)))).alias("line"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 3")
    counted = edges.where(F.length("line") > 5).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return counted.join(total, "doc_id").where("n * 2 >= pages").select("doc_id", "line", "n")


def with_neighbours(pages: DataFrame) -> DataFrame:
    """Pages with the pages before and after them, each under a label; blank ones are left out."""
    w = Window.partitionBy("doc_id").orderBy("page")
    label = lambda word, d: F.concat(F.lit(f"[{word} PAGE "), (F.col("page") + d).cast("string"), F.lit("]\n"))
    beside = lambda word, d: F.when(F.trim(F.lag("text", -d).over(w)) != "", F.concat(label(word, d), F.lag("text", -d).over(w)))
    return pages.select("doc_id", "page", F.concat_ws("\n\n", beside("PRECEDING", -1), F.col("text"), beside("FOLLOWING", 1)).alias("text"))


def headings(pages: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, heading, page, level): headings by level; one that several patterns find has the level of the first."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(level).alias("level"), found(F.col("text"), p).alias("h")) for i, (level, p) in enumerate(patterns)])
    rows = pages.select("doc_id", "page", F.explode(every).alias("f")).select("doc_id", "page", "f.i", "f.level", F.explode("f.h").alias("heading"))
    first = F.min(F.struct("i", "level", "page"))
    return rows.groupBy("doc_id", F.trim("heading").alias("heading")).agg(first.alias("k")).select("doc_id", "heading", "k.page", "k.level")


def last_at_or_before(points: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """An as-of join: each point gets the value of the last mark at or before it. One sort of both, no pairs."""
    both = points.select(key, at, F.lit(None).cast("int").alias(value), F.lit(1).alias("_kind")).union(marks.select(key, at, F.col(value).cast("int"), F.lit(0)))
    w = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_kind = 1").drop("_kind")


def entity_sentences(pages: DataFrame, entities: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, page, entity, sentence): sentences of ``pages`` (doc_id, page, text) of more than ``least`` characters that hold an entity of their page
    (``entities``: doc_id, page, entity) in any case. A sentence ends with a full stop or semicolon before a blank."""
    rows = pages.select("doc_id", "page", F.split("text", r"(?<=[.;])\s+").alias("s")).join(entities.select("doc_id", "page", "entity"), ["doc_id", "page"])
    trimmed = F.transform("s", lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    held = F.filter(trimmed, lambda x: F.contains(F.lower(x), F.lower("entity")) & (F.length(x) > least))
    return rows.select("doc_id", "page", "entity", F.explode(held).alias("sentence"))
