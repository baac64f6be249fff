"""What several operators share: the shared folder, range buckets, text chunks for tokenizers."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which the driver and all executors see.

    Where the setting is absent a temporary folder serves, in local mode only: there the one
    machine is the whole cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """``df`` written to the shared folder in ``n`` buckets by ``keys``, as an external table: joins on all of them do not move it again."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).option("path", shared_dir(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` values of an integer ``key`` that cut the table into about equal runs; one small aggregate."""
    cuts = [i / n for i in range(1, n)]
    if not cuts:
        return []
    found = df.agg(F.percentile_approx(key, F.array(*map(F.lit, cuts)), F.lit(max(10_000, 10 * n)))).first()[0]
    return sorted(set(found or []))


def range_bucket(key: str | Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: the number of its run. A null key lies in run 0."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))  # first a group of bounds, then a place in it
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.coalesce(F.size(F.filter(values, lambda b: b <= key)), F.lit(0))
    array = lambda values: F.array(*[F.lit(b).cast("long") for b in values])
    group = below(array([g[0] for g in groups]))
    inside = below(F.get(F.array(*map(array, groups)), group - 1))
    return F.when(group > 0, (group - 1) * step + inside).otherwise(0)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: A blank that is followed by another white-space character or by the end of the text.
_ODD_BLANK = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r"(?= \S)")
#: A line feed between two characters other than white space: a piece of its own.
_LONE_FEED = re.compile(r"(?<=\S)\n(?=\S)")


def blank_chunks(text: str) -> list[str]:
    """The text cut before every blank that a non-blank character follows.

    A byte-level tokenizer whose pattern gives the last blank of a run to the next word, and all
    blanks before it to one piece of their own, treats these chunks independently of each other:
    the pieces of the text are the pieces of its chunks. A run of blanks never crosses a cut.
    """
    if _ODD_BLANK.search(text):
        return [x for x in _CUT.split(text) if x]
    first, *rest = text.split(" ")
    return [*([first] if first else []), *[f" {x}" for x in rest]]


#: Letters that every Unicode version has; one of them never shares a piece with the punctuation after it.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâäáçèéêëíîïñóôöœùúûüßÀÄÉÖÜ")


def _byte_characters() -> dict[int, int]:
    """The usual character of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Remembered(dict):
    """Ids of strings (with ``before`` put before each), encoded when first asked for.

    Words of plain letters are one piece for certain and go straight to the library's model, in lower
    case if the tokenizer has it so; a comma or full stop after a letter is a piece of its own.
    """

    _bytes = _byte_characters()

    def __init__(self, tokenizer, before: str, lower: bool = False):
        self.tokenizer, self.before, self.lower, self.bare = tokenizer, before, lower, self
        own = lambda x: array("I", tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        self.stops, self.feed = {x: own(x) for x in ",."}, own("\n")
        words = ["the", "Hello", "Straße", "naïve", "ÉcoleÖ", "qzxüj"]
        self.straight = all(self._model(w) == self._library(w) for w in words)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(self.before + text, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> bytes:
        word = (self.before + (word.lower() if self.lower else word)).encode().decode("latin-1").translate(self._bytes)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def __missing__(self, text: str) -> bytes:
        mark = self.stops.get(text[-1:])
        if mark is not None and text[-2:-1] in LETTERS:
            return self[text[:-1]] + mark
        if self.straight and text and LETTERS.issuperset(text):
            ids = self._model(text)
        else:
            first, *rest = _LONE_FEED.split(text)
            if rest:
                return self.feed.join([self[first], *map(self.bare.__getitem__, rest)])
            ids = self._library(text)
        self[text] = ids
        return ids


class ChunkEncoder:
    """Token ids from the tokenizers library, each distinct chunk encoded once while it is remembered.

    Ids are kept as bytes (little-endian unsigned 32-bit), so that the ids of a text are one join.
    The memory is bounded: above ``limit`` chunks it starts anew.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        lower = self.tokenizer.encode("HELLO", add_special_tokens=False).ids == self.tokenizer.encode("hello", add_special_tokens=False).ids
        self.bare, self.spaced = _Remembered(self.tokenizer, "", lower), _Remembered(self.tokenizer, " ", lower)
        self.spaced.bare = self.bare

    def _trim(self) -> None:
        if len(self.bare) + len(self.spaced) > self.limit:
            self.bare.clear()
            self.spaced.clear()

    def text(self, text: str) -> bytes:
        """Ids of a text for a tokenizer that gives a blank to the word after it (see ``blank_chunks``)."""
        self._trim()
        if _ODD_BLANK.search(text):
            return b"".join([self.bare[x] for x in blank_chunks(text)])
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def words(self, text: str) -> bytes:
        """Ids of a text for a tokenizer that drops white space."""
        self._trim()
        return b"".join(map(self.bare.__getitem__, filter(None, text.replace("\n", " ").split(" "))))

    def whole(self, text: str) -> bytes:
        """Ids of a text that may hold special strings: the library sees all of it."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, limit: int = 700_000) -> ChunkEncoder:
    """This worker's encoder for the file, which remembers ``limit`` chunks; a worker that runs several tasks keeps what it has learned."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, limit)
    return _encoders[path]


def forget_encoders() -> None:
    """Gives back what this worker's encoders remember; stages that do not tokenize call it, as Spark hands workers on from stage to stage."""
    import ctypes

    import pyarrow as pa

    if _encoders:
        _encoders.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what was freed, other libraries have no such call
        if trim:
            trim(0)


def special_tokens(path: str) -> list[str]:
    """The strings that the tokenizer file treats as special wherever they stand in a text."""
    import json

    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def tokenizer_file(name: str) -> str:
    """Where this machine keeps a public tokenizer; called in the tasks, so that no executor relies on the driver's disk."""
    import public_tokenizers

    return public_tokenizers.path(name)
