"""Where models plug in: an encoder, a pair scorer and a responder, as functions over batches.

The defaults are deterministic stand-ins (a hashed bag of words, word overlap, a fixed answer). They
have no model quality and none is claimed; they let every plan run without a model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Responder = Callable[[list[str]], list[str]]


def hashed_words(texts: list[str], size: int = 256) -> np.ndarray:
    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for w in re.findall(r"\w\w+", (text or "").lower()):
            out[i, zlib.crc32(w.encode()) % size] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def word_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    def one(a: str, b: str) -> float:
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        return len(x & y) / len(x) if x else 0.0

    return [one(a, b) for a, b in pairs]


def no_answer(prompts: list[str]) -> list[str]:
    return ["null"] * len(prompts)


def encode(df: DataFrame, text: str, encoder: Encoder = hashed_words, prefix: str = "", out: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with an array of floats for each text, ``prefix`` put before it (queries of some encoders have one)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [prefix + (x or "") for x in frame[text]]
            parts = [encoder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield frame.assign(**{out: [v.tolist() for p in parts for v in p]})

    return df.mapInPandas(run, f"{_fields(df)}, {out} array<float>")


def score(df: DataFrame, left: str, right: str, scorer: Scorer = word_overlap, out: str = "score", chars: int = 2000) -> DataFrame:
    """``df`` with the score of each pair of texts, the right one cut to what a scorer takes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: scorer([(a or "", (b or "")[:chars]) for a, b in zip(frame[left], frame[right], strict=True)])})

    return df.mapInPandas(run, f"{_fields(df)}, {out} double")


def respond(df: DataFrame, prompt: str, responder: Responder = no_answer, out: str = "response", attempts: int = 3) -> DataFrame:
    """``df`` with a response to each prompt; after ``attempts`` failures a null. ``<out>_error`` has the last failure's text
    (also of attempts that were made good), ``<out>_attempts`` how many it took."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, error, n = [None] * len(frame), None, 0
            for n in range(1, attempts + 1):
                try:
                    answers = responder(list(frame[prompt]))
                    break
                except Exception as e:  # noqa: BLE001  a responder is foreign code; its failures are told in the result
                    error = f"{type(e).__name__}: {e}"
            yield frame.assign(**{out: answers, f"{out}_error": [error] * len(frame), f"{out}_attempts": [n] * len(frame)})

    return df.mapInPandas(run, f"{_fields(df)}, {out} string, {out}_error string, {out}_attempts int")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
