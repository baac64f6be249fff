"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into windows of ``STEPS`` bytes. Two gated recurrent units read each window, one from
either end; at every byte both states give the probabilities of the languages, and the probabilities
of all bytes of a document are averaged. Every byte of every text counts. The gates and the
candidate use x / (1 + |x|) in place of the hyperbolic tangent, which numpy computes several times faster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import forget_encoders, fresh, held_out

#: Network: bytes in a window, hidden units of each direction.
STEPS, HIDDEN = 64, 16
#: The bounded training sample: so many documents of each language at most, of at most so many languages, and windows of each document.
DOCS_PER_LANGUAGE, MAX_LANGUAGES, WINDOWS_PER_DOC = 300, 200, 8
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.01, 7
#: Rows of a language that are ranked for the sample, for each that it may have.
SPARE = 4
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    #: for each direction: input table (3H, 256), recurrent weights (3H, H), output weights (C, H)
    x: list = field(default_factory=list)
    u: list = field(default_factory=list)
    out: list = field(default_factory=list)
    bias: object = None

    def parameters(self):
        return [*self.x, *self.u, *self.out, self.bias]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
    import numpy as np

    rng, c = np.random.default_rng(seed), len(languages)
    m = Model(languages)
    for _ in range(2):
        m.x.append((rng.standard_normal((3 * hidden, 256)) * 0.3).astype("f4"))
        m.u.append((rng.standard_normal((3 * hidden, hidden)) / hidden**0.5).astype("f4"))
        m.out.append((rng.standard_normal((c, hidden)) / hidden**0.5).astype("f4"))
    m.bias = np.zeros((c, 1), "f4")
    return m


def _soft(x, work):
    """x / (1 + |x|), in place."""
    import numpy as np

    np.abs(x, out=work)
    work += 1
    x /= work


def _unit(x, u, data, keep: bool):
    """States of one direction over (steps, batch) bytes: (steps, H, batch); with ``keep``, what the way back needs."""
    import numpy as np

    steps, batch = data.shape
    h3, hidden = u.shape
    states = np.empty((steps, hidden, batch), "f4")
    h, g, a, work = np.zeros((hidden, batch), "f4"), np.empty((h3, batch), "f4"), np.empty((h3, batch), "f4"), np.empty((h3, batch), "f4")
    trace = []
    for t in range(steps):
        np.take(x, data[t], axis=1, out=a, mode="clip")
        np.dot(u, h, out=g)
        gates, n = a[: 2 * hidden], a[2 * hidden :]
        gates += g[: 2 * hidden]
        _soft(gates, work[: 2 * hidden])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:hidden], gates[hidden:]
        s = work[:hidden]
        np.multiply(r, g[2 * hidden :], out=s)
        n += s
        _soft(n, work[:hidden])
        if keep:
            trace.append((h.copy(), z.copy(), r.copy(), n.copy(), g[2 * hidden :].copy()))
        h -= n
        h *= z
        h += n
        states[t] = h
    return states, trace


def _softmax(logits):
    import numpy as np

    logits -= logits.max(axis=-2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-2, keepdims=True)
    return logits


def probabilities(model: Model, data):
    """(steps, C, batch) probabilities of every position of (steps, batch) bytes."""
    import numpy as np

    forward, _ = _unit(model.x[0], model.u[0], data, False)
    logits = np.matmul(model.out[0], forward)
    backward, _ = _unit(model.x[1], model.u[1], data[::-1], False)
    logits += np.matmul(model.out[1], backward[::-1])
    logits += model.bias
    return _softmax(logits)


def _back(x, u, data, trace, d_states):
    """Gradients of one direction: of the input table and the recurrent weights."""
    import numpy as np

    steps, batch = data.shape
    hidden = u.shape[1]
    du, dx = np.zeros_like(u), np.zeros_like(x)
    dh, da, dg = np.zeros((hidden, batch), "f4"), np.empty((3 * hidden, batch), "f4"), np.empty((3 * hidden, batch), "f4")
    one = np.eye(256, dtype="f4")
    for t in range(steps - 1, -1, -1):
        h, z, r, n, gn = trace[t]
        dh += d_states[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        da[:hidden] = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        da[hidden : 2 * hidden] = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        da[2 * hidden :] = dn
        dg[: 2 * hidden] = da[: 2 * hidden]
        dg[2 * hidden :] = dn * r
        du += dg @ h.T
        dx += da @ one[data[t]]
        dh = dh * z + u.T @ dg
    return dx, du


def train(windows, labels, languages: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Model:
    """A model from (n, steps) windows of bytes and the number of each window's language, by Adam on the loss of every position."""
    import numpy as np

    model = new_model(languages, hidden, seed)
    rng, at = np.random.default_rng(seed), 0
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            data, want = np.ascontiguousarray(windows[pick].T), labels[pick]
            forward, trace_f = _unit(model.x[0], model.u[0], data, True)
            backward, trace_b = _unit(model.x[1], model.u[1], data[::-1], True)
            p = _softmax(np.matmul(model.out[0], forward) + np.matmul(model.out[1], backward[::-1]) + model.bias)
            p[:, want, np.arange(len(pick))] -= 1
            p /= data.size
            d_out = [np.einsum("tcb,thb->ch", p, forward, optimize=True), np.einsum("tcb,thb->ch", p, backward[::-1], optimize=True)]
            dx0, du0 = _back(model.x[0], model.u[0], data, trace_f, np.matmul(model.out[0].T, p))
            dx1, du1 = _back(model.x[1], model.u[1], data[::-1], trace_b, np.matmul(model.out[1].T, p)[::-1])
            at += 1
            step = rate * (1 - at / (total + 1)) * (1 - 0.999**at) ** 0.5 / (1 - 0.9**at)
            for w, m1, m2, d in zip(model.parameters(), first, second, [dx0, dx1, du0, du1, *d_out, p.sum(axis=(0, 2))[:, None]], strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                w -= (step * m1 / (np.sqrt(m2) + 1e-8)).astype("f4")
    return model


def _windows(texts: list[bytes], steps: int):
    """Texts in (windows, steps) bytes, zeros at their ends; the windows of each text; the bytes of each window."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // steps)
    data = np.zeros((int(n.sum()), steps), np.uint8)
    flat, at, fill = data.reshape(-1), 0, np.full(int(n.sum()), steps, np.int64)
    for t, k in zip(texts, n.tolist(), strict=True):
        flat[at * steps : at * steps + len(t)] = np.frombuffer(t, np.uint8)
        at += k
        if k:
            fill[at - 1] = len(t) - (k - 1) * steps
    return data, n, fill


def pooled(model: Model, texts: list[bytes], steps: int = STEPS, batch: int = 2048):
    """(texts, C): the mean over all bytes of each text of the probabilities at that byte; zeros for an empty text."""
    import numpy as np

    data, n, fill = _windows(texts, steps)
    sums = np.zeros((len(texts) + 1, len(model.languages)))
    owner = np.repeat(np.arange(len(texts)), n)
    for i in range(0, len(data), batch):
        part = data[i : i + batch]
        p = probabilities(model, np.ascontiguousarray(part.T))
        short = np.flatnonzero(fill[i : i + batch] < steps)
        for k in short.tolist():
            p[fill[i + k] :, :, k] = 0
        each, own = p.sum(axis=0).T.astype(float), owner[i : i + batch]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[cuts]] += np.add.reduceat(each, cuts, axis=0)
    return sums[:-1] / np.maximum(1, [[len(t)] for t in texts]) if texts else sums[:-1]


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, windows_per_doc: int = WINDOWS_PER_DOC) -> list[tuple[str, list[bytes]]]:
    """(lang, windows) of at most ``per_language`` documents of each language that are not held out, the same ones at any partitioning.

    Documents are chosen first, by the smallest hashes of id and text, from narrow rows; repeated rows are one. Different ones are counted before that, so that only rows
    whose hash lies in the lowest part of the range, where ``SPARE`` times as many as are asked for (and a hundred) are expected, are ranked:
    what a language's task ranks does not grow with the corpus. Of the
    chosen ones at most ``windows_per_doc`` windows of bytes, spread evenly over the whole text, reach
    the driver: bounded in rows and in bytes.
    """
    usable = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.withColumn("_h", F.xxhash64("doc_id", "text"))  # of both: ids may repeat
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages cannot be learned")
    if not counts:
        return []
    share = lambda n: min(1.0, (SPARE * per_language + 100) / n)
    below = {r["lang"]: -(2.0**63) + share(r["_n"]) * 2.0**64 for r in counts}
    lowest = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    order = ("_h", "doc_id", "_t")
    w = Window.partitionBy("lang").orderBy(*order)
    narrow = usable.where(F.col("_h").cast("double") <= F.element_at(lowest, F.col("lang"))).select("doc_id", "lang", "_h", F.xxhash64("text").alias("_t")).distinct()
    chosen = narrow.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_language).select("doc_id", "lang", "_t").distinct()
    own = usable.withColumn("_t", F.xxhash64("text"))
    rows = own.join(F.broadcast(chosen), ["doc_id", "lang", "_t"]).select("doc_id", "lang", "_t", F.encode("text", "UTF-8").alias("bytes"))
    full = F.greatest(F.lit(1), F.floor(F.octet_length("bytes") / STEPS)).cast("int")
    n = F.least(F.lit(windows_per_doc), full)
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.floor((2 * i + 1) * full / (2 * n)) * STEPS + 1).cast("int"))
    windows = F.transform(starts, lambda s: F.substring(F.col("bytes"), s, F.lit(STEPS)))
    rows = rows.select("doc_id", "lang", "_t", windows.alias("windows")).dropDuplicates(["doc_id", "lang", "_t"])
    return sorted((r["lang"], [bytes(w) for w in r["windows"]]) for r in rows.collect())


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC, max_languages: int = MAX_LANGUAGES, **settings) -> Model | None:
    """A model of the languages of ``docs`` (doc_id, text, lang), from its bounded training sample; None if nothing can be learned."""
    import numpy as np

    sample = training_sample(docs, per_language, max_languages, windows_per_doc)
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    data, _, _ = _windows([w for _, windows in sample for w in windows], STEPS)
    return train(data, np.array([number[lang] for lang, windows in sample for _ in windows]), languages, **settings)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score (replaced if there), every column and row kept.

    A text that is null or has no letter is ``und`` with score 0, as is everything without a model.
    The score is the mean probability of the predicted language; of equal ones the first in the alphabet wins.
    Repeated rows are judged each, very long texts whole (a megabyte at a time goes through the network with
    its neighbours), an empty table gives an empty one, and other columns may have any names.
    """
    base = docs.drop("lang_pred", "score")
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    sent, at = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in base.columns].index("text")
    letters = base.withColumn(fresh("letters", base.columns), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        forget_encoders()
        m = sent.value
        for batch in batches:
            texts = [t.encode() if ok else b"" for t, ok in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            p, i = np.zeros((len(texts), len(m.languages))), 0
            while i < len(texts):  # about a megabyte of text at a time
                k, size = i, 0
                while k < len(texts) and (k == i or size + len(texts[k]) <= 1 << 20):
                    size += len(texts[k])
                    k += 1
                p[i:k] = pooled(m, texts[i:k])
                i = k
            p = p.round(6)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            some = np.array([bool(t) for t in texts], bool)
            names = [m.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, p.max(axis=1, initial=0).clip(0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(base.schema.fields).add("lang_pred", StringType()).add("score", DoubleType())
    return letters.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model | None, min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` in a learned language: neither ``und`` nor below ``min_score``.

    Columns as they are, ``lang_pred`` and ``score`` of the input included; null texts and texts without a letter go; without
    a model all rows go; an empty table gives an empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    row = docs.select("text", *([F.struct(*others).alias("input")] if others else []))
    found = predict(row, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return found.select(*[F.col("text") if c == "text" else F.col("input")[c].alias(c) for c in docs.columns])
