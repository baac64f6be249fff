"""Rules and operators against plain Python on small inputs."""

import difflib
import json

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import answers as A
from corpusmill.functions import models
from corpusmill.functions import text as T
from corpusmill.operators import retrieval as R
from corpusmill.operators.order import running_total
from corpusmill.plans.evaluation_queries import rouge_l
from corpusmill.plans.fixtures import Inputs
from corpusmill.sources import files


def test_running_total(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) if k < 40 else None, i, int(a)) for i, (k, a) in enumerate(zip(rng.integers(0, 45, 500), rng.integers(0, 9, 500)))]
    df = spark.createDataFrame(rows, "key long, id long, amount long").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert {r.id: r.position for r in running_total(df, "key", "id").collect()} == {r[1]: i + 1 for i, r in enumerate(ordered)}
    total, want = 0, {}
    for _, i, a in ordered:
        total += a
        want[i] = total
    assert {r.id: r.s for r in running_total(df, "key", "id", amount=F.col("amount"), out="s").collect()} == want
    assert running_total(df.where("false"), "key", "id").count() == 0


def test_dense_top_k(spark):
    rng = np.random.default_rng(2)
    units, asked = rng.standard_normal((300, 8)), rng.standard_normal((11, 8))
    u = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)] + [(900, units[0].tolist())], "unit long, v array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, v array<float>")
    for block in (2_000, 3):
        got = {}
        for r in R.dense_top_k(q, u, "qid", "unit", "v", 10, block).collect():
            got.setdefault(r.qid, []).append((r.rank, r.unit))
        f = lambda x: x.astype("f4").astype(float)
        scores = f(asked) @ np.concatenate([f(units), f(units[:1])]).T
        names = [*range(300), 900]
        for i in range(11):
            best = sorted(range(301), key=lambda j: (-round(scores[i, j], 9), names[j]))[:10]
            assert [x for _, x in sorted(got[i])] == [names[j] for j in best]
    assert R.dense_top_k(q.where("false"), u, "qid", "unit", "v", 3).count() == 0


def one(spark, column, **values):
    names = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_foreign_concepts(spark):
    q, s = F.col("q"), F.col("s")
    for text, source, want in (
        ("What was awarded for the injury?", "", False), ("What was awarded for the injury?", "the injury", False), ("Was a jury used?", "x", True), ("Was a jury used in CFI 010/2024?", "x", False),
        ("Was imprisonment ordered in CFI 010/2024?", "x", True), ("When was the verdict given?", "costs only", True), ("When was the verdict given?", "the verdict of", False), ("When was the verdict given?", "", False),
    ):
        assert one(spark, T.is_foreign(q, s), q=text, s=source) is want, text


def test_pages_that_questions_name(spark):
    page = T.page_override(F.col("q"), F.col("n"), F.lit(True))
    for text, n, want in (("page 7 of the judgment", 3, 7), ("the last page", 4, 4), ("the second page", 1, None), ("title page, then the third page", 3, 3), ("official number", 5, 1), ("nothing", 5, None)):
        assert one(spark, page, q=text, n=n) == want, text


def test_answer_keywords(spark):
    words = A.answer_keywords(F.col("a"), F.col("t"))
    for answer, kind, want in (
        ("50000.0", "number", ["50000.0", "50000", "50,000"]), ("2024-01-05", "date", ["2024-01-05", "05 January 2024", "05 Jan 2024", "January 05, 2024", "5 January 2024", "05/01/2024"]),
        ("A, B", "names", ["A", "B"]), ("null", "name", []), ("true", "boolean", []), ("The duty, the Duty of care", "free_text", ["duty", "care"]),
    ):
        assert one(spark, words, a=answer, t=kind) == want, answer


def test_rouge_l(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    text = {r.item_id: r.text.split() for r in t.table("benchmark").collect()}
    for r in rouge_l(t).collect():
        a, b = text[r.item_id], text[r.item_id + 1]
        n = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert abs(r.score - 2 * n / (len(a) + len(b))) < 1e-12


def test_failures_of_a_responder_are_told(spark):
    def broken(prompts):
        raise ValueError("no answer")

    row = models.respond(spark.createDataFrame([("p",)], "prompt string"), "prompt", broken, attempts=2).first()
    assert row.response is None and row.response_error == "ValueError: no answer" and row.response_attempts == 2


def test_labelled_dataset(spark, tmp_path):
    for name, content in (("a.json", {"documents": [1]}), ("b.json", {"documents": [1, 2], "labels": [3]}), ("c.json", {"documents": [9], "labels": [9]})):
        (tmp_path / name).write_text(json.dumps(content))
    row = files.labelled_dataset(spark, str(tmp_path), "array<int>", "array<int>").first()
    assert row.file.endswith("b.json") and row.documents == [1, 2] and row.labels == [3]
