"""Which questions metadata answers, told from one row for each case, against the lookups themselves."""

import random
from functools import reduce

from corpusmill import catalog
from corpusmill.plans import routing_queries as Q
from corpusmill.plans.fixtures import Inputs
from tests.compare import differences


def tables(spark, folder, undated):
    rng = random.Random(3)
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put([(i, "N") for i in range(3)], "n_nationkey int, n_name string", "nation")
    put([(i, f"s{i}", i % 4) for i in range(6)], "s_suppkey long, s_name string, s_nationkey int", "supplier")  # one nation is unknown
    put([(i, f"c{i}") for i in range(5)], "c_custkey long, c_name string", "customer")
    spark.sql("SELECT id AS o_orderkey, id % 6 AS o_custkey, timestamp'1995-03-01' AS o_orderdate FROM range(240)").write.parquet(f"{folder}/orders.parquet")
    lines = [(o, n * 10 + rng.randrange(9), rng.randrange(7), rng.randrange(2), rng.choice([-1.0, 0.0, 5.0, 9.0]), rng.choice(["A", "R", None]), None if undated and rng.random() < 0.6 else n) for o in range(240) for n in range(rng.choice([0, 1, 2, 6]))]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, d int")
    df.selectExpr("* except (d)", "1.0D AS l_quantity", "0.0D AS l_discount", "0.0D AS l_tax", "'F' AS l_linestatus", "timestamp'1995-05-01' + make_interval(0, 0, 0, d) AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")


def test_answered_as_by_the_lookups(spark, tmp_path):
    """Equal claims in two currencies, claims of nothing, unknown customers, suppliers and nations, cases without documents or dates."""
    for name in ("dated", "undated"):
        tables(spark, f"{tmp_path}/{name}", name == "undated")
        t = Inputs(spark, f"{tmp_path}/{name}")
        want = {r.qid for r in reduce(lambda a, b: a.union(b), [f(t).select("qid") for f in Q._LOOKUPS]).collect()}
        assert {r.qid for r in Q._answered(t).collect()} == want and 40 < len(want) < 200
    for query in ("answer_path", "oracle_coverage"):
        assert differences(catalog.queries()[query](spark, f"{tmp_path}/dated"), catalog.oracle_sql()[query], f"{tmp_path}/dated") == ""


def test_cases_meet_questions_once(spark, tmp_path):
    """Lines are read again for cases with equal claims only, and neither questions nor documents are made for each lookup."""
    tables(spark, str(tmp_path), False)
    found = catalog.queries()["answer_path"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_extendedprice" in line]
    assert "Window" not in plan and len(scans) == 1
