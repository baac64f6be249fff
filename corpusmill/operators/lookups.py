"""Routing of questions to documents and deterministic answers from metadata, as joins over all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as T


def asked_cases(questions: DataFrame) -> DataFrame:
    """(qid, question, answer_type, case_id, ord): the cases a question names, in order."""
    return questions.select("qid", "question", "answer_type", F.posexplode(T.case_ids(F.col("question"))).alias("ord", "case_id"))


def with_documents(asked: DataFrame, case_docs: DataFrame) -> DataFrame:
    """Asked cases with all their documents. The join key is a case, so a case that many questions name can be split."""
    return asked.join(case_docs, "case_id")


def first_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extreme_case(asked: DataFrame, values: DataFrame, value: str, largest: bool) -> DataFrame:
    """(qid, answer): the case with the smallest or largest value, if every asked case (two or more) has one; the first named wins ties."""
    cases = asked.groupBy("qid").agg(F.count_distinct("case_id").alias("n_cases"))
    best = F.max if largest else F.min
    per_case = asked.join(values, "case_id").groupBy("qid", "case_id", "ord").agg(best(value).alias("v")).where("v is not null")
    sign = F.col("v").desc() if largest else F.col("v").asc()
    whole = per_case.groupBy("qid").agg(F.count("*").alias("n_valued")).join(cases, "qid").where("n_valued = n_cases and n_cases >= 2").select("qid")
    return first_of(per_case.join(whole, "qid"), ["qid"], sign, F.col("ord")).select("qid", F.col("case_id").alias("answer"))


def normalized_judge(name: Column) -> Column:
    """A judge's name without titles, lower-cased."""
    bare = F.regexp_replace(name, r"(?i)\b(?:H\.E\.|Justice|Chief|Deputy|Sir|Dr|KC)\b\.?", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def shared(asked: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(qid, answer): whether two asked cases have a value of ``name`` in common. Values meet by equality, so no pairs of documents arise."""
    held = asked.join(names, "case_id").select("qid", "case_id", name).distinct()
    two = held.groupBy("qid").agg(F.count_distinct("case_id").alias("n")).where("n = 2")
    common = held.groupBy("qid", name).agg(F.count("*").alias("k")).groupBy("qid").agg((F.max("k") > 1).alias("answer"))
    return two.join(common, "qid").select("qid", "answer")


def claim_comparison(asked: DataFrame, claims: DataFrame, largest: bool) -> DataFrame:
    """(qid, answer): of two asked cases the one with the larger (or smaller) claim, if both have a claim above nothing and the
    two are in one currency; the first named on ties. ``claims`` has case_id, doc_ord, claim_value, currency."""
    best = claims.where("claim_value > 0").groupBy("case_id").agg(F.max_by(F.struct("claim_value", "currency"), F.struct("claim_value", -F.col("doc_ord"))).alias("c"))
    cases = asked.groupBy("qid").agg(F.count_distinct("case_id").alias("n_cases"))
    held = asked.select("qid", "case_id", "ord").join(best, "case_id").select("qid", "case_id", "ord", "c.claim_value", "c.currency")
    both = held.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("currency").alias("currencies")).join(cases, "qid").where("n = 2 and n_cases = 2 and currencies = 1").select("qid")
    order = F.col("claim_value").desc() if largest else F.col("claim_value").asc()
    return first_of(held.join(both, "qid"), ["qid"], order, F.col("ord")).select("qid", F.col("case_id").alias("answer"))


def parties_overlap(asked: DataFrame, parties: DataFrame, long: int = 8) -> DataFrame:
    """(qid, answer): whether two asked cases have a party in common: equal names, or one contained in the other if both have
    more than ``long`` letters. ``parties`` has case_id, party."""
    sets = asked.select("qid", "case_id", "ord").join(parties.distinct(), "case_id").groupBy("qid", "ord").agg(F.collect_set("party").alias("names"))
    sides = sets.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "names"))).alias("s")).where(F.size("s") == 2)
    names = sides.select("qid", F.get("s", F.lit(0))["names"].alias("a"), F.get("s", F.lit(1))["names"].alias("b"))
    alike = lambda x, y: (F.length(x) > long) & (F.length(y) > long) & (F.contains(x, y) | F.contains(y, x))
    return names.select("qid", (F.arrays_overlap("a", "b") | F.exists("a", lambda x: F.exists("b", lambda y: alike(x, y)))).alias("answer"))


# Words of a question that compare two cases.
DATE_WORDS, EARLY_WORDS = ["earlier", "later", "more recent", "first issued", "before", "after"], ["earlier", "first", "before"]
CLAIM_WORDS = ["higher claim", "larger claim", "more claimed", "greater amount", "higher amount", "larger amount", "bigger"]
COUNT_WORDS = ["more defendant", "more claimant", "fewer defendant", "fewer claimant"]


def compared_cases(asked: DataFrame, first_docs: DataFrame) -> DataFrame:
    """(qid, answer): of two asked cases the one that the question's comparison names, by date, claim or number of defendants of
    their first documents; the second on ties. ``first_docs`` has case_id, date_of_issue, claim_value, n_defendants."""
    held = asked.join(first_docs, "case_id").groupBy("qid", "question").agg(F.array_sort(F.collect_list(F.struct("ord", "case_id", "date_of_issue", "claim_value", "n_defendants"))).alias("s")).where(F.size("s") == 2)
    a, b, low = F.get("s", F.lit(0)), F.get("s", F.lit(1)), F.lower("question")
    first = lambda wins: F.when(wins, a["case_id"]).otherwise(b["case_id"])
    less, more = (lambda c: a[c] < b[c]), (lambda c: a[c] > b[c])
    by_date = F.when(T.contains_any(low, EARLY_WORDS), first(less("date_of_issue"))).otherwise(first(more("date_of_issue")))
    by_count = F.when(F.contains(low, F.lit("fewer")), first(less("n_defendants"))).otherwise(first(more("n_defendants")))
    answer = F.when(T.contains_any(low, DATE_WORDS), by_date).when(T.contains_any(low, CLAIM_WORDS), first(more("claim_value"))).when(T.contains_any(low, COUNT_WORDS), by_count)
    return held.select("qid", answer.alias("answer")).where("answer is not null")


def metadata_page(kind: Column) -> Column:
    """The page of a case document that shows a kind of metadata: parties stand on the first, the others where the index says."""
    told = {"date_of_issue": F.col("date_page"), "claim_value": F.col("claim_page"), "judge": F.col("judge_page"), "parties": F.lit(1), "outcome": F.col("outcome_page")}
    return F.coalesce(*[F.when(kind == name, page) for name, page in told.items()])


def question_of_regulations(question: Column) -> Column:
    return question.rlike(P.THESE_REGULATIONS) & (F.size(T.case_ids(question)) == 0)


def amendment_routes(routed: DataFrame, laws: DataFrame) -> DataFrame:
    """(qid, doc, page): for routed questions (qid, question, doc) about amendments, the first pages of all known laws not routed yet."""
    own = routed.where(F.lower("question").rlike(P.AMENDING)).groupBy("qid").agg(F.collect_set("doc").alias("own"))  # of one question
    every = own.join(F.broadcast(laws.select("doc").distinct())).where(~F.array_contains("own", F.col("doc")))
    return every.select("qid", "doc", F.lit(1).alias("page"))
