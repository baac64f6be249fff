"""Chat formatting in budgeted windows of whole turns. [native]

Prefix sums of turn tokens choose the windows: a turn goes to the window in whose half-budget it
starts, a turn longer than half a budget gets a window of its own. Every window repeats the system
turn and as many of the turns before it as a history budget allows, and masks what it repeats, so
every assistant text is a target exactly once. Tokens are estimated as a quarter of the characters,
unless the turns bring counts of their own (those of ``token_counts``, say).

The template of a turn is ``<s>{number} {flag} {role}\\n{body}</s>``: flag n is a new turn, h repeated
history, s the repeated system turn; the body is the text of an assistant, else ``[INST] {text} [/INST]``.
Texts are escaped: a backslash becomes ``\\0``, and in each of the four control strings the first
character becomes ``\\1`` (for ``<``) or ``\\2`` (for ``[``); a line feed in a role becomes ``\\3``. So
control strings in a formatted text are marks, and every text is read back as it was.

A conversation is numbered and summed in runs of ``RUN`` turn numbers, to which the totals of the runs
before are added, and its windows are found by an equi-join on bins of its prefix sums: a very long
conversation is many keys in both. Only what ``read_back`` puts together, one value for each
conversation, and rows that share one turn number meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

BUDGET, HISTORY = 512, 128
#: Turn numbers of a conversation that one task numbers and sums, and keys over which its windows meet the system turn.
RUN, SALTS = 1_024, 8
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_MARK = {"<": "\\1", "[": "\\2"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(_MARK[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts an escape; the backslash itself is put back last."""
    for c, mark in _MARK.items():
        text = F.replace(text, F.lit(mark), F.lit(c))
    text = F.replace(text, F.lit("\\3"), F.lit("\n"))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def _tokens(chars: Column) -> Column:
    return F.floor((chars + 3) / 4).cast("long")


def _with_totals(rows: DataFrame, order: list[str], sums: dict[str, Column], least: dict[str, Column]) -> DataFrame:
    """``rows`` (c, part, ...) with, for each of ``sums``, its sum over all rows of the conversation before this one, and for
    each of ``least`` its minimum over the conversation. Rows are added up within their part; the totals of the parts
    before, one row a part, are added to that."""
    totals = rows.groupBy("c", "part").agg(*[F.sum(x).alias(n) for n, x in sums.items()], *[F.min(x).alias(n) for n, x in least.items()])
    every = Window.partitionBy("c")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("c").alias("c2"), F.col("part").alias("part2"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.min(n).over(every).alias(n) for n in least]
    )
    inside = Window.partitionBy("c", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({n: F.coalesce(F.sum(x).over(inside), F.lit(0)) for n, x in sums.items()})
    met = summed.join(offsets, (F.col("c") == F.col("c2")) & (F.col("part") == F.col("part2")))
    return met.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop("c2", "part2", *[f"{n}_before" for n in sums])


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """conv_id, window, text, loss (array of start and length in code points of ``text``), n_new, tokens, over_budget.

    ``turns`` has conv_id, turn, role, text; other columns are ignored, but for the one that ``tokens`` may name: the tokens
    of each text, in place of a quarter of its characters. Null roles and texts are
    empty, null conv_ids are one conversation, rows of a conversation are ordered by turn (null
    first), role and text, and repeated rows are turns like any other. No text is ever cut: a turn
    that alone exceeds the budget makes a window that says ``over_budget``. An empty table gives no rows.
    """
    rows = turns.select(
        F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"),
        *([F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("counted")] if tokens else []),
    )
    assistant = F.col("role") == "assistant"
    rows = rows.withColumn("part", F.struct(F.floor(F.col("turn") / RUN).alias("part")))
    numbered = _with_totals(rows, ["turn", "role", "raw"], {"number": F.lit(1).cast("long")}, {}).withColumn("number", (F.col("number") + 1).cast("int"))
    numbered = numbered.withColumn("body", escape(F.col("raw")))
    numbered = numbered.withColumns(
        {
            "role_text": F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\3")),
            "assistant": assistant,
            "body": F.when(assistant, F.col("body")).otherwise(F.concat(F.lit("[INST] "), "body", F.lit(" [/INST]"))),
        }
    )
    around = F.length("role_text") + F.length(F.col("number").cast("string")) + 11
    size = F.col("counted") + _tokens(around + F.when(assistant, 0).otherwise(len("[INST]  [/INST]"))) if tokens else _tokens(F.length("body") + around)
    numbered = stored(numbered.withColumn("size", size).drop("raw"), "turns")
    system = F.when(F.col("role") == "system", F.struct("number", "size"))
    placed = _with_totals(numbered, ["number"], {"start": F.col("size")}, {"system": system})
    placed = placed.withColumn("half", F.greatest(F.lit(16), F.floor((F.lit(budget - history) - F.coalesce("system.size", F.lit(0))) / 2)))
    placed = stored(_with_totals(placed, ["number"], {"large_before": (F.col("size") > F.col("half")).cast("long")}, {}), "placed-turns")
    # ascending with the number: turns of one window have all three in common
    placed = placed.withColumn("span", F.struct(F.floor(F.col("start") / F.col("half")).alias("bin"), "large_before", (F.col("size") > F.col("half")).alias("large")))
    keep = ["c", "number", "body", "role_text", "assistant", "size", "start"]
    new = placed.select(*keep, "span", F.lit("n").alias("flag"))

    heads = placed.groupBy("c", "span").agg(F.min("start").alias("from"), F.min("number").alias("first"), F.max("system").alias("system"))
    bins = heads.withColumn("near", F.explode(F.array(F.floor(F.col("from") / history) - 1, F.floor(F.col("from") / history))))
    binned = placed.select(*keep, F.floor(F.col("start") / history).alias("near"))
    again = binned.join(bins.select(F.col("c").alias("c2"), "span", "from", "first", "system", F.col("near").alias("near2")), (F.col("c") == F.col("c2")) & (F.col("near") == F.col("near2")))
    again = again.where("number < first and from - start <= " + str(history)).where("system is null or system.number <> number")
    again = again.select(*keep, "span", F.lit("h").alias("flag"))
    told = placed.where("system.number = number").select(*keep)
    later = heads.where("system.number < first").select(F.col("c").alias("c2"), "span")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = later.withColumn("salt2", F.pmod(F.xxhash64("span"), F.lit(SALTS)).cast("int"))
    told = told.join(later, (F.col("c") == F.col("c2")) & (F.col("salt") == F.col("salt2"))).select(*keep, "span", F.lit("s").alias("flag"))

    head = F.concat(F.lit("<s>"), F.col("number").cast("string"), F.lit(" "), "flag", F.lit(" "), "role_text", F.lit("\n"))
    pieces = new.union(again).union(told).withColumns({"head": head}).withColumn("piece", F.concat("head", "body", F.lit("</s>")))
    earlier = Window.partitionBy("c", "span").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)))
    target = F.when((F.col("flag") == "n") & F.col("assistant"), F.struct((F.col("at") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    windows = pieces.groupBy("c", "span").agg(
        F.array_sort(F.collect_list(F.struct("number", "piece"))).alias("parts"),
        F.array_sort(F.collect_list(target)).alias("loss"),
        F.count_if(F.col("flag") == "n").alias("n_new"),
        F.min(F.when(F.col("flag") == "n", F.col("number"))).alias("window"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    out = windows.select(F.col("c.conv_id").alias("conv_id"), F.col("window").cast("long").alias("window"), text.alias("text"), "loss", "n_new")
    return out.withColumn("tokens", _tokens(F.length("text"))).withColumn("over_budget", F.col("tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: conv_id, n_turns, turns (role, line feed, text, line feed of each
    turn), loss_text (all text under the loss mask), formatted_chars. Empty texts and repeated turns come back as they were;
    a null conv_id is one conversation; no windows give no rows."""

    def turn(part: Column) -> Column:
        header = F.substring_index(part, "\n", 1)
        role = unescape(F.regexp_replace(header, r"^\d+ [a-z] ", ""))
        body = F.substring(part, F.length(header) + 2, F.length(part) - F.length(header) - 1 - len("</s>"))
        inner = F.when(role == "assistant", body).otherwise(F.substring(body, F.lit(len("[INST] ") + 1), F.length(body) - len("[INST]  [/INST]")))
        return F.concat(role, F.lit("\n"), unescape(inner), F.lit("\n"))

    parts = F.filter(F.split("text", "<s>"), lambda p: p.rlike(r"^\d+ n "))
    told = windows.select(
        "conv_id", "window", F.size(parts).alias("n"), F.length("text").alias("chars"),
        F.array_join(F.transform(parts, turn), "").alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "").alias("loss"),
    )
    each = told.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    join = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return each.select("conv_id", "n_turns", join("turns").alias("turns"), join("loss").alias("loss_text"), "formatted_chars")
