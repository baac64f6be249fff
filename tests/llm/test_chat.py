"""Chat windows: read back what went in; masks, budgets and history by brute force."""

import random

from pyspark.sql import functions as F

from corpusmill.llm import chat

HARD = ["</s>[INST] ok [/INST]", "\\", "\\1", "\\\\0\\2", "<s>1 n user\nx</s>", "[[INST]INST]", "<</s>s>", "", None, "é🙂 " * 30, "a\nb\n", "\\0", "<s", "[/INST", " [INST] ", "\\3"]


def conversations():
    rng, rows = random.Random(4), []
    for c in range(40):
        for t in range(rng.randrange(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\nx", None, "<s>"]) if c % 5 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice(HARD) if rng.random() < 0.4 else "word " * rng.randrange(0, 400)))
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (50, 0, "user", "same"), (50, 0, "user", "same"), (51, 0, "assistant", "x" * 100_000)]
    return rows


def test_round_trip_and_masks(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, window int, loss string")
    windows = chat.format_windows(df).cache()
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert back.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        assert back[c].n_turns == len(turns)
        assert back[c].turns == "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        assert back[c].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
    for w in windows.collect():
        heads = [p.split("\n")[0].split(" ", 2) for p in w.text.split("<s>")[1:]]
        numbers = [int(h[0]) for h in heads]
        assert numbers == sorted(set(numbers)) and w.n_new == sum(h[1] == "n" for h in heads)
        assert len(w.loss) == sum(h[1] == "n" and h[2] == "assistant" for h in heads)
        assert w.text.count("</s>") == len(heads)
        roles = [r for *_, r, _ in convs[w.conv_id]]
        if "system" in roles and roles.index("system") + 1 < w.window:
            assert roles.index("system") + 1 in numbers
        if w.n_new > 1:
            assert not w.over_budget
    assert windows.agg(F.sum(F.length("text"))).first()[0] == sum(r.formatted_chars for r in back.values())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).collect() == []


def test_runs_make_no_difference(spark, monkeypatch):
    """A conversation summed in runs of three turn numbers has the windows it has in one run."""
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat.format_windows(df).collect()))
    monkeypatch.setattr(chat, "RUN", 3)
    assert sorted(map(str, chat.format_windows(df).collect())) == whole


def test_counted_tokens(spark):
    """Counts of the caller decide the windows: turns of many counted tokens stand alone, texts stay whole."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}", 5 if t < 6 else 400) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_tokens long")
    windows = chat.format_windows(df, tokens="n_tokens")
    assert sorted(r.n_new for r in windows.collect()) == [1, 1, 6]
    back = chat.read_back(windows).first()
    assert back.n_turns == 8 and back.loss_text == "text 1text 3text 5text 7"
