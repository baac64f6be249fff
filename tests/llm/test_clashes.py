"""Columns of the input with names that operators use inside: none is lost, none is in the way."""

from corpusmill.llm import decontamination, language_id, simhash, url_filter

NAMES = ["_h", "_p", "_best", "_letters", "letters", "_row", "_copy", "_keep_id", "row", "copy", "id", "input", "keep_id", "keep_row", "component_id", "lang_pred", "score", "v", "none", "_d", "_key"]
FIELDS = ", ".join(f"`{n}` int" for n in NAMES)
VALUES = tuple(range(len(NAMES)))


def same(df, kept=NAMES):
    return all(tuple(r[n] for n in kept) == tuple(VALUES[NAMES.index(n)] for n in kept) for r in df.collect())


def documents(spark):
    text = "the cat and the dog and the bird sang in the old house by the river all day"
    return spark.createDataFrame([(i, text + f" {i}" * (i % 2), "en", *VALUES) for i in range(8)] + [(None, None, None, *VALUES)], "doc_id long, text string, lang string, " + FIELDS)


def test_documents(spark):
    docs = documents(spark)
    model = language_id.fit(docs, epochs=1)
    plain = [n for n in NAMES if n not in ("lang_pred", "score")]
    found = language_id.predict(docs, model)
    assert found.count() == 9 and same(found, plain)
    kept = language_id.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 8 and same(kept)
    one = simhash.deduplicated(docs, rounds=2)
    assert one.columns == docs.columns and one.count() >= 2 and same(one)
    bench = spark.createDataFrame([(1, "w " * 20)], "item_id long, text string")
    clean = decontamination.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 9 and same(clean)


def test_urls(spark):
    urls = spark.createDataFrame([("http://a.com/en/x", *VALUES), (None, *VALUES)], "url string, " + FIELDS)
    for rules in ([("block", "com", "/en/")], []):
        table = spark.createDataFrame(rules, "verdict string, host string, path string")
        for most in (20_000, 0):
            got = url_filter.judge_urls(urls, table, broadcast_rules=most)
            assert got.count() == 2 and same(got) and set(got.columns) == {"url", *NAMES, "host", "path", "rule", "verdict"}


def test_names_in_another_case(spark):
    urls = spark.createDataFrame([("http://a.com/en/x", 1, 2)], "url string, HOST int, Rule int")
    got = url_filter.judge_urls(urls, spark.createDataFrame([("block", "com", "/en/")], "verdict string, host string, path string"))
    assert [(r.host, r.rule, r.verdict) for r in got.select("host", "rule", "verdict").collect()] == [("a.com", "com/en/", "block")]
    docs = spark.createDataFrame([(i, "der Hund und die Katze und das Haus " + "x" * i, "de") for i in range(6)], "DOC_ID long, Text string, lang string")
    model = language_id.fit(docs, epochs=1)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"de"}
