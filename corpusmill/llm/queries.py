"""The registered queries of the operators, one ``opN_<name>`` for each, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chat, codebooks, decontamination, language_id, minhash, packing, set_join, simhash, spelling, token_counts, token_file, url_filter, warc
from corpusmill.llm.common import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 6: URL filters

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under ``URL_RULES``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_url_filter"] = f"""
WITH rules(verdict, host, path) AS (VALUES {', '.join(map(str, URL_RULES))}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
         FROM parts p LEFT JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


# -- 2, 3, 7: token ids (SQL has no tokenizers; tests hold them against the library)


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as directly addressable codes, written and read back."""
    path = shared_dir(spark, "token-files")
    token_file.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_file.token_spans(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


# -- 8: SimHash near-duplicates (SQL has no XXH64 here; tests hold it against all pairs)


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- 9: benchmark decontamination (tests hold it against a word-by-word comparison at every shift)


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the item and the overlap."""
    return decontamination.find_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# -- 1: language ID (tests: gradients, held-out accuracy)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


# -- 10: chat formatting

EXTRA_TURNS = "</s>[INST] ok [/INST]"


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that consists of control strings, formatted and read back."""
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{EXTRA_TURNS}'), (-1L, 1L, 'assistant', '{EXTRA_TURNS}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = chat.read_back(chat.format_windows(turns))
    digest = lambda c: F.sha2(F.col(c), 256)
    return back.select(
        "conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        digest("loss_text").alias("loss_sha256"), "formatted_chars",
    )


_ESCAPED = r"replace(replace(replace(replace(replace({}, '\', '\0'), '<s>', '\1s>'), '</s>', '\1/s>'), '[INST]', '\2INST]'), '[/INST]', '\2/INST]')"
ORACLES["op10_chat"] = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS raw FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '{EXTRA_TURNS}'), (-1, 1, 'assistant', '{EXTRA_TURNS}')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw) AS number FROM turns),
sized AS (SELECT *, (length({_ESCAPED.format('raw')}) + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END)
                 + length(replace({_ESCAPED.format('role')}, chr(10), '\\3')) + length(number::VARCHAR) + 11 AS chars FROM numbered),
tokens AS (SELECT *, (chars + 3) // 4 AS size, min(CASE WHEN role = 'system' THEN number END) OVER (PARTITION BY conv_id) AS system FROM sized),
halved AS (SELECT *, greatest(16, ({chat.BUDGET - chat.HISTORY} - coalesce(max(CASE WHEN number = system THEN size END) OVER (PARTITION BY conv_id), 0)) // 2) AS half FROM tokens),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                  coalesce(sum((size > half)::INT) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS large FROM halved),
spans AS (SELECT conv_id, start // half AS bin, large, size > half AS own, min(start) AS s, min(number) AS f, max(system) AS system FROM placed GROUP BY ALL),
repeats AS (SELECT w.conv_id, sum(t.chars) AS chars FROM spans w JOIN placed t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.number < w.f
            AND (t.number = w.system OR w.s - t.start <= {chat.HISTORY}) GROUP BY w.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || raw || chr(10), '' ORDER BY number)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(raw) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN raw END, '' ORDER BY number), '')) AS loss_sha256,
       (sum(placed.chars) + coalesce(max(r.chars), 0))::BIGINT AS formatted_chars
FROM placed LEFT JOIN repeats r USING (conv_id) GROUP BY conv_id
"""


# -- 5: WARC


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    back = warc.read_archives(spark, path)
    of_payload = lambda own, told: F.when(F.col("record_type") == "response", own).otherwise(told)
    return back.select(
        "page_id",
        of_payload(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        of_payload(warc.base32_sha1(F.col("payload")), F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


_BASE32 = " || ".join(f"to_base(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8))
ORACLES["op5_warc"] = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM hashed)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM grouped
"""


# -- 4: document fingerprints (SQL has no XXH64 here; tests hold them against the definition)


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts."""
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


# -- 11: vector code compression


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as 16 codes of 64 entries each, after two rounds of training."""
    found = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes(books: str) -> str:
    """Every part with its nearest entry: distance times 64 plus entry, so that the least is the nearest and then the lowest."""
    apart = " + ".join(f"(x.c{i} - b.c{i}) * (x.c{i} - b.c{i})" for i in range(1, 5))
    return f"SELECT x.rn, x.p, min(({apart}) * 64 + b.e) AS k FROM cut x JOIN {books} b USING (p) GROUP BY x.rn, x.p"


def _moved(books: str, codes: str) -> str:
    mean = "CASE WHEN m.n IS NULL THEN b.c{0} ELSE (m.s{0} - ((m.s{0} % m.n) + m.n) % m.n) // m.n END AS c{0}"
    sums = ", ".join(f"sum(x.c{i})::BIGINT AS s{i}" for i in range(1, 5))
    return f"""SELECT b.p, b.e, {', '.join(mean.format(i) for i in range(1, 5))} FROM {books} b LEFT JOIN
        (SELECT x.p, k.k % 64 AS e, count(*) AS n, {sums} FROM cut x JOIN {codes} k USING (rn, p) GROUP BY ALL) m USING (p, e)"""


ORACLES["op11_vector_codes"] = f"""
WITH whole AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn FROM whole),
cut AS MATERIALIZED (SELECT rn, p, v[4 * p + 1] AS c1, v[4 * p + 2] AS c2, v[4 * p + 3] AS c3, v[4 * p + 4] AS c4 FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, c1, c2, c3, c4 FROM cut WHERE rn <= 64),
k0 AS MATERIALIZED ({_codes('b0')}), b1 AS MATERIALIZED ({_moved('b0', 'k0')}),
k1 AS MATERIALIZED ({_codes('b1')}), b2 AS MATERIALIZED ({_moved('b1', 'k1')}),
k2 AS MATERIALIZED ({_codes('b2')}),
coded AS (SELECT rn, string_agg(printf('%02x', k % 64), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM k2 GROUP BY rn),
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
          FROM (SELECT p, e, unnest([1, 2, 3, 4]) AS i, unnest([c1, c2, c3, c4]) AS c FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rn), books
"""


# -- 12: documents with alike sets of shingles


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles are alike in 0.9."""
    return set_join.similar_sets(table(spark, sf_dir, "documents"))


ORACLES["op12_jaccard_join"] = r"""
WITH RECURSIVE cut AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM cut),
classes AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS least, row_number() OVER () AS c FROM sets WHERE len(s) > 0 GROUP BY 1),
held AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
links AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM held a JOIN held b ON a.x = b.x AND a.c <> b.c AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
          GROUP BY a.c, b.c HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))),
reached AS (SELECT c, least FROM classes UNION SELECT l.b, r.least FROM reached r JOIN links l ON l.a = r.c)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
FROM sets s LEFT JOIN classes k ON list_sort(s.s) = k.s LEFT JOIN (SELECT c, min(least) AS component_id FROM reached GROUP BY c) m USING (c)
"""


# -- 13: spelling variants (SQL has no CRC-32 here; tests hold them against all pairs)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts with their near words and the form they are a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
