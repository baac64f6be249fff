"""Views over the test tables that stand for the engine's inputs, in one SQL text for both engines where that is possible."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.matching import containing
from corpusmill.storage import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels")

PAGES_SPARK = """
SELECT doc_id, p AS page, array_join(slice(split(text, '\\n'), (p-1)*4+1, 4), '\\n') AS text
FROM (SELECT doc_id, text, explode(sequence(1, CAST(ceil(size(split(text, '\\n'))/4.0) AS INT))) AS p FROM {documents})
"""
PAGES_DUCK = """
SELECT doc_id, CAST(p AS INTEGER) AS page, array_to_string(list_slice(string_split(text, chr(10)), (p-1)*4+1, p*4), chr(10)) AS text
FROM (SELECT doc_id, text, unnest(range(1, CAST(ceil(len(string_split(text, chr(10)))/4.0) AS BIGINT)+1)) AS p FROM {documents})
"""

_CASE = "concat('CFI ', CASE WHEN o_orderkey < 100 THEN lpad(CAST(o_orderkey AS STRING), 3, '0') ELSE CAST(o_orderkey AS STRING) END, '/', CAST(year(o_orderdate) AS STRING))"
_SHORT = "SELECT o_orderkey, concat('CFI ', CAST(o_orderkey AS STRING), '/', CAST(year(o_orderdate) AS STRING)) AS c FROM {orders}"

_TITLE = "concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2), ' ', substr(p_type, 1, 1), lower(substr(p_type, 2)), ' Law')"
_LAWS = f"""
SELECT p_partkey AS doc_id, concat(p_name, ' ', lower(p_type), ' law') AS name, {_TITLE} AS title, p_partkey % 12 + 1 AS number, 2004 + p_size % 16 AS year,
  concat(substr(p_name, 1, 1), substr(split_part(p_name, ' ', 2), 1, 1), lower(substr(p_type, 1, 1)), ' law') AS abbreviation FROM {{part}}"""
_OF = "concat('DIFC Law No. ', CAST({0}.number AS STRING), ' of ', CAST({0}.year AS STRING))"

BOTH = {
    "laws": _LAWS,
    "law_questions": f"""
SELECT c_custkey AS qid, CASE c_custkey % 10
   WHEN 0 THEN concat('What does Article 7(2)(b) of the DIFC ', a.title, ' ', CAST(a.year AS STRING), ' say of duties?')
   WHEN 1 THEN concat('Does the ', a.title, ' or the ', b.title, ' apply under these Regulations?')
   WHEN 2 THEN concat('What is the official number of the law titled "', upper(a.title), '"?')
   WHEN 3 THEN concat('Is ', {_OF.format('a')}, ' in force? See ''the ', b.title, '''.')
   WHEN 4 THEN concat('What do the ', a.abbreviation, ' Art 12 and Article 3 of ', replace(b.name, ' law', ''), ' require?')
   WHEN 5 THEN concat('What is the date of issue of the ', a.title, ', and which laws does it amend?')
   WHEN 6 THEN concat('What fine does ', replace(a.name, ' law', ''), ' set for a contravention of Article 7?')
   WHEN 7 THEN concat('What was the outcome in {{0}}', {_CASE}, ' under these Regulations and the ', a.title, '?')
   WHEN 8 THEN concat('Which law has the higher award value, the ', a.title, ' or the ', b.title, '? See Article ', CAST(a.number AS STRING), '.')
   ELSE concat('Where does the ', a.title, ' say ''IT IS HEREBY ORDERED THAT'', and when was it enacted?') END AS question,
  CASE c_custkey % 10 WHEN 0 THEN 'free_text' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' WHEN 4 THEN 'names' WHEN 5 THEN 'date' WHEN 6 THEN 'number' WHEN 7 THEN 'free_text' WHEN 8 THEN 'name' ELSE 'free_text' END AS answer_type
FROM {{customer}} JOIN ({_LAWS}) a ON a.doc_id = c_custkey JOIN ({_LAWS}) b ON b.doc_id = c_custkey + 1 JOIN {{orders}} ON o_orderkey = c_custkey""".replace("{0}", ""),
    "lost_questions": f"""
SELECT s_suppkey AS qid, CASE s_suppkey % 5
   WHEN 0 THEN concat('When was the notice on ', split_part(a.name, ' ', 1), ' duties issued?') WHEN 1 THEN concat('Who is the judge of the ', split_part(a.name, ' ', 1), ' appeal?')
   WHEN 2 THEN concat('Which fine is due for a ', split_part(a.name, ' ', 2), '?') WHEN 3 THEN concat('Do Article ', CAST(s_suppkey % 9 + 1 AS STRING), ' and Article 7 both apply where the Registrar acts under Schedule 2?')
   ELSE concat('What does the claimant seek in the ', split_part(a.name, ' ', 2), ' matter?') END AS question,
  CASE s_suppkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'name' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' ELSE 'free_text' END AS answer_type
FROM {{supplier}} JOIN ({_LAWS}) a ON a.doc_id = s_suppkey""".replace("{{", "{").replace("}}", "}"),
    "statutes": f"""
SELECT a.doc_id, n.page, CASE n.page
   WHEN 1 THEN concat('[DOCUMENT: ', CASE WHEN a.doc_id % 7 = 0 THEN 'Court Case' ELSE 'DIFC Law' END, ' | ', a.title, ']', chr(10), upper(a.title), chr(10), upper({_OF.format('a')}), chr(10), CASE WHEN a.doc_id % 4 = 1 THEN 'The ' || lower(a.title) || 's of old are repealed.' ELSE 'Date of Issue: 1 May 2019' END)
   WHEN 2 THEN CASE WHEN a.doc_id % 3 = 1 THEN concat('Enactment notice', chr(10), 'This Law is enacted on its commencement.') ELSE concat('CONTENTS', chr(10), 'Article 1 ..... 2', chr(10), 'Article 2 ..... 3', chr(10), '3. Powers ..... 4') END
   WHEN 3 THEN concat('PART IV', chr(10), 'Article ', CAST(a.doc_id % 9 + 1 AS STRING), ' Scope', chr(10), 'The ', a.title, ' applies to all.', chr(10), '12.', chr(10), 'Powers', chr(10), 'The Registrar acts under Schedule 2 and Article 7(2)(b).', CASE WHEN a.doc_id % 4 = 1 THEN concat(chr(10), 'Date of Issue: 1 May 2019') ELSE '' END)
   WHEN 4 THEN concat('7. Duties of persons', CASE WHEN a.doc_id % 3 = 0 THEN ' ......... 9' ELSE ' under this Law' END, chr(10), chr(10), '  301. Too Large', chr(10), 'Rule 3', chr(10), 'Section 4A', chr(10), 'Regulation 3.1', chr(10), 'APPENDIX 2', chr(10), 'The DIFC ', b.title, ' ', CAST(b.year AS STRING),
     ' and RDC 44.8 apply; see CFI ', lpad(CAST(a.doc_id % 100 AS STRING), 3, '0'), '/', CAST(1992 + a.doc_id % 7 AS STRING), ', Consultation Paper No. 3 of 2019 and ', {_OF.format('b')}, '.')
   WHEN 5 THEN CASE WHEN a.doc_id % 2 = 0 THEN concat('SCHEDULE 2', chr(10), 'CONTRAVENTIONS AND FINES', chr(10), 'A fine of USD 5,000 is due under Article 7.') ELSE concat('SCHEDULE 2', chr(10), 'FORMS', chr(10), 'No money here.') END
   ELSE CASE WHEN a.doc_id % 7 = 0 THEN concat('The Claimant and the Defendant; judgment of the respondent.', chr(10), '1. The claimant seeks costs.', chr(10), 'IT IS HEREBY ORDERED THAT the appeal is dismissed.') ELSE 'The application is granted. The award is AED 1,000,000.' END END AS text
FROM ({_LAWS}) a JOIN ({_LAWS}) b ON b.doc_id = CASE WHEN a.doc_id % 50 = 49 THEN a.doc_id ELSE a.doc_id + 1 END CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS n(page)""",
    "papers": """
SELECT number, year, doc, CASE doc % 5 WHEN 0 THEN 'Proposed new data protection law.' WHEN 1 THEN 'Employment law and employment regulations.' WHEN 2 THEN 'Insolvency and foundations, and a trust law.' WHEN 3 THEN 'A trust law.' ELSE 'Family office, venture studio.' END AS text
FROM (SELECT o_orderkey % 40 AS number, year(o_orderdate) AS year, min(o_orderkey) AS doc FROM {orders} GROUP BY o_orderkey % 40, year(o_orderdate)) AS one""",
    "court_orders": """
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'court' WHEN 1 THEN 'sct' WHEN 2 THEN 'rules_of_court' WHEN 3 THEN 'dra' ELSE 'court' END AS kind, o_orderkey % 50 AS number, year(o_orderdate) AS year, min(o_orderkey) AS doc FROM {orders} GROUP BY 1, 2, 3""",
    "paper_questions": """
SELECT c_custkey AS qid, CASE c_custkey % 7
   WHEN 0 THEN concat('What does Consultation Paper No. ', CAST(c_custkey % 40 AS STRING), ' of ', CAST(1992 + c_custkey % 9 AS STRING), ' propose?')
   WHEN 1 THEN concat('What does consultation paper ', CAST(c_custkey % 40 AS STRING), ' say of the new trust law?')
   WHEN 2 THEN concat('What does Consultation Paper No ', CAST(c_custkey % 40 AS STRING), ' propose?')
   WHEN 3 THEN 'What does the consultation paper "PROPOSED NEW TRUST LAW" say of insolvency?'
   WHEN 4 THEN concat('What did DIFC Courts Small Claims Tribunal Order No. ', CAST(c_custkey % 50 AS STRING), ' of ', CAST(1992 + c_custkey % 7 AS STRING), ' change?')
   WHEN 5 THEN concat('Under the Rules of Court, does Court Order No. ', CAST(c_custkey % 50 AS STRING), ' of ', CAST(1992 + c_custkey % 7 AS STRING), ' or DRA Order No. ', CAST((c_custkey + 3) % 50 AS STRING), ' of ', CAST(1992 + c_custkey % 5 AS STRING), ' apply?')
   ELSE concat('Do Courts Order No ', CAST(c_custkey % 50 AS STRING), ' of ', CAST(1992 + c_custkey % 7 AS STRING), ' and DIFC Courts Rules of Court Order No. ', CAST((c_custkey + 2) % 50 AS STRING), ' of ', CAST(1993 + c_custkey % 6 AS STRING), ' differ?') END AS question FROM {customer}""",
    "case_docs": f"""
SELECT {_CASE} AS case_id,
       o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
              l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS doc_ord,
       concat('H.E. Justice ', n_name) AS judge, CAST(CAST(l_shipdate AS DATE) AS STRING) AS date_of_issue,
       l_linenumber % 3 + 1 AS date_page, CAST(l_partkey % 4 + 1 AS INT) AS claim_page, CAST(l_suppkey % 2 + 1 AS INT) AS judge_page, CASE WHEN l_partkey % 3 = 0 THEN 2 END AS outcome_page, c_name AS claimant, CASE WHEN l_partkey % 20 = 0 THEN concat(c_name, ' LLC') ELSE s_name END AS defendant, CAST(l_suppkey % 3 + 1 AS INT) AS n_defendants, l_extendedprice AS claim_value,
       CASE WHEN l_returnflag = 'A' THEN 'USD' ELSE 'AED' END AS currency
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "questions": f"""
SELECT o.o_orderkey AS qid,
  CASE o.o_orderkey % 6
   WHEN 0 THEN concat(CASE CAST(floor(o.o_orderkey / 6) AS BIGINT) % 4 WHEN 0 THEN 'Which case has an earlier Date of Issue: ' WHEN 1 THEN 'Which case was issued later: '
     WHEN 2 THEN 'Which case has the larger claim amount: ' ELSE 'Which case has more defendants: ' END, o.c, ' or ', p.c, '?')
   WHEN 1 THEN concat('Identify the case with the higher monetary claim: ', o.c, ' or ', p.c, '?')
   WHEN 2 THEN concat('Was the same judge involved in both case ', o.c, ' and case ', p.c, '?')
   WHEN 3 THEN concat('Who is the defendant in case ', o.c, '?')
   WHEN 4 THEN concat('What is the Date of Issue of the document in case ', o.c, '?')
   ELSE concat('Under Article ', CAST(o.o_orderkey % 20 + 1 AS STRING), '(1) of the Employment Law 2019, what was the outcome on page 2?') END AS question,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'boolean' WHEN 3 THEN 'names' WHEN 4 THEN 'date' ELSE 'free_text' END AS answer_type
FROM ({_SHORT}) o JOIN ({_SHORT}) p ON p.o_orderkey = o.o_orderkey + 1""",
    "legal_text": """
SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page,
  concat('In CFI ', lpad(CAST(l_orderkey % 900 + 100 AS STRING), 3, '0'), '/', CAST(2010 + l_suppkey % 15 AS STRING), ', Article ',
   CAST(l_partkey % 40 + 1 AS STRING), '(', CAST(l_suppkey % 9 + 1 AS STRING), ')(a) of DIFC Law No. ', CAST(l_partkey % 12 + 1 AS STRING), ' of ',
   CAST(2004 + l_suppkey % 16 AS STRING), ' and Schedule ', CAST(l_linenumber AS STRING), ' apply; see Regulation ', CAST(l_partkey % 7 + 1 AS STRING), '.',
   CAST(l_suppkey % 5 + 1 AS STRING), '. IT IS HEREBY ORDERED that the claim is dismissed.') AS text
FROM {lineitem}""",
    "loose_pages": """
SELECT o_orderkey AS doc_id, n.page, CASE o_orderkey % 8 + 10 * n.page WHEN 10 THEN 'PART 1. RULES OF THE DUBAI INTERNATIONAL FINANCIAL CENTRE COURTS' WHEN 11 THEN concat('CONSULTATION PAPER NO. 0', CAST(o_orderkey % 40 AS STRING)) WHEN 21 THEN concat(' of March ', CAST(2000 + o_orderkey % 3 AS STRING), ', see CFI 1/2001')
   WHEN 12 THEN concat('Claim No. CFI 0', CAST(o_orderkey % 500 AS STRING), '/2005') WHEN 13 THEN concat('DIFC Law No. (', CAST(o_orderkey % 12 AS STRING), ') of 2008') WHEN 14 THEN 'Roadmap to the Proposed' WHEN 24 THEN 'changes' WHEN 15 THEN '  ' WHEN 25 THEN '' WHEN 16 THEN 'Consultation Paper No 5 of 1999' ELSE 'Other matters' END AS text
FROM {orders} CROSS JOIN (VALUES (1), (2), (3)) AS n(page)""",
    "judge_questions": f"""
SELECT o_orderkey AS qid, concat(CASE o_orderkey % 5 WHEN 0 THEN 'Who was the presiding judge in ' WHEN 1 THEN 'Which judges presided over ' WHEN 2 THEN 'Who was the original judge before ' WHEN 3 THEN 'Who is the claimant in ' ELSE 'Did a judge recuse in ' END, {_CASE}, '?') AS question,
  CASE o_orderkey % 5 WHEN 1 THEN 'names' WHEN 4 THEN 'boolean' ELSE 'name' END AS answer_type FROM {{orders}}""",
    "heading_lines": """
SELECT p_partkey AS n, concat(CASE p_partkey % 14 WHEN 0 THEN 'Article ' WHEN 1 THEN 'ARTICLE ' WHEN 2 THEN '  Article ' WHEN 3 THEN 'Schedule ' WHEN 4 THEN 'Schedule IV ' WHEN 5 THEN 'PART XI ' WHEN 6 THEN 'Chapter iv ' WHEN 7 THEN 'Regulation '
  WHEN 8 THEN 'Rule ' WHEN 9 THEN 'section ' WHEN 10 THEN 'Appendix ' WHEN 11 THEN 'Articles of ' WHEN 12 THEN 'Article IV ' ELSE '7. Article ' END, CAST(p_partkey AS STRING), CASE p_partkey % 5 WHEN 0 THEN '(2)' WHEN 1 THEN 'A(3) Scope' WHEN 2 THEN '.4' WHEN 3 THEN 'B' ELSE ' Duties' END) AS heading
FROM {part}""",
    "case_meta": f"""
SELECT c.o_orderkey * 10 + c.doc_ord AS doc_id, CASE (c.o_orderkey + c.doc_ord) % 6 WHEN 0 THEN NULL WHEN 1 THEN lower(replace(replace(c.case_id, ' ', '-'), '/', '-')) WHEN 2 THEN '' WHEN 3 THEN replace(c.case_id, '/', ' of ') ELSE c.case_id END AS case_id,
  CASE WHEN (c.o_orderkey + c.doc_ord) % 12 = 0 THEN 'No number here.' ELSE concat('Claim No: ', c.case_id, ' and see ENF 9/2001') END AS first_page
FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber AS doc_ord, {_CASE} AS case_id FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey) c""",
    "editions": f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('DIFC ', title, ' ', CAST(year AS STRING)) WHEN 1 THEN concat('DIFC ', title) ELSE upper(title) END AS name, year FROM ({_LAWS}) AS l",
    "titles": f"""
SELECT doc_id, concat(CASE doc_id % 40 WHEN 7 THEN 'Employment Law' WHEN 8 THEN 'DIFC Trust' WHEN 9 THEN 'LLP Law' ELSE title END, ' No. ', CAST(number AS STRING), CASE WHEN doc_id % 2 = 0 THEN ' Consolidated Version March 2020' ELSE ' of the Companies_Act' END) AS title FROM ({_LAWS}) AS l""",
    "title_questions": f"""
SELECT c_custkey AS qid, CASE c_custkey % 7 WHEN 0 THEN 'What does the Employment Law say of wages?' WHEN 1 THEN concat('How does the ', a.title, ' treat duties?') WHEN 2 THEN concat('What does Article ', CAST(c_custkey % 12 + 1 AS STRING), ' require?')
   WHEN 3 THEN 'Who files under the Operating Law 2018?' WHEN 4 THEN concat('Is a ', split_part(a.name, ' ', 2), ' taxed under Article 7?') WHEN 5 THEN 'Which companies act?' ELSE 'Nothing at all?' END AS question
FROM {{customer}} JOIN ({_LAWS}) a ON a.doc_id = c_custkey""",
    "said_objects": """
SELECT c_custkey AS qid, CASE c_custkey % 6 WHEN 0 THEN concat('Here it is: {{"judge": "', c_name, '", "page": ', CAST(c_custkey % 9 AS STRING), '}} done') WHEN 1 THEN concat('{{"judge": "', c_name, '"') WHEN 2 THEN 'No data.'
   WHEN 3 THEN concat('{{"page": 2, "judge": "', c_name, '", "more": {{"x": 1}}}}') WHEN 4 THEN '{{"judge": null, "page": 3}} ' ELSE concat('a ', CHR(10), '{{', CHR(10), '"judge": "', c_name, '"', CHR(10), '}}') END AS said FROM {customer}""",
    "said_pairs": """
SELECT c_custkey AS qid, CASE c_custkey % 5 WHEN 0 THEN concat('```json', CHR(10), '[{{"q": "', c_name, '", "a": "yes"}}, {{"q": "no answer"}}]', CHR(10), '```') WHEN 1 THEN concat('[{{"q": "', c_name, '", "a": "b", "c": 1}}, {{"a": "no question"}}, {{"q": "two", "a": "3"}}]')
   WHEN 2 THEN '```[{{"q": "cut' WHEN 3 THEN 'I cannot.' ELSE '``` []```' END AS said FROM {customer}""",
    "said_scores": """
SELECT c_custkey AS qid, CASE c_custkey % 5 WHEN 0 THEN concat('scores: {{"1": 0.9, "2": 0.', CAST(c_custkey % 10 AS STRING), ', }} ok') WHEN 1 THEN '{{"1": "0.4", "3": 1.7, "9": 0.8, "x": 0.1}}' WHEN 2 THEN 'none' WHEN 3 THEN '{{"1": {{"2": 0.5, "4": -3}}}}' ELSE '{{"1": "high", "2": 0.25}}' END AS said FROM {customer}""",
    "parties": """
SELECT c_custkey AS qid, CASE c_custkey % 7 WHEN 0 THEN concat('{{"name": "', c_name, '", "page": 1}}') WHEN 1 THEN concat('{{"names": ["', c_name, '", "', n_name, '"]}}') WHEN 2 THEN concat('[{{"name": "', c_name, '"}}, {{"name": ""}}, {{"page": 2}}, {{"name": "', n_name, '"}}]') WHEN 3 THEN '{{"page": 1}}'
   WHEN 4 THEN concat('"', c_name, '"') WHEN 5 THEN concat('{{"name": "", "names": ["', n_name, '"]}}') ELSE '[]' END AS raw FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "raw_passages": """
SELECT c_custkey AS qid, c_custkey % 3 AS place, CASE c_custkey % 4 WHEN 0 THEN concat('{{"cite_1": " ', c_name, ' ", "age": "2", "cite_2": "second"}}') WHEN 1 THEN concat('{{"date": "2024", "cite_3": "', c_name, '"}}') WHEN 2 THEN c_name ELSE '{{"date": "2024"}}' END AS raw FROM {customer}""",
    "queries": "SELECT b.item_id AS qid, b.text AS query, d.doc_id AS gold_doc_id FROM {benchmark} b LEFT JOIN {documents} d ON contains(d.text, b.text)",
    "vec": """
SELECT vec_id, vec_id % 20 = 0 AS asked, label AS doc_id, CAST(vec_id % 7 + 1 AS INT) AS page, embedding FROM {embeddings}""",
    "runs": """
SELECT event_id AS qid,
  CASE event_type WHEN 'view' THEN 'boolean' WHEN 'click' THEN 'number' WHEN 'signup' THEN 'date' WHEN 'purchase' THEN 'name' ELSE 'free_text' END AS answer_type,
  CASE user_id % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'llm' ELSE 'rule-based' END AS model_name,
  CAST(floor(abs(value) * 10) AS INT) AS ttft_ms, CAST(floor(abs(value) * 10) AS INT) + CAST(user_id % 50 AS INT) AS total_time_ms,
  CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS answer, CAST(user_id % 4 AS INT) AS n_pages,
  CAST(100 + user_id % 400 AS INT) AS input_tokens, CAST(user_id % 90 AS INT) AS output_tokens
FROM {events}""",
    "nli": """
SELECT l.doc_id, d.lang AS hyp_key,
  CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 1 THEN 'entailment' ELSE 'not_mentioned' END AS gold,
  CASE WHEN n_chars % 10 = 0 THEN 'contradiction' WHEN n_chars > 200 THEN 'entailment' ELSE 'not_mentioned' END AS prediction
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "spans": """
SELECT doc_id AS qid, concat(source, '.txt') AS file, 'pred' AS kind, CAST(n_chars % 97 AS INT) AS span_start, CAST(n_chars % 97 + 60 AS INT) AS span_end FROM {documents}
UNION ALL
SELECT doc_id, concat(source, '.txt'), 'pred', CAST(n_chars % 97 + 40 AS INT), CAST(n_chars % 97 + 90 AS INT) FROM {documents} WHERE doc_id % 2 = 0
UNION ALL
SELECT doc_id, concat(source, '.txt'), 'gold', CAST(n_chars % 53 + 20 AS INT), CAST(n_chars % 53 + 100 AS INT) FROM {documents} WHERE doc_id % 5 <> 0""",
    "results": """
SELECT o_orderkey AS qid, CAST(o_orderkey % 4 + 1 AS INT) AS pages, CAST(o_orderkey % 3 + 1 AS INT) AS n_pages, CASE o_orderkey % 3 WHEN 0 THEN 'oracle' ELSE 'llm' END AS model_name,
  CASE o_orderkey % 2 WHEN 0 THEN 'The prison governor gave evidence.' ELSE 'Costs were awarded.' END AS source,
  CASE o_orderkey % 14
   WHEN 0 THEN 'Does the Employment Law address remote work?' WHEN 1 THEN 'Does Article 5 of the Trust Law address gifts?'
   WHEN 2 THEN 'Does DIFC Law No. 7 deal with insolvency?' WHEN 3 THEN 'Was the same judge involved in both CFI 010/2024 and SCT 011/2024?'
   WHEN 4 THEN 'Which case was issued earlier, CFI 001/2020 or CFI 002/2020?' WHEN 5 THEN 'What did the jury decide about the injury?'
   WHEN 6 THEN 'What compensation is due for an injury at work?' WHEN 7 THEN 'Was imprisonment discussed in CFI 123/2024?'
   WHEN 8 THEN 'Was prison mentioned in CFI 123/2024?' WHEN 9 THEN 'Is prison possible under the Trust Law of 2018?'
   WHEN 10 THEN 'What is the official number of the Employment Law?' WHEN 11 THEN 'Who signed page 7 of the judgment, and who the last page?'
   WHEN 12 THEN 'What stands on the title page and on the third page of the order?' ELSE 'On which date in 2021 or 1999 was the verdict of 2021 given?' END AS question,
  CASE o_orderkey % 14 WHEN 0 THEN 'free_text' WHEN 1 THEN 'boolean' WHEN 2 THEN 'boolean' WHEN 3 THEN 'boolean' WHEN 4 THEN 'name' WHEN 5 THEN 'free_text' WHEN 6 THEN 'number'
   WHEN 7 THEN 'boolean' WHEN 8 THEN 'boolean' WHEN 9 THEN 'free_text' WHEN 10 THEN 'number' WHEN 11 THEN 'names' WHEN 12 THEN 'free_text' ELSE 'date' END AS answer_type,
  CASE o_orderkey % 14 WHEN 0 THEN 'The documents do not address remote work, nor the Documents of 2020.' WHEN 1 THEN 'false' WHEN 2 THEN 'false' WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'true' ELSE 'false' END
   WHEN 4 THEN 'CFI 001/2020' WHEN 5 THEN NULL WHEN 6 THEN concat(CAST(o_orderkey AS STRING), '.0') WHEN 7 THEN 'false' WHEN 8 THEN 'true' WHEN 9 THEN 'A trustee''s breach of duty is civil, and the duty civil.' WHEN 10 THEN '4'
   WHEN 11 THEN 'Alpha LLC, Beta Ltd' WHEN 12 THEN '' ELSE '2021-03-05' END AS answer
FROM {orders}""",
    "answers": """
SELECT event_id AS qid, CASE event_id % 12
   WHEN 0 THEN 'Yes' WHEN 1 THEN 'true.' WHEN 2 THEN 'AED 1,250,000.50' WHEN 3 THEN '**False** because' WHEN 4 THEN '12 March 2021'
   WHEN 5 THEN concat('The claim is ', CAST(user_id AS STRING), ' [1] (Source: page 3)') WHEN 6 THEN 'null' WHEN 7 THEN concat(CAST(user_id AS STRING), ' 000')
   WHEN 8 THEN '2021-03-12' WHEN 9 THEN concat('ENF-', CAST(user_id % 900 + 100 AS STRING), '-2023') WHEN 10 THEN 'Alpha LLC, Beta Ltd and Gamma Inc' ELSE 'n/a' END AS raw
FROM {events}""",
}
BOTH["auto_index"] = f"""SELECT case_id, o_orderkey * 10 + doc_ord AS doc_id, case_id AS told, 'CFI' AS case_type, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE date_of_issue END AS date_of_issue, concat(claimant, ';') AS claimant, concat(defendant, ';', claimant) AS defendant FROM ({BOTH['case_docs']}) AS c WHERE o_orderkey % 9 <> 0"""
BOTH["manual_index"] = f"""SELECT case_id, o_orderkey * 10 + doc_ord AS doc_id, CASE WHEN o_orderkey % 17 = 0 THEN lower(case_id) ELSE case_id END AS told, CASE WHEN o_orderkey % 13 = 0 THEN 'ARB' ELSE 'CFI' END AS case_type, CASE WHEN o_orderkey % 10 IN (3, 4) THEN NULL ELSE date_of_issue END AS date_of_issue, concat(claimant, ';') AS claimant, CASE WHEN n_defendants > 2 THEN defendant ELSE concat(claimant, '; ', lower(defendant)) END AS defendant FROM ({BOTH['case_docs']}) AS c WHERE o_orderkey % 11 <> 0 AND NOT (doc_ord = 2 AND o_orderkey % 4 = 1)"""
BOTH["all_questions"] = f"SELECT qid, question, answer_type FROM ({BOTH['questions']}) AS a UNION ALL SELECT qid + 100000000, question, answer_type FROM ({BOTH['results']}) AS b"


#: Views whose rows cost much more than those of the table they are made of, with that table and its key.
DEALT = {
    "statutes": ("part", "p_partkey"), "titles": ("part", "p_partkey"), "law_questions": ("customer", "c_custkey"), "title_questions": ("customer", "c_custkey"),
    "paper_questions": ("customer", "c_custkey"), "lost_questions": ("supplier", "s_suppkey"),
}
#: Tables that several queries of an application read, by folder and name: the first one writes them.
_ONCE: dict[tuple, DataFrame] = {}


class Inputs:
    """The tables of one directory and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """A query whose ``{names}`` are tables, views (``fx_...``) or the frames given."""
        names = set(re.findall(r"\{(\w+)\}", text)) - frames.keys()
        known = {n: self.fx(n[3:]) if n.startswith("fx_") else self.table(n) for n in names}
        return self.spark.sql(text, **known, **frames)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written by the first query that asks for it."""
        key = self.spark.sparkContext.applicationId, self.sf_dir, name
        if key not in _ONCE:
            _ONCE[key] = written(make(), name)
        return _ONCE[key]

    def parts(self, name: str, rows: int) -> int:
        """So many partitions that about ``rows`` rows of a table come to each, and not fewer than the session's."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table(name).count() // rows))

    def fx(self, name: str, **frames: DataFrame) -> DataFrame:
        """A view, over ``frames`` in place of the tables of those names."""
        if name == "queries":  # found by n-grams, not by comparing every pair
            items = self.table("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
            gold = containing(self.table("documents"), items, "doc_id", "text", "qid", "query")
            return items.join(gold.withColumnRenamed("doc_id", "gold_doc_id"), "qid", "left")
        return self.sql(PAGES_SPARK if name == "pages" else BOTH[name], **{**self._dealt(name), **frames})

    def _dealt(self, name: str) -> dict[str, DataFrame]:
        """The narrow table of which a view makes wide rows, dealt over all partitions: a few megabytes in one file would be one task's."""
        table, key = DEALT.get(name, (None, None))
        return {table: self.table(table).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)} if table else {}


def duck(text: str) -> str:
    """A query with plain names of tables and views (``fx_...``) as DuckDB SQL that defines the views it uses."""
    plain = {t: t for t in TABLES}
    used = dict.fromkeys(re.findall(r"\bfx_(\w+)", text))
    views = [f"fx_{n} AS ({(PAGES_DUCK if n == 'pages' else BOTH[n]).format(**plain)})" for n in used]
    text = text.strip()
    if not views:
        return text
    head = "WITH RECURSIVE " if text.upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"^WITH (RECURSIVE )?", "", text, flags=re.I) if text.upper().startswith("WITH") else None
    return head + ",\n".join(views) + (",\n" + rest if rest is not None else "\n" + text)
