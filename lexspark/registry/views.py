"""Test inputs shaped from the given tables, as one SQL text for Spark and for the check engine.

``{name}`` stands for a given table. Each view covers all rows and whole texts of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.sources.tables import read_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    # raw scheme documents; one in seventeen is too short to be kept
    "scheme_texts": """
SELECT 'scheme_' || lpad(cast(c_custkey AS string), 9, '0') || '.txt' AS filename,
  CASE WHEN c_custkey % 17 = 0 THEN 'Too short' ELSE
  CASE c_custkey % 3 WHEN 0 THEN 'Kisan Support Plan ' WHEN 1 THEN 'Shiksha Grant ' ELSE 'Udyam Credit Line ' END || cast(c_custkey AS string)
  || '. Ministry of ' || c_mktsegment || ' & Trade, open to every '
  || CASE c_custkey % 8 WHEN 0 THEN 'farmer' WHEN 1 THEN 'student' WHEN 2 THEN 'women' WHEN 3 THEN 'SC' WHEN 4 THEN 'entrepreneur' WHEN 5 THEN 'rural' ELSE 'person' END
  || ' in ' || CASE c_nationkey % 4 WHEN 0 THEN 'All India' WHEN 1 THEN 'Uttar Pradesh' WHEN 2 THEN 'Andhra Pradesh' ELSE 'any place' END
  || CASE WHEN c_custkey % 5 = 0 THEN ' with no limit.' ELSE ' with income up to Rs. ' || cast(50 + c_custkey % 450 AS string) || ',' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || ' a year.' END
  || ' Bring an identity card, a bank passbook and an income certificate.' END AS text
FROM {customer}""",
    "profiles": """
SELECT c_custkey AS profile_id,
  CASE c_nationkey % 4 WHEN 0 THEN 'Uttar Pradesh' WHEN 1 THEN 'Andhra Pradesh' WHEN 2 THEN 'All India' ELSE 'Delhi' END AS state,
  cast(20000 + (c_custkey % 40) * 12500 AS bigint) AS income,
  CASE c_custkey % 4 WHEN 0 THEN 'Farmer' WHEN 1 THEN 'Student' WHEN 2 THEN 'Women' ELSE 'General' END AS occupation,
  'General' AS category
FROM {customer}""",
    "section_pairs": """
SELECT cast(p_partkey AS string) || CASE WHEN p_partkey % 7 = 0 THEN 'A' ELSE '' END AS ipc_section,
  p_name AS ipc_title, CASE WHEN p_size = 50 THEN 'DELETED' ELSE cast(p_size AS string) END AS bns_section,
  CASE WHEN p_size = 50 THEN 'N/A' ELSE p_name || ' ' || lower(p_type) END AS bns_title,
  CASE WHEN p_size = 50 THEN 'deleted' WHEN p_type = 'PROMO' THEN 'modified' WHEN p_type IN ('SMALL', 'LARGE') THEN 'consolidated' ELSE 'renamed' END AS change_type
FROM {part}""",
    # section reference, comparison, scheme and plain questions; some in Hindi
    "questions": """
SELECT conv_id * 1000 + turn AS question_id, conv_id,
  CASE WHEN (conv_id + turn) % 9 = 4 THEN 'धारा ' || cast(conv_id % 200 AS string) || CASE WHEN conv_id % 2 = 0 THEN ' क्या है?' ELSE ' किस योजना में है?' END
    ELSE CASE (conv_id + turn) % 4 WHEN 0 THEN 'What is Section ' || cast(conv_id % 200 AS string) || '? ' || text
    WHEN 1 THEN 'How did IPC ' || cast(conv_id % 200 AS string) || ' change? ' || text
    WHEN 2 THEN 'Which scheme can a farmer apply for? ' || text ELSE text END END AS question
FROM {conversations} WHERE role = 'user'""",
    # the same with applicants: whole profiles, partial ones, none
    "routed_questions": """
SELECT c.conv_id * 1000 + c.turn AS question_id,
  CASE WHEN (c.conv_id + c.turn) % 9 = 4 THEN 'धारा ' || cast(c.conv_id % 200 AS string) || CASE WHEN c.conv_id % 2 = 0 THEN ' क्या है?' ELSE ' किस योजना में है?' END
    ELSE CASE (c.conv_id + c.turn) % 4 WHEN 0 THEN 'What is Section ' || cast(c.conv_id % 200 AS string) || '? ' || c.text
    WHEN 1 THEN 'How did IPC ' || cast(c.conv_id % 200 AS string) || ' change? ' || c.text
    WHEN 2 THEN 'Which scheme can a farmer apply for? ' || c.text ELSE c.text END END AS question,
  CASE WHEN u.c_custkey % 3 = 0 THEN NULL WHEN u.c_nationkey % 4 = 0 THEN 'Uttar Pradesh' WHEN u.c_nationkey % 4 = 1 THEN 'Andhra Pradesh' WHEN u.c_nationkey % 4 = 2 THEN 'Delhi' END AS state,
  CASE WHEN u.c_nationkey % 4 < 3 AND u.c_custkey % 5 <> 0 THEN cast(20000 + (u.c_custkey % 40) * 12500 AS bigint) END AS income,
  CASE WHEN u.c_nationkey % 4 < 3 THEN CASE u.c_custkey % 4 WHEN 0 THEN 'Farmer' WHEN 1 THEN 'Student' WHEN 2 THEN 'Women' END END AS occupation,
  CASE WHEN u.c_nationkey % 4 < 2 THEN 'General' END AS category
FROM {conversations} c LEFT JOIN {customer} u ON u.c_custkey = c.conv_id WHERE c.role = 'user'""",
    # section numbers, padded numbers, topics that occur in titles, topics that do not
    "compare_queries": """
SELECT c_custkey AS query_id, CASE c_custkey % 4
    WHEN 0 THEN cast(c_custkey AS string) || CASE WHEN c_custkey % 7 = 0 THEN 'A' ELSE '' END
    WHEN 1 THEN ' ' || cast(c_custkey % 60 AS string) || ' '
    WHEN 2 THEN upper(p_name) ELSE lower(c_mktsegment) || ' ' || cast(c_nationkey AS string) END AS query
FROM {customer} LEFT JOIN {part} ON p_partkey = c_custkey""",
    # search texts with a source to search in; two of them have no vectors
    "searches": """
SELECT c_custkey AS question_id, CASE c_custkey % 3 WHEN 0 THEN p_name WHEN 1 THEN n_name ELSE 'plan ' || cast(c_custkey AS string) END AS question,
  CASE c_custkey % 4 WHEN 0 THEN 'IPC_1860' WHEN 1 THEN 'schemes' WHEN 2 THEN 'no_such_source' END AS wanted
FROM {customer} LEFT JOIN {part} ON p_partkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey""",
    "eval_cases": """
SELECT d.doc_id AS test_id, d.lang AS language, d.source AS topic, 'Domain ' || d.lang AS subject_domain,
  CASE l.toxic WHEN 1 THEN 'Hard' ELSE 'Easy' END AS level, b.text AS correct_text, d.text AS question,
  CASE WHEN d.doc_id % 2 = 0 THEN b.text ELSE d.text END AS actual_answer, 'A' AS correct_option,
  cast(d.n_chars AS double) / 10 AS response_time_ms, coalesce(l.quality = 0, false) AS failed, 'no reply' AS error,
  'legal_query' AS intent, 'BNSAgent' AS agent_used
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
JOIN {benchmark} b ON b.item_id = d.doc_id % (SELECT count(*) FROM {benchmark})""",
    "mcq_questions": """
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'hi' ELSE 'en' END AS language, text AS question,
  substring(text, 1, 30) AS option_a, substring(text, 31, 30) AS option_b, substring(text, 61, 30) AS option_c, substring(text, 91) AS option_d,
  CASE item_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' b ' WHEN 2 THEN 'c' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE NULL END AS correct_answer,
  CASE WHEN item_id % 7 = 0 THEN NULL ELSE 'topic' || cast(item_id % 4 AS string) END AS topic,
  CASE item_id % 5 WHEN 0 THEN 'Criminal Law & Justice' WHEN 1 THEN 'Civil Litigation & Procedure' WHEN 2 THEN 'Constitutional & Administrative Law' ELSE 'Tax Law' END AS subject_domain,
  CASE WHEN item_id % 2 = 0 THEN 'Easy' ELSE NULL END AS question_level
FROM {benchmark}""",
    "query_logs": """
SELECT cast(event_id AS string) AS query_id, props AS original_query, props AS english_query,
  CASE user_id % 3 WHEN 0 THEN 'hi' ELSE 'en' END AS detected_lang,
  CASE event_type WHEN 'click' THEN 'law_comparison' WHEN 'purchase' THEN 'scheme_eligibility' ELSE 'legal_question' END AS intent,
  CASE event_type WHEN 'click' THEN 'DiffAgent' WHEN 'purchase' THEN 'SchemeAgent' ELSE 'BNSAgent' END AS agent_used,
  cast(floor(value * 100) AS bigint) AS response_time_ms, ts AS timestamp
FROM {events}""",
    # every stored vector with a source of its own and the next source as the one to search in
    "chunk_vectors": """
SELECT vec_id, 'chunk_' || cast(vec_id AS string) AS chunk_id, 'law_' || cast(label AS string) AS source_law,
  'law_' || cast((label + 1) % 10 AS string) AS wanted,
  CASE WHEN vec_id % 5 = 0 THEN 'government_scheme' ELSE 'legal_section' END AS content_type, embedding
FROM {embeddings}""",
    "chunks_v1": """
SELECT 'doc_' || cast(doc_id AS string) AS chunk_id, lang AS source_law, text AS chunk_text FROM {documents}""",
    # the next version: toxic documents are gone, good ones were edited, conversation turns came in
    "chunks_v2": """
SELECT 'doc_' || cast(d.doc_id AS string) AS chunk_id, d.lang AS source_law,
  CASE WHEN l.quality = 1 THEN 'edited ' || d.text ELSE d.text END AS chunk_text
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0
UNION ALL
SELECT 'turn_' || cast(conv_id AS string) || '_' || cast(turn AS string) AS chunk_id, role AS source_law, text AS chunk_text
FROM {conversations}""",
    "raw_docs": """
SELECT source || '_' || lpad(cast(doc_id AS string), 8, '0') AS filename, text, n_chars AS char_count FROM {documents}""",
    # conversations as documents of many pages, documents as documents of one page
    "doc_pages": """
SELECT 'conv_' || lpad(cast(conv_id AS string), 8, '0') AS filename, turn AS page_no, text FROM {conversations}
UNION ALL
SELECT source || '_' || lpad(cast(doc_id AS string), 8, '0') AS filename, cast(0 AS bigint) AS page_no, text FROM {documents}""",
    # pages of twenty paragraphs: headings on every third page, heading-only short pages, both section forms
    "statute_pages": """
WITH para AS (
  SELECT p_partkey, cast(floor(p_partkey / 20) AS bigint) + 1 AS page,
    CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN cast(p_partkey AS string) || CASE WHEN p_partkey % 7 = 0 THEN 'A' ELSE '' END || '. ' || p_name || ' of ' || p_type
           || '.-- Whoever buys ' || p_brand || ' of size ' || cast(p_size AS string) || ' pays the Retail Price'
         WHEN p_partkey % 10 = 3 THEN cast(p_partkey AS string) || '. ' || p_name || ' simple heading' || chr(10) || 'Second line on ' || p_brand || ' that is long enough'
         WHEN p_partkey % 10 = 8 THEN cast(p_partkey AS string) || '. ' || p_name || ' simple heading only here'
         ELSE 'Plain remark about ' || p_name || ' with no number at all' END AS para
  FROM {part})
SELECT 'statute_' || cast(cast(floor((page - 1) / 25) AS bigint) AS string) AS doc_id, (page - 1) % 25 + 1 AS page_no,
  CASE WHEN page % 11 = 0 THEN 'CHAPTER IX' ELSE
    CASE WHEN page % 3 = 0 THEN 'Chapter ' || (CASE page % 4 WHEN 0 THEN 'IV' WHEN 1 THEN 'I' WHEN 2 THEN 'II' ELSE 'III' END) || chr(10) || chr(10) ELSE '' END
    || %AGG% END AS text
FROM para GROUP BY page""",
    "bns_sections": """
SELECT cast(p_size AS string) AS section_number, p_name AS title,
  'Section ' || cast(p_size AS string) || ' on ' || p_name || ' of ' || p_brand || ' and ' || lower(p_type) || ' goods' AS full_text,
  'CHAPTER V' AS chapter, 'BNS_2023' AS source_law, p_partkey AS page_number FROM {part}""",
    "bnss_sections": """
SELECT cast(s_suppkey AS string) AS section_number, s_name AS title,
  'Procedure of ' || s_name || ' before the court of ' || n_name AS full_text,
  'GENERAL' AS chapter, 'BNSS_2023' AS source_law, s_suppkey AS page_number FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "bsa_sections": """
SELECT cast(n_nationkey AS string) AS section_number, n_name AS title,
  'Evidence from ' || n_name || ' in ' || r_name AS full_text,
  'GENERAL' AS chapter, 'BSA_2023' AS source_law, cast(n_nationkey AS bigint) AS page_number FROM {nation} JOIN {region} ON r_regionkey = n_regionkey""",
}

_SPARK_AGG = "string_agg(para, '\\n\\n') WITHIN GROUP (ORDER BY p_partkey)"
_CHECK_AGG = "string_agg(para, chr(10) || chr(10) ORDER BY p_partkey)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test input as a DataFrame over the given tables."""
    sql = VIEWS[name].replace("%AGG%", _SPARK_AGG)
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if " JOIN " in sql:  # their compressed files look small enough to be broadcast when their rows are not
        used |= {t: used[t].hint("merge") for t in ("customer", "part") if t in used}
    return spark.sql(sql, **used)


def check_sql(name: str) -> str:
    """The same input as SQL over the registered tables."""
    return VIEWS[name].replace("%AGG%", _CHECK_AGG).format(**{t: t for t in TABLES})
