"""Intermediate results in checking SQL: cleaned texts, sections, chunks, vectors, neighbours."""

from __future__ import annotations

from lexspark.functions import fixed
from lexspark.registry.base import filled, quoted, step

SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACES}', ' ', 'g'))"


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACES}', ''), '{SPACES}$', '')"


STATUTORY, SIMPLE = fixed.STATUTORY_SECTION, fixed.SIMPLE_SECTION
PHRASE = fixed.CAPITALISED_PHRASE.removeprefix("(?U)")


def found(text: str, pattern: str, group: int = 1) -> str:
    """First match of a fixed pattern, NULL if there is none."""
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def amount(text: str) -> str:
    return f"try_cast(replace(regexp_extract({text}, '{fixed.AMOUNT}', 1), ',', '') AS bigint)"


def by_change(wordings: dict[str, str], other: str) -> str:
    tests = " ".join(f"WHEN '{name}' THEN {filled(text, old='ipc_section', new='bns_section')}" for name, text in wordings.items())
    return f"CASE change_type {tests} ELSE {quoted(other)} END"


def phrases(text: str) -> str:
    """Capitalised phrases of a text, distinct in order of first sight, as a comma list."""
    # Accented letters are letters too: an underscore keeps a word boundary from falling next to them.
    found = f"regexp_extract_all(regexp_replace({text}, '[À-ÖØ-öø-ɏ]', '_', 'g'), '{PHRASE}', 0)"
    return f"array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), ', ')"


step("c_clean_docs", f"SELECT filename, {squeezed('text')} AS text FROM v_raw_docs")
step("c_documents", "SELECT filename, text, length(text) AS char_count FROM c_clean_docs WHERE length(text) > 100")
step("c_raw_schemes", f"""SELECT filename, t AS text, length(t) AS char_count
FROM (SELECT filename, {squeezed('text')} AS t FROM v_scheme_texts) WHERE length(t) > 100""")
step("c_schemes", f"""SELECT filename AS source_file, {found('text', fixed.SCHEME_NAME)} AS scheme_name, {found('text', fixed.MINISTRY)} AS ministry,
  {found('text', fixed.BENEFICIARY)} AS beneficiary_type, {found('text', fixed.STATE)} AS state, {amount('text')} AS income_limit_inr,
  text AS full_text, char_count
FROM c_raw_schemes WHERE char_count > 100""")
step("c_mapping", f"""SELECT ipc_section, ipc_title, bns_section, bns_title, change_type,
  {by_change(fixed.CHANGE_DETAIL, fixed.CHANGE_DETAIL_OTHER)} AS change_detail,
  {by_change(fixed.CHANGE_IMPACT, fixed.CHANGE_IMPACT_OTHER)} AS impact_for_citizen
FROM v_section_pairs""")
step("c_pages", f"SELECT * FROM v_statute_pages WHERE length({stripped('text')}) >= 50")
step("c_headed", f"SELECT doc_id, page_no, text, 'CHAPTER ' || {found('text', fixed.CHAPTER)} AS heading FROM c_pages")
step("c_chaptered", """SELECT doc_id, page_no, text, coalesce(last_value(heading IGNORE NULLS) OVER (
    PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') AS chapter FROM c_headed""")
step("c_split", r"""SELECT doc_id, page_no, chapter, unnest(range(0, len(parts))) AS paragraph_no, unnest(parts) AS raw
FROM (SELECT *, regexp_split_to_array(text, '\n\s*\n') AS parts FROM c_chaptered)""")
step("c_paragraphs", f"""SELECT doc_id, page_no, chapter, paragraph_no, {stripped('raw')} AS paragraph FROM c_split
WHERE length({stripped('raw')}) >= 30""")
step("c_matched", f"""SELECT *, regexp_extract(paragraph, '{STATUTORY}', 1) AS n1, regexp_extract(paragraph, '{STATUTORY}', 2) AS t1,
  regexp_extract(paragraph, '{STATUTORY}', 3) AS b1, regexp_extract(paragraph, '{SIMPLE}', 1) AS n3,
  regexp_extract(paragraph, '{SIMPLE}', 2) AS t3,
  {stripped(f"substring(paragraph, length(regexp_extract(paragraph, '{SIMPLE}', 0)) + 1)")} AS b3 FROM c_paragraphs""")
step("c_sections", f"""SELECT doc_id, paragraph_no, section_number, title, full_text, chapter, 'IPC_1860' AS source_law,
  {phrases("title || ' ' || full_text")} AS keywords, length(full_text) AS char_count, page_no AS page_number
FROM (SELECT doc_id, paragraph_no, page_no, chapter, CASE WHEN n1 <> '' THEN n1 ELSE n3 END AS section_number,
    regexp_replace({stripped("CASE WHEN n1 <> '' THEN t1 ELSE t3 END")}, '{SPACES}', ' ', 'g') AS title,
    regexp_replace(CASE WHEN n1 <> '' THEN {stripped('b1')} WHEN length(b3) < 20 THEN paragraph ELSE b3 END,
      '{SPACES}', ' ', 'g') AS full_text
  FROM c_matched WHERE n1 <> '' OR n3 <> '')""")
_statutes = " UNION ALL ".join(
    f"SELECT '{prefix}' || section_number AS chunk_id, section_number, title, full_text, source_law, chapter, page_number FROM {table}"
    for prefix, table in [("bns_", "v_bns_sections"), ("bnss_", "v_bnss_sections"), ("bsa_", "v_bsa_sections"), ("ipc_", "c_sections")])
step("c_statute_rows", _statutes)
step("c_chunks", """SELECT chunk_id, section_number, title, chunk_text, source_law, chapter, 'legal_section' AS content_type
FROM (SELECT chunk_id, section_number, title, title || ' ' || full_text AS chunk_text, source_law, chapter,
    row_number() OVER (PARTITION BY chunk_id ORDER BY length(full_text) DESC, page_number, title, title || ' ' || full_text) AS rn
  FROM c_statute_rows) WHERE rn = 1
UNION ALL
SELECT 'scheme_' || row_number() OVER (ORDER BY source_file, scheme_name), '', scheme_name,
  concat_ws(' ', scheme_name, ministry, beneficiary_type, state, full_text), 'schemes', ministry, 'government_scheme'
FROM c_schemes WHERE scheme_name IS NOT NULL""")


def vectors(name: str, source: str, key: str, text: str) -> None:
    """Steps ``<name>`` (key, bucket, weight) and ``<name>_len`` (key, squared length) of hashed word counts."""
    step(f"{name}_words", f"SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source}")
    step(f"{name}_counts", f"SELECT k, ('0x' || substring(md5(word), 1, 8))::bigint % 64 AS bucket, count(*)::double AS n FROM {name}_words GROUP BY ALL")
    step(name, f"SELECT k, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS weight FROM {name}_counts")
    step(f"{name}_len", f"SELECT s.{key} AS k, coalesce(sum(weight * weight), 0) AS len2 FROM {source} s LEFT JOIN {name} v ON v.k = s.{key} GROUP BY ALL")


def neighbours(name: str, asked: str, stored: str, k: int, wanted: str | None = None, source: str | None = None) -> None:
    """Step ``name`` (query_id, chunk_id, rank, distance, similarity): all distances, then the ranking."""
    limit = f"WHERE w.wanted IS NULL OR w.wanted = o.source_law" if wanted else ""
    joins = f"JOIN {wanted} w ON w.question_id = q.k JOIN {source} o ON o.chunk_id = s.k" if wanted else ""
    step(f"{name}_dot", f"SELECT q.k AS qk, s.k AS sk, sum(q.weight * s.weight) AS dot FROM {asked} q JOIN {stored} s USING (bucket) GROUP BY ALL")
    step(f"{name}_all", f"""SELECT q.k AS query_id, s.k AS chunk_id, round(q.len2 + s.len2 - 2 * coalesce(d.dot, 0), 9) AS distance
FROM {asked}_len q CROSS JOIN {stored}_len s {joins} LEFT JOIN {name}_dot d ON d.qk = q.k AND d.sk = s.k {limit}""")
    step(name, f"""SELECT query_id, chunk_id, rank, distance, round(1 / (1 + distance), 4) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM {name}_all) WHERE rank <= {k}""")


vectors("c_chunk_vec", "c_chunks", "chunk_id", "chunk_text")
vectors("c_question_vec", "v_questions", "question_id", "question")
neighbours("c_near", "c_question_vec", "c_chunk_vec", 5)
step("c_results", "SELECT n.query_id AS question_id, n.rank, c.*, n.distance, n.similarity FROM c_near n JOIN c_chunks c USING (chunk_id)")
vectors("c_search_vec", "v_searches", "question_id", "question")
neighbours("c_search_near", "c_search_vec", "c_chunk_vec", 5, "v_searches", "c_chunks")

# distances between all stored vectors
step("c_pairs", """SELECT q.vec_id, q.wanted, v.chunk_id, v.source_law, v.content_type,
  round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 9) AS distance
FROM v_chunk_vectors q CROSS JOIN v_chunk_vectors v""")
step("c_knn", """SELECT vec_id, chunk_id, source_law, content_type, rank, distance, round(1 / (1 + distance), 4) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, chunk_id) AS rank FROM c_pairs) WHERE rank <= 5""")

# eligibility: every profile against every scheme
step("c_eligible", """SELECT profile_id, rank, source_file, scheme_name, ministry, beneficiary_type, scheme_state, income_limit_inr, preview FROM (
  SELECT p.profile_id, s.source_file, s.scheme_name, s.ministry, s.beneficiary_type, s.state AS scheme_state, s.income_limit_inr,
    s.full_text AS preview,
    row_number() OVER (PARTITION BY p.profile_id ORDER BY s.scheme_name, s.source_file) AS rank
  FROM v_profiles p JOIN c_schemes s ON (contains(lower(s.state), 'all') OR contains(lower(s.state), lower(p.state)) OR s.state IS NULL)
    AND (s.income_limit_inr IS NULL OR s.income_limit_inr >= p.income)
    AND (contains(lower(s.beneficiary_type), lower(p.occupation)) OR contains(lower(s.beneficiary_type), 'general') OR s.beneficiary_type IS NULL))
WHERE rank <= 10""")

# section map lookups
step("c_compare", f"SELECT query_id, query, {stripped('query')} AS q, regexp_matches({stripped('query')}, '^[0-9]+[A-Z]?$') AS is_number FROM v_compare_queries")
step("c_by_number", """SELECT query_id, ipc_section, ipc_title, bns_section, bns_title, change_type, change_detail, impact_for_citizen FROM (
  SELECT c.query_id, m.*, row_number() OVER (PARTITION BY c.query_id ORDER BY CASE WHEN m.ipc_section = c.q THEN 0 ELSE 1 END,
    m.ipc_section, m.bns_section, m.ipc_title) AS rn
  FROM c_compare c JOIN c_mapping m ON m.ipc_section = c.q OR m.bns_section = c.q WHERE c.is_number) WHERE rn = 1""")
step("c_by_topic", """SELECT query_id, rank, ipc_section, ipc_title, bns_section, bns_title, change_type, change_detail, impact_for_citizen FROM (
  SELECT c.query_id, m.*, row_number() OVER (PARTITION BY c.query_id ORDER BY m.ipc_section, m.bns_section, m.ipc_title) AS rank
  FROM c_compare c JOIN c_mapping m ON contains(lower(m.ipc_title), lower(c.query)) OR contains(lower(m.bns_title), lower(c.query))
    OR contains(lower(m.change_detail), lower(c.query)) WHERE NOT c.is_number) WHERE rank <= 3""")

# evaluation
step("c_scored", r"""SELECT *, len(list_filter(keywords, lambda w: contains(lower(actual_answer), w))) AS keywords_matched, len(keywords) AS total_keywords
FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(correct_text, '\s+', ' ', 'g')), ' '),
    lambda w: length(w) > 4)[1:5], lambda w: lower(w)) AS keywords FROM v_eval_cases)""")
step("c_outcome", """SELECT *, keywords_matched >= greatest(1, total_keywords // 2) AS correct FROM c_scored""")
step("c_eval_results", """SELECT test_id, question, language, subject_domain, topic, level, correct_option,
  correct_text, CASE WHEN failed THEN 'ERROR: ' || error ELSE actual_answer END AS actual_answer,
  CASE WHEN failed THEN 0 ELSE keywords_matched END AS keywords_matched, CASE WHEN failed THEN 0 ELSE total_keywords END AS total_keywords,
  CASE WHEN failed THEN false ELSE correct END AS correct, CASE WHEN failed THEN 0.0 ELSE response_time_ms END AS response_time_ms,
  CASE WHEN failed THEN 'error' ELSE intent END AS intent, CASE WHEN failed THEN 'error' ELSE agent_used END AS agent_used FROM c_outcome""")
