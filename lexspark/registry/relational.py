"""Scans, filters, aggregates, windows, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions import text as tx
from lexspark.operators import lookups, reports, windows
from lexspark.operators.changes import new_files, snapshot_diff
from lexspark.plans import corpus, prompts
from lexspark.registry import inputs
from lexspark.registry.base import filled, query, quoted
from lexspark.registry.steps import amount, found, phrases, squeezed
from lexspark.registry.views import view
from lexspark.sources import tables


# --- scans and table-level operators -----------------------------------------------------------
@query("src_table_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def src_table_scan(spark, sf):
    return tables.scan(tables.read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"))


@query("lim_sample_rows", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def lim_sample_rows(spark, sf):
    documents = tables.read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return tables.scan(documents, ["doc_id"], 5)


@query("tbl_row_counts", """SELECT 'documents' AS table_name, count(*) AS row_count FROM documents
UNION ALL SELECT 'schemes', count(*) FROM c_schemes UNION ALL SELECT 'sections', count(*) FROM c_sections
UNION ALL SELECT 'mapping', count(*) FROM c_mapping""")
def tbl_row_counts(spark, sf):
    return tables.row_counts({
        "documents": tables.read_table(spark, sf, "documents"),
        "schemes": inputs.schemes(spark, sf),
        "sections": inputs.sections(spark, sf),
        "mapping": inputs.mapping(spark, sf),
    })


@query("chg_snapshot_diff", """SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id,
  CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS change
FROM v_chunks_v1 o FULL OUTER JOIN v_chunks_v2 n ON o.chunk_id = n.chunk_id
WHERE o.chunk_id IS NULL OR n.chunk_id IS NULL OR o.chunk_text <> n.chunk_text OR o.source_law <> n.source_law""")
def chg_snapshot_diff(spark, sf):
    return snapshot_diff(view(spark, sf, "chunks_v1"), view(spark, sf, "chunks_v2"), "chunk_id")


@query("inc_new_files", """SELECT filename, page_no, text FROM v_doc_pages
WHERE filename NOT IN (SELECT filename FROM c_documents)""")
def inc_new_files(spark, sf):
    stored = corpus.clean_documents(view(spark, sf, "raw_docs"))
    return new_files(view(spark, sf, "doc_pages"), stored).select("filename", "page_no", "text")


# --- projections and filters -------------------------------------------------------------------
@query("prj_select_alias_literal", """SELECT source_file AS chunk_id, '' AS section_number, scheme_name AS title,
  'schemes' AS source_law, 'government_scheme' AS content_type FROM c_schemes""")
def prj_select_alias_literal(spark, sf):
    return inputs.schemes(spark, sf).select(
        F.col("source_file").alias("chunk_id"), F.lit("").alias("section_number"), F.col("scheme_name").alias("title"),
        F.lit("schemes").alias("source_law"), F.lit("government_scheme").alias("content_type"))


@query("flt_min_length", "SELECT filename, text, char_count FROM c_documents")
def flt_min_length(spark, sf):
    return corpus.clean_documents(view(spark, sf, "raw_docs"))


@query("flt_not_null", "SELECT source_file, scheme_name, state FROM c_schemes WHERE scheme_name IS NOT NULL AND state IS NOT NULL")
def flt_not_null(spark, sf):
    return inputs.schemes(spark, sf).where(F.col("scheme_name").isNotNull() & F.col("state").isNotNull()).select(
        "source_file", "scheme_name", "state")


@query("flt_in_list", "SELECT ipc_section, change_type FROM v_section_pairs WHERE change_type IN ('modified', 'deleted')")
def flt_in_list(spark, sf):
    pairs = view(spark, sf, "section_pairs")
    return pairs.where(F.col("change_type").isin("modified", "deleted")).select("ipc_section", "change_type")


@query("flt_equals", "SELECT ipc_section, ipc_title, impact_for_citizen FROM c_mapping WHERE change_type = 'deleted'")
def flt_equals(spark, sf):
    return inputs.mapping(spark, sf).where(F.col("change_type") == "deleted").select(
        "ipc_section", "ipc_title", "impact_for_citizen")


@query("flt_like_contains", "SELECT source_file, ministry FROM c_schemes WHERE contains(ministry, 'MACHINERY')")
def flt_like_contains(spark, sf):
    return inputs.schemes(spark, sf).where(F.contains("ministry", F.lit("MACHINERY"))).select("source_file", "ministry")


# --- lookups -----------------------------------------------------------------------------------
@query("lkp_section", f"""SELECT q.question_id, {found('question', fixed.SECTION_REFERENCE)} AS asked_section,
  s.title AS found_title, s.full_text AS found_text, s.source_law AS found_law
FROM v_questions q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY section_number ORDER BY source_law, title, full_text) AS rn
  FROM v_bns_sections) s ON s.rn = 1 AND s.section_number = {found('question', fixed.SECTION_REFERENCE)}""")
def lkp_section(spark, sf):
    found = lookups.lookup_section(view(spark, sf, "questions"), view(spark, sf, "bns_sections"))
    return found.select("question_id", "asked_section", "found_title", "found_text", "found_law")


@query("lkp_mapping_by_number", "SELECT * FROM c_by_number")
def lkp_mapping_by_number(spark, sf):
    return lookups.lookup_by_number(view(spark, sf, "compare_queries"), inputs.mapping(spark, sf))


@query("lkp_mapping_by_topic", "SELECT * FROM c_by_topic")
def lkp_mapping_by_topic(spark, sf):
    return lookups.lookup_by_topic(view(spark, sf, "compare_queries"), inputs.mapping(spark, sf))


@query("lkp_mapping_sample", """SELECT ipc_section, bns_section, ipc_title, change_type, change_detail,
  'IPC ' || ipc_section || ' → BNS ' || bns_section || ': ' || change_type AS line
FROM c_mapping ORDER BY ipc_section, bns_section, ipc_title LIMIT 5""")
def lkp_mapping_sample(spark, sf):
    return lookups.section_map_sample(inputs.mapping(spark, sf))


# --- aggregates --------------------------------------------------------------------------------
@query("agg_count", "SELECT count(*) AS row_count FROM c_documents")
def agg_count(spark, sf):
    return corpus.clean_documents(view(spark, sf, "raw_docs")).agg(F.count("*").alias("row_count"))


@query("agg_count_by", "SELECT change_type, count(*) AS row_count FROM v_section_pairs GROUP BY change_type")
def agg_count_by(spark, sf):
    return reports.count_by(view(spark, sf, "section_pairs"), "change_type")


@query("agg_count_by_two", "SELECT content_type, source_law, count(*) AS row_count FROM c_chunks GROUP BY ALL")
def agg_count_by_two(spark, sf):
    return reports.count_by(inputs.chunks(spark, sf), "content_type", "source_law")


@query("agg_source_coverage", "SELECT source_law, count(*) AS row_count FROM c_chunks GROUP BY ALL")
def agg_source_coverage(spark, sf):
    return reports.count_by(inputs.chunks(spark, sf), "source_law")


_CLASSES = "CASE " + " ".join(
    f"WHEN contains(lower(concat_ws(' ', scheme_name, full_text)), '{words[0]}') THEN '{name}'"
    for name, words in fixed.BENEFICIARY_CLASSES) + " ELSE 'General' END"


@query("agg_collect_by_class", f"""SELECT category, max(total) AS scheme_count, string_agg(scheme_name, '|' ORDER BY scheme_name, source_file) AS schemes
FROM (SELECT *, count(*) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY scheme_name, source_file) AS rn
  FROM (SELECT *, {_CLASSES} AS category FROM c_schemes WHERE scheme_name IS NOT NULL)) GROUP BY category""")
def agg_collect_by_class(spark, sf):
    classed = corpus.classify_schemes(inputs.schemes(spark, sf).where(F.col("scheme_name").isNotNull()))
    collected = reports.collect_by_class(classed, "category", "scheme_name", ["scheme_name", "source_file"])
    return collected.withColumn("schemes", F.array_join("schemes", "|"))



@query("agg_collect_by_class_pages", f"""SELECT category, page, max(total) AS scheme_count, string_agg(scheme_name, '|' ORDER BY rn) AS schemes
FROM (SELECT *, (rn - 1) // 20 + 1 AS page FROM (SELECT *, count(*) OVER (PARTITION BY category) AS total,
  row_number() OVER (PARTITION BY category ORDER BY scheme_name, source_file) AS rn
  FROM (SELECT *, {_CLASSES} AS category FROM c_schemes WHERE scheme_name IS NOT NULL))) GROUP BY category, page""")
def agg_collect_by_class_pages(spark, sf):
    """The class lists of ``agg_collect_by_class`` as pages of at most 20 names."""
    classed = corpus.classify_schemes(inputs.schemes(spark, sf).where(F.col("scheme_name").isNotNull()))
    paged = reports.paged_by_class(classed, "category", "scheme_name", ["scheme_name", "source_file"], page_size=20)
    return paged.withColumn("schemes", F.array_join("schemes", "|"))

# --- windows, sorts, unions --------------------------------------------------------------------
@query("win_global_id", "SELECT filename, row_number() OVER (ORDER BY filename) AS row_id FROM v_raw_docs")
def win_global_id(spark, sf):
    return windows.global_row_number(view(spark, sf, "raw_docs").select("filename"), ["filename"])


@query("win_batch_number", "SELECT filename, (row_number() OVER (ORDER BY filename) - 1) // 50 + 1 AS batch_num FROM v_raw_docs")
def win_batch_number(spark, sf):
    return windows.batch_number(view(spark, sf, "raw_docs").select("filename"), ["filename"], 50)


@query("win_carry_forward_chapter", "SELECT doc_id, page_no, chapter FROM c_chaptered")
def win_carry_forward_chapter(spark, sf):
    return corpus.with_chapters(view(spark, sf, "statute_pages")).select("doc_id", "page_no", "chapter")


@query("srt_recent_logs", """SELECT query_id, intent, agent_used, detected_lang, response_time_ms FROM v_query_logs
ORDER BY timestamp DESC, query_id LIMIT 10""")
def srt_recent_logs(spark, sf):
    return reports.recent(view(spark, sf, "query_logs"), 10).select(
        "query_id", "intent", "agent_used", "detected_lang", "response_time_ms")


@query("srt_topn_by_name", "SELECT source_file, scheme_name FROM c_schemes ORDER BY scheme_name, source_file LIMIT 10")
def srt_topn_by_name(spark, sf):
    return inputs.schemes(spark, sf).where(F.col("scheme_name").isNotNull()).select("source_file", "scheme_name") \
        .orderBy("scheme_name", "source_file").limit(10)


@query("set_union_chunks", """SELECT section_number, title, source_law, 'legal_section' AS content_type FROM c_statute_rows
UNION ALL SELECT '', scheme_name, 'schemes', 'government_scheme' FROM c_schemes""")
def set_union_chunks(spark, sf):
    columns = ["section_number", "title", "source_law", "content_type"]
    whole = inputs.schemes(spark, sf).select(
        F.lit("").alias("section_number"), F.col("scheme_name").alias("title"), F.lit("schemes").alias("source_law"),
        F.lit("government_scheme").alias("content_type"))
    for sections in inputs.statutes(spark, sf).values():
        whole = whole.unionByName(sections.withColumn("content_type", F.lit("legal_section")).select(*columns))
    return whole


# --- scalar functions --------------------------------------------------------------------------
@query("fn_squeeze_whitespace", f"SELECT doc_id, {squeezed('text')} AS text FROM documents")
def fn_squeeze_whitespace(spark, sf):
    return tables.read_table(spark, sf, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("text"))


@query("fn_truncate", """SELECT doc_id, left(text, 5000) AS t5000, left(text, 500) AS t500, left(text, 200) AS t200 FROM documents""")
def fn_truncate(spark, sf):
    return tables.read_table(spark, sf, "documents").select(
        "doc_id", *[tx.cut(F.col("text"), n).alias(f"t{n}") for n in (5000, 500, 200)])


@query("fn_char_count", "SELECT doc_id, length(text) AS char_count, length(left(text, 500)) AS kept_chars FROM documents")
def fn_char_count(spark, sf):
    return tables.read_table(spark, sf, "documents").select(
        "doc_id", F.length("text").alias("char_count"), F.length(tx.cut(F.col("text"), 500)).alias("kept_chars"))


@query("fn_regex_fields", "SELECT source_file, scheme_name, ministry, beneficiary_type, state FROM c_schemes")
def fn_regex_fields(spark, sf):
    text = F.col("text")
    return inputs.raw_schemes(spark, sf).select(
        F.col("filename").alias("source_file"), tx.extract(text, fixed.SCHEME_NAME).alias("scheme_name"),
        tx.extract(text, fixed.MINISTRY).alias("ministry"), tx.extract(text, fixed.BENEFICIARY).alias("beneficiary_type"),
        tx.extract(text, fixed.STATE).alias("state"))


@query("fn_parse_amount", "SELECT source_file, income_limit_inr FROM c_schemes")
def fn_parse_amount(spark, sf):
    return inputs.raw_schemes(spark, sf).select(
        F.col("filename").alias("source_file"), tx.amount(F.col("text")).alias("income_limit_inr"))


@query("fn_concat_chunk_text", "SELECT chunk_id, title || ' ' || full_text AS chunk_text FROM c_statute_rows WHERE chunk_id LIKE 'ipc%'")
def fn_concat_chunk_text(spark, sf):
    return inputs.sections(spark, sf).select(
        tx.prefixed_id("ipc_", F.col("section_number")).alias("chunk_id"),
        F.concat_ws(" ", "title", "full_text").alias("chunk_text"))


@query("fn_prefixed_id", "SELECT 'ipc_' || ipc_section AS old_id, 'bns_' || bns_section AS new_id FROM v_section_pairs")
def fn_prefixed_id(spark, sf):
    return view(spark, sf, "section_pairs").select(
        tx.prefixed_id("ipc_", F.col("ipc_section")).alias("old_id"),
        tx.prefixed_id("bns_", F.col("bns_section")).alias("new_id"))


@query("fn_change_detail", "SELECT ipc_section, change_detail, impact_for_citizen FROM c_mapping")
def fn_change_detail(spark, sf):
    change = F.col("change_type")
    return view(spark, sf, "section_pairs").select(
        "ipc_section", tx.change_detail(change, F.col("ipc_section"), F.col("bns_section")).alias("change_detail"),
        tx.change_impact(change).alias("impact_for_citizen"))


@query("fn_similarity", "SELECT event_id, round(1 / (1 + value), 4) AS similarity FROM events")
def fn_similarity(spark, sf):
    return tables.read_table(spark, sf, "events").select("event_id", tx.similarity(F.col("value")).alias("similarity"))


@query("fn_extract_section_ref", f"SELECT question_id, {found('question', fixed.SECTION_REFERENCE)} AS section_ref FROM v_questions")
def fn_extract_section_ref(spark, sf):
    return view(spark, sf, "questions").select(
        "question_id", tx.section_reference(F.col("question")).alias("section_ref"))


@query("fn_all_section_refs", r"""SELECT page_number, section_number, list_extract(refs, 1) AS first_ref, array_to_string(refs, ',') AS all_refs
FROM (SELECT *, regexp_extract_all(full_text || ' replaces Section ' || section_number, 'Section\s+(\d+)', 1) AS refs FROM v_bns_sections)""")
def fn_all_section_refs(spark, sf):
    text = F.concat("full_text", F.lit(" replaces Section "), "section_number")
    refs = tx.cited_sections(text)
    return view(spark, sf, "bns_sections").select(
        "page_number", "section_number", F.try_element_at(refs, F.lit(1)).alias("first_ref"),
        F.array_join(refs, ",").alias("all_refs"))


@query("fn_is_section_number", "SELECT query_id, is_number FROM c_compare")
def fn_is_section_number(spark, sf):
    return view(spark, sf, "compare_queries").select(
        "query_id", tx.is_section_number(F.col("query")).alias("is_number"))


@query("fn_default_if_null", """SELECT source_file, coalesce(ministry, 'Unknown') AS ministry, coalesce(beneficiary_type, 'General') AS beneficiary_type,
  coalesce(state, '') AS state FROM c_schemes""")
def fn_default_if_null(spark, sf):
    return inputs.schemes(spark, sf).select(
        "source_file", tx.or_default(F.col("ministry"), "Unknown").alias("ministry"),
        tx.or_default(F.col("beneficiary_type"), "General").alias("beneficiary_type"),
        tx.or_default(F.col("state"), "").alias("state"))


@query("fn_upper_strip_option", "SELECT item_id, coalesce(upper(trim(correct_answer)), 'A') AS letter FROM v_mcq_questions")
def fn_upper_strip_option(spark, sf):
    return view(spark, sf, "mcq_questions").select("item_id", tx.option_letter(F.col("correct_answer")).alias("letter"))


@query("fn_option_lookup", """SELECT item_id, CASE coalesce(upper(trim(correct_answer)), 'A') WHEN 'A' THEN option_a WHEN 'B' THEN option_b
  WHEN 'C' THEN option_c WHEN 'D' THEN option_d ELSE coalesce(correct_answer, '') END AS correct_text FROM v_mcq_questions""")
def fn_option_lookup(spark, sf):
    answer = F.col("correct_answer")
    options = {name: F.col(f"option_{name.lower()}") for name in "ABCD"}
    return view(spark, sf, "mcq_questions").select(
        "item_id", tx.option_text(tx.option_letter(answer), answer, options).alias("correct_text"))


@query("fn_uuid_now", """SELECT question_id, 36 AS id_chars, 1 AS rows_with_id, 26 AS stamp_chars, true AS stamps_agree FROM v_questions""")
def fn_uuid_now(spark, sf):
    """What holds for made-up ids and times: length, one row for each id, one time for all rows, not NULL."""
    made = view(spark, sf, "questions").select(
        "question_id", F.uuid().alias("query_id"), F.current_timestamp().alias("asked_at"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("extracted_at"))
    return made.select(
        "question_id", F.length("query_id").alias("id_chars"), F.count("*").over(Window.partitionBy("query_id")).alias("rows_with_id"),
        F.length("extracted_at").alias("stamp_chars"),
        (F.date_format("asked_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") == F.col("extracted_at")).alias("stamps_agree"))


# --- text operators ----------------------------------------------------------------------------
@query("txt_ingest_documents", f"""SELECT filename, text, length(text) AS char_count, batch_num
FROM (SELECT *, (row_number() OVER (ORDER BY filename) - 1) // 50 + 1 AS batch_num FROM (
  SELECT filename, string_agg(t, ' ' ORDER BY page_no) FILTER (WHERE t <> '') AS text
  FROM (SELECT filename, page_no, {squeezed('text')} AS t FROM v_doc_pages) GROUP BY filename))
WHERE length(text) > 100""")
def txt_ingest_documents(spark, sf):
    return corpus.ingest_documents(view(spark, sf, "doc_pages")).select("filename", "text", "char_count", "batch_num")


@query("txt_split_paragraphs", "SELECT doc_id, page_no, paragraph_no, paragraph FROM c_paragraphs")
def txt_split_paragraphs(spark, sf):
    return corpus.paragraphs(view(spark, sf, "statute_pages")).select("doc_id", "page_no", "paragraph_no", "paragraph")


@query("txt_chapter_heading", f"""SELECT doc_id, page_no, 'CHAPTER ' || {found('text', fixed.CHAPTER)} AS chapter
FROM v_statute_pages""")
def txt_chapter_heading(spark, sf):
    return view(spark, sf, "statute_pages").select("doc_id", "page_no", tx.chapter_heading(F.col("text")).alias("chapter"))


@query("txt_extract_sections", "SELECT * FROM c_sections")
def txt_extract_sections(spark, sf):
    return inputs.sections(spark, sf)


@query("txt_keywords", f"""SELECT page_number, {phrases("title || ' ' || full_text")} AS keywords FROM v_bns_sections
UNION ALL SELECT doc_id, {phrases("source || ' ' || text")} FROM documents""")
def txt_keywords(spark, sf):
    sections = view(spark, sf, "bns_sections").select(
        "page_number", tx.keywords(F.col("title"), F.col("full_text")).alias("keywords"))
    documents = tables.read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_number"), tx.keywords(F.col("source"), F.col("text")).alias("keywords"))
    return sections.unionByName(documents)


@query("txt_scheme_table", "SELECT * FROM c_schemes")
def txt_scheme_table(spark, sf):
    return inputs.schemes(spark, sf)


@query("txt_mapping_table", "SELECT * FROM c_mapping")
def txt_mapping_table(spark, sf):
    return inputs.mapping(spark, sf)


@query("txt_unified_chunks", "SELECT * FROM c_chunks")
def txt_unified_chunks(spark, sf):
    return inputs.built_chunks(spark, sf)


@query("txt_script_language", r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[À-ɏ]')) >= 0.05 * len(regexp_extract_all(text, '[\p{L}\p{M}]'))
  AND len(regexp_extract_all(text, '[\p{L}\p{M}]')) > 0 THEN 'accented' ELSE 'plain' END AS flag FROM documents""")
def txt_script_language(spark, sf):
    flag = tx.script_flag(F.col("text"), r"[\x{00C0}-\x{024F}]", 0.05, "accented", "plain")
    return tables.read_table(spark, sf, "documents").select("doc_id", flag.alias("flag"))


def _ladder_sql(text: str, rungs, default: str) -> str:
    tests = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{word}')" for word in words) + f" THEN '{name}'"
        for name, words in rungs)
    return f"CASE {tests} ELSE '{default}' END"


@query("txt_classify_intent", f"""SELECT question_id, {_ladder_sql('question', fixed.AGENT_LADDER, 'legal_question')} AS agent_intent,
  {_ladder_sql('question', fixed.APP_LADDER, 'legal_query')} AS app_intent FROM v_questions""")
def txt_classify_intent(spark, sf):
    question = F.col("question")
    return view(spark, sf, "questions").select(
        "question_id", tx.ladder(question, fixed.AGENT_LADDER, fixed.AGENT_DEFAULT).alias("agent_intent"),
        tx.ladder(question, fixed.APP_LADDER, fixed.APP_DEFAULT).alias("app_intent"))


@query("txt_classify_beneficiary", f"SELECT source_file, beneficiary_type, {_CLASSES} AS category FROM c_schemes")
def txt_classify_beneficiary(spark, sf):
    return corpus.classify_schemes(inputs.schemes(spark, sf)).select("source_file", "beneficiary_type", "category")


@query("txt_extract_info", f"""SELECT source_file, {found('full_text', fixed.BENEFICIARY)} AS beneficiary, {amount('full_text')} AS income_limit,
  array_to_string(regexp_extract_all(full_text, '{fixed.DOCUMENT_NAMES}', 1), '|') AS documents
FROM c_schemes""")
def txt_extract_info(spark, sf):
    info = corpus.extract_info(inputs.schemes(spark, sf))
    return info.select("source_file", "extracted_info.beneficiary", "extracted_info.income_limit",
                       F.array_join("extracted_info.documents", "|").alias("documents"))


_MAP = {"old": "ipc_section", "old_title": "ipc_title", "new": "bns_section", "new_title": "bns_title", "change": "change_type", "detail": "change_detail"}
_EXPLAIN = filled(fixed.EXPLAIN_CHANGE_PROMPT, **_MAP)


@query("txt_prompt_assembly", f"""SELECT m.ipc_section, {_EXPLAIN} AS explain_prompt, {filled(fixed.COMPARE_PROMPT, **_MAP)} AS compare_prompt,
  {filled(fixed.SUMMARY_PROMPT, number='ipc_section', title='ipc_title', text='change_detail')} AS summary_prompt,
  {quoted(fixed.ASSISTANT_ROLE + fixed.PROMPT_CONTEXT)} || change_detail || {quoted(fixed.PROMPT_QUESTION)} || ipc_title || {quoted(fixed.PROMPT_ANSWER)} AS question_prompt
FROM c_mapping m""")
def txt_prompt_assembly(spark, sf):
    old, title, detail = F.col("ipc_section"), F.col("ipc_title"), F.col("change_detail")
    return inputs.mapping(spark, sf).select(
        "ipc_section",
        tx.fill(fixed.EXPLAIN_CHANGE_PROMPT, old=old, old_title=title, new=F.col("bns_section"),
                change=F.col("change_type"), detail=detail).alias("explain_prompt"),
        tx.fill(fixed.COMPARE_PROMPT, old=old, old_title=title, new=F.col("bns_section"), new_title=F.col("bns_title"),
                change=F.col("change_type"), detail=detail).alias("compare_prompt"),
        tx.fill(fixed.SUMMARY_PROMPT, number=old, title=title, text=detail).alias("summary_prompt"),
        tx.prompt(title, detail).alias("question_prompt"))


@query("txt_scheme_prompts", f"""SELECT source_file, {filled(fixed.CLASSIFY_PROMPT, name='scheme_name', text='full_text')} AS classify_prompt,
  {filled(fixed.EXTRACT_PROMPT, name='scheme_name', text='full_text')} AS extract_prompt FROM c_schemes""")
def txt_scheme_prompts(spark, sf):
    classified = prompts.classify_schemes(inputs.schemes(spark, sf)).withColumnRenamed("prompt", "classify_prompt")
    both = prompts.extract_from_schemes(classified).withColumnRenamed("prompt", "extract_prompt")
    return both.select("source_file", "classify_prompt", "extract_prompt")


@query("txt_section_prompts", f"""SELECT page_number, paragraph_no, doc_id,
  {filled(fixed.SUMMARY_PROMPT, number='section_number', title='title', text='full_text')} AS prompt FROM c_sections""")
def txt_section_prompts(spark, sf):
    return prompts.summarize_sections(inputs.sections(spark, sf)).select("page_number", "paragraph_no", "doc_id", "prompt")


_REPLY = """CASE question_id % 3 WHEN 0 THEN 'Q: ' || question || ' Answer: first. Answer:  ' || question || ' '
  WHEN 1 THEN question || ' उत्तर: ' || question ELSE question || '  plain reply ' END"""


@query("txt_answer_cleanup", f"""SELECT question_id, trim(CASE WHEN contains(reply, 'Answer:') THEN string_split(reply, 'Answer:')[-1]
  WHEN contains(reply, 'उत्तर:') THEN string_split(reply, 'उत्तर:')[-1] ELSE substring(reply, length(question) + 1) END, chr(9) || chr(10) || chr(13) || ' ') AS answer
FROM (SELECT *, {_REPLY} AS reply FROM v_questions)""")
def txt_answer_cleanup(spark, sf):
    replies = view(spark, sf, "questions").withColumn("reply", F.expr(_REPLY))
    return replies.select("question_id", tx.clean_answer(F.col("reply"), F.col("question")).alias("answer"))


@query("txt_template_answer", f"""SELECT page_number, CASE WHEN section_number % 2 = 0 THEN
  {filled(fixed.TEMPLATE_ANSWER, section=found('full_text', fixed.CITED_SECTION), question='lower(title)')} ELSE {quoted(fixed.TEMPLATE_ANSWER_PLAIN)} END AS answer
FROM (SELECT page_number, section_number::bigint AS section_number, title, full_text FROM v_bns_sections)""")
def txt_template_answer(spark, sf):
    even = F.col("section_number").cast("bigint") % 2 == 0
    context = F.when(even, F.col("full_text")).otherwise(F.lit(""))
    return view(spark, sf, "bns_sections").select(
        "page_number", tx.template_answer(F.col("title"), context).alias("answer"))


def _first_words(texts):
    return [" ".join(t.split()[-3:]) for t in texts]


def _one_word(texts):
    return [" Student " if "student" in t else "Women" if "women" in t else "" for t in texts]


@query("txt_model_replies", """SELECT page_number, paragraph_no, doc_id, array_to_string(list_slice(words, -3, -1), ' ') AS reply, 'mine' AS model_used
FROM (SELECT *, list_filter(regexp_split_to_array(full_text, '\\s+'), lambda w: w <> '') AS words FROM c_sections)""")
def txt_model_replies(spark, sf):
    scored = prompts.replies(prompts.summarize_sections(inputs.sections(spark, sf)), [("mine", _first_words)])
    return scored.select("page_number", "paragraph_no", "doc_id", "reply", "model_used")


@query("txt_explain_changes", f"SELECT ipc_section, count(*) AS n, max(length({_EXPLAIN})) AS longest FROM c_mapping GROUP BY ipc_section")
def txt_explain_changes(spark, sf):
    scored = prompts.replies(prompts.explain_changes(inputs.mapping(spark, sf)), [("mine", lambda texts: [str(len(t)) for t in texts])])
    return scored.groupBy("ipc_section").agg(F.count("*").alias("n"), F.max(F.col("reply").cast("int")).alias("longest"))


@query("agg_model_classes", """SELECT category, count(*) AS scheme_count, string_agg(scheme_name, '|' ORDER BY scheme_name, source_file) AS schemes
FROM (SELECT *, CASE WHEN contains(full_text, 'student') THEN 'Student' WHEN contains(full_text, 'women') THEN 'Women' ELSE 'General' END AS category
  FROM c_schemes WHERE scheme_name IS NOT NULL) GROUP BY category""")
def agg_model_classes(spark, sf):
    counted = prompts.model_class_counts(inputs.schemes(spark, sf), [("mine", _one_word)])
    return counted.withColumn("schemes", F.array_join("schemes", "|"))
