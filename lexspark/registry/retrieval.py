"""Vectors, retrieval, answers, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions import text as tx
from lexspark.operators import ann, reports
from lexspark.operators.eligibility import eligible, eligible_by_state
from lexspark.operators.embedding import embed, embed_incremental, embedded, hashed_counts, text_similarity
from lexspark.operators.vectors import filter_after_ranking, nearest
from lexspark.operators.windows import top_k
from lexspark.plans import answers
from lexspark.registry import inputs
from lexspark.registry.base import filled, query, quoted, step
from lexspark.registry.relational import _ladder_sql
from lexspark.registry.steps import found, neighbours, vectors
from lexspark.registry.views import view


def _stored_neighbours(spark, sf, k=5, wanted=None):
    stored = view(spark, sf, "chunk_vectors")
    return nearest(stored, stored, k, query_id="vec_id", wanted=wanted)


# --- vectors -----------------------------------------------------------------------------------
@query("vec_knn", "SELECT vec_id, chunk_id, rank, round(distance, 6) AS distance, similarity FROM c_knn")
def vec_knn(spark, sf):
    return _stored_neighbours(spark, sf).withColumn("distance", F.round("distance", 6))


@query("vec_knn_filtered", """SELECT vec_id, chunk_id, rank, round(1 / (1 + distance), 4) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, chunk_id) AS rank FROM c_pairs WHERE source_law = wanted) WHERE rank <= 5""")
def vec_knn_filtered(spark, sf):
    return _stored_neighbours(spark, sf, wanted="wanted").drop("distance")


@query("vec_knn_ivfpq")
def vec_knn_ivfpq(spark, sf):
    """Approximate 5 nearest of every stored vector whose id is divisible by 50, against all: inverted file over
    product-quantised residuals, exact re-ranking; ``scanned`` is the number of index rows each query read.
    Approximate by design, so no SQL: tests measure recall@5 against the exact query."""
    stored = view(spark, sf, "chunk_vectors")
    books = ann.fit(stored)
    coded = ann.index(stored, books)
    asked = stored.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = ann.search(asked, stored, books, coded, 5)
    names = stored.select(F.col("vec_id").alias("id"), "chunk_id")
    return found.join(names, "id").select(F.col("query_id").alias("vec_id"), "chunk_id", "rank", F.round("distance", 6).alias("distance"), "scanned")


@query("vec_knn_cells", "SELECT vec_id, chunk_id, rank, round(distance, 6) AS distance, similarity FROM c_knn")
def vec_knn_cells(spark, sf):
    """The way for query tables that are too large to be broadcast."""
    stored = view(spark, sf, "chunk_vectors")
    return nearest(stored, stored, 5, query_id="vec_id", broadcast_bytes=0).withColumn("distance", F.round("distance", 6))


@query("vec_knn_filtered_cells", """SELECT vec_id, chunk_id, rank, round(1 / (1 + distance), 4) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, chunk_id) AS rank FROM c_pairs WHERE source_law = wanted) WHERE rank <= 5""")
def vec_knn_filtered_cells(spark, sf):
    stored = view(spark, sf, "chunk_vectors")
    return nearest(stored, stored, 5, query_id="vec_id", wanted="wanted", broadcast_bytes=0).drop("distance")


@query("win_topk_per_query", """SELECT user_id, rank, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def win_topk_per_query(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    return top_k(events, ["user_id"], [F.desc("value"), "event_id"], 5)


@query("flt_post_type_topn", """SELECT vec_id, chunk_id, similarity, row_number() OVER (PARTITION BY vec_id ORDER BY rank) AS rank
FROM c_knn WHERE content_type = 'legal_section' QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rank) <= 3""")
def flt_post_type_topn(spark, sf):
    kinds = view(spark, sf, "chunk_vectors").select("chunk_id", "content_type")
    ranked = _stored_neighbours(spark, sf).join(kinds, "chunk_id")
    kept = filter_after_ranking(ranked, F.col("content_type") == "legal_section", 3, "vec_id")
    return kept.select("vec_id", "chunk_id", "similarity", "rank")


@query("agg_collection_stats", """SELECT count(*) AS vectors, max(len(embedding)) AS dimension, 'hashed' AS embedding_model,
  'chunks' AS source_table FROM embeddings""")
def agg_collection_stats(spark, sf):
    return reports.collection_stats(view(spark, sf, "chunk_vectors"), "hashed", "chunks")


@query("agg_distinct_sources", """SELECT vec_id, array_to_string(list_sort(list(DISTINCT source_law)), ',') AS source_laws,
  string_agg(chunk_id, ',' ORDER BY rank) AS chunks_cited FROM c_knn GROUP BY vec_id""")
def agg_distinct_sources(spark, sf):
    laws = view(spark, sf, "chunk_vectors").select("chunk_id", "source_law")
    grouped = reports.distinct_sources(_stored_neighbours(spark, sf).join(laws, "chunk_id"), "vec_id")
    return grouped.select("vec_id", F.array_join("source_laws", ",").alias("source_laws"),
                          F.array_join("chunks_cited", ",").alias("chunks_cited"))


@query("vec_embed_batch", """SELECT l.k AS chunk_id, round(l.len2, 6) AS squared_length, coalesce(string_agg(v.bucket || ':' || round(v.weight, 6), ',' ORDER BY v.bucket), '') AS entries
FROM c_chunk_vec_len l LEFT JOIN c_chunk_vec v ON v.k = l.k GROUP BY ALL""")
def vec_embed_batch(spark, sf):
    rows = embedded(embed(inputs.chunks(spark, sf)))
    vector = F.col("embedding")
    entries = F.filter(F.transform(vector, lambda x, i: F.when(
        x != 0, F.concat(i.cast("string"), F.lit(":"), F.round(x, 6).cast("string")))), lambda e: e.isNotNull())
    squared = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("chunk_id", F.round(squared, 6).alias("squared_length"), F.array_join(entries, ",").alias("entries"))


vectors("c_v1_vec", "v_chunks_v1", "chunk_id", "chunk_text")
vectors("c_v2_vec", "v_chunks_v2", "chunk_id", "chunk_text")
step("c_v2_embedded", "SELECT l.k, l.len2, count(v.bucket) AS filled FROM c_v2_vec_len l LEFT JOIN c_v2_vec v ON v.k = l.k GROUP BY ALL")


@query("vec_embed_incremental", """SELECT n.chunk_id, e.filled, round(e.len2, 6) AS squared_length,
  CASE WHEN o.chunk_text = n.chunk_text THEN 'kept' ELSE 'embedded' END AS origin
FROM v_chunks_v2 n LEFT JOIN v_chunks_v1 o ON o.chunk_id = n.chunk_id JOIN c_v2_embedded e ON e.k = n.chunk_id""")
def vec_embed_incremental(spark, sf):
    old, new = view(spark, sf, "chunks_v1"), view(spark, sf, "chunks_v2")
    whole = embed_incremental(embedded(embed(old)), old, new)
    filled = F.size(F.filter("embedding", lambda x: x != 0)).alias("filled")
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return whole.select("chunk_id", filled, F.round(squared, 6).alias("squared_length"), "origin")


def _failing_on_edits(texts):
    if any(text.startswith("edited ") for text in texts):
        raise ValueError("no edited texts")
    return hashed_counts()(texts)


@query("vec_embed_failures", """SELECT n.chunk_id, CASE WHEN n.chunk_text LIKE 'edited %' THEN 'failed' ELSE 'ok' END AS embed_status,
  CASE WHEN n.chunk_text LIKE 'edited %' THEN 'ValueError: no edited texts' END AS embed_error,
  CASE WHEN o.chunk_text = n.chunk_text THEN 'kept' ELSE 'embedded' END AS origin
FROM v_chunks_v2 n LEFT JOIN v_chunks_v1 o ON o.chunk_id = n.chunk_id""")
def vec_embed_failures(spark, sf):
    """A pass in which some batches fail: no chunk is lost, and each failure has its reason."""
    old, new = view(spark, sf, "chunks_v1"), view(spark, sf, "chunks_v2")
    whole = embed_incremental(embedded(embed(old)), old, new, _failing_on_edits, batch_size=1, tries=1)
    return whole.select("chunk_id", "embed_status", "embed_error", "origin")


@query("vec_embed_retried", """SELECT n.chunk_id, e.filled, 'ok' AS embed_status,
  CASE WHEN n.chunk_text LIKE 'edited %' THEN 'embedded' ELSE 'kept' END AS origin
FROM v_chunks_v2 n JOIN c_v2_embedded e ON e.k = n.chunk_id""")
def vec_embed_retried(spark, sf):
    """The next pass over the same snapshot embeds what failed before, and only that."""
    old, new = view(spark, sf, "chunks_v1"), view(spark, sf, "chunks_v2")
    first = embed_incremental(embedded(embed(old)), old, new, _failing_on_edits, batch_size=1, tries=1)
    whole = embed_incremental(first, new, new)
    return whole.select("chunk_id", F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"), "embed_status", "origin")


_TOPIC = "what does the retail price of a small ring say"
step("c_topic", f"SELECT 0 AS id, '{_TOPIC}' AS question")
vectors("c_topic_vec", "c_topic", "id", "question")
step("c_section_text", "SELECT doc_id || '/' || page_number || '/' || paragraph_no AS id, title || ' ' || full_text AS text FROM c_sections")
vectors("c_section_vec", "c_section_text", "id", "text")
step("c_topic_scores", """SELECT l.k AS id, round(coalesce(sum(v.weight * t.weight), 0), 4) AS similarity_score
FROM c_section_vec_len l LEFT JOIN c_section_vec v ON v.k = l.k LEFT JOIN c_topic_vec t ON t.bucket = v.bucket GROUP BY ALL""")


def _topic_scores(spark, sf):
    sections = inputs.sections(spark, sf).withColumn(
        "id", F.concat_ws("/", "doc_id", F.col("page_number").cast("string"), F.col("paragraph_no").cast("string")))
    return text_similarity(sections, _TOPIC, ["title", "full_text"])


@query("vec_text_similarity", "SELECT id, similarity_score FROM c_topic_scores")
def vec_text_similarity(spark, sf):
    return _topic_scores(spark, sf).select("id", "similarity_score")


@query("srt_topn_by_score", "SELECT id, similarity_score FROM c_topic_scores ORDER BY similarity_score DESC, id LIMIT 5")
def srt_topn_by_score(spark, sf):
    return _topic_scores(spark, sf).select("id", "similarity_score").orderBy(F.desc("similarity_score"), "id").limit(5)


# --- keyword searches --------------------------------------------------------------------------
step("c_keyword_hits", """SELECT s.question_id, c.*, row_number() OVER (PARTITION BY s.question_id ORDER BY c.chunk_id) AS rank
FROM v_searches s JOIN c_chunks c ON contains(c.chunk_text, s.question) OR contains(c.title, s.question)""")


@query("flt_keyword_search", """SELECT question_id, rank, chunk_id, title, chunk_text, 0.0::double AS similarity FROM c_keyword_hits WHERE rank <= 5""")
def flt_keyword_search(spark, sf):
    return answers.keyword_search(view(spark, sf, "searches"), inputs.chunks(spark, sf), 5).select(
        "question_id", "rank", "chunk_id", "title", "chunk_text", "similarity")


@query("flt_first_keyword_search", r"""SELECT question_id, rank, keyword, chunk_id, chunk_text, source_law, 0.75::double AS similarity FROM (
  SELECT k.question_id, k.keyword, c.chunk_id, c.chunk_text, c.source_law,
    row_number() OVER (PARTITION BY k.question_id ORDER BY c.chunk_id) AS rank
  FROM (SELECT question_id, wanted, coalesce(list_extract(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: length(w) > 3), 1),
      'section') AS keyword FROM v_searches) k
  JOIN c_chunks c ON contains(lower(c.chunk_text), k.keyword) AND (k.wanted IS NULL OR k.wanted = c.source_law)) WHERE rank <= 5""")
def flt_first_keyword_search(spark, sf):
    found = answers.first_keyword_search(view(spark, sf, "searches"), inputs.chunks(spark, sf), 5, "wanted")
    return found.select("question_id", "rank", "keyword", "chunk_id", "chunk_text", "source_law", "similarity")


@query("vec_hybrid", """SELECT query_id AS question_id, rank, chunk_id, similarity, 'semantic' AS found_by FROM c_search_near
UNION ALL SELECT question_id, rank, chunk_id, 0.0::double, 'keyword' FROM c_keyword_hits
WHERE rank <= 5 AND question_id NOT IN (SELECT query_id FROM c_search_near)""")
def vec_hybrid(spark, sf):
    found = answers.hybrid(view(spark, sf, "searches"), inputs.chunk_vectors(spark, sf), 5, wanted="wanted")
    return found.select("question_id", "rank", "chunk_id", "similarity", "found_by")


# --- eligibility -------------------------------------------------------------------------------
@query("flt_eligibility", "SELECT * FROM c_eligible")
def flt_eligibility(spark, sf):
    return eligible(view(spark, sf, "profiles"), inputs.schemes(spark, sf))


@query("flt_eligibility_simple", """SELECT * FROM (SELECT p.profile_id, row_number() OVER (PARTITION BY p.profile_id ORDER BY s.scheme_name, s.source_file) AS rank,
  s.source_file, s.scheme_name, coalesce(s.ministry, 'Unknown') AS ministry, coalesce(s.beneficiary_type, 'General') AS beneficiary_type
FROM v_profiles p JOIN c_schemes s ON p.state = 'All India' OR s.state = p.state OR s.state = 'All India' OR s.state IS NULL
WHERE s.scheme_name IS NOT NULL) WHERE rank <= 10""")
def flt_eligibility_simple(spark, sf):
    return eligible_by_state(view(spark, sf, "profiles"), inputs.schemes(spark, sf))


# --- contexts and answers ----------------------------------------------------------------------
_CONTEXT = """'[' || rank || '] ' || source_law || ' Section ' || section_number || ': ' || title || chr(10) || chunk_text"""
step("c_context", f"""SELECT question_id, string_agg({_CONTEXT}, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(source_law || '/' || section_number || '/' || title || '/' || format('{{:.4f}}', similarity), '|' ORDER BY rank) AS sources,
  'Based on the retrieved legal context:' || chr(10) || chr(10) || string_agg(rank || '. ' || source_law || ' Section ' || section_number || ': ' || title || chr(10), '' ORDER BY rank) AS listing
FROM c_results GROUP BY question_id""")


def _contexts(spark, sf):
    return answers.context(view(spark, sf, "questions"), inputs.results(spark, sf))


@query("rag_context", """SELECT q.question_id, c.context, c.sources, c.context IS NOT NULL AS found
FROM v_questions q LEFT JOIN c_context c USING (question_id)""")
def rag_context(spark, sf):
    line = lambda s: F.concat_ws("/", s.source_law, s.section_number, s.title, F.format_number(s.similarity, 4))
    return _contexts(spark, sf).select(
        "question_id", "context", F.array_join(F.transform("sources", line), "|").alias("sources"), "found")


@query("win_context_numbering", f"SELECT question_id, rank, {_CONTEXT} AS block FROM c_results")
def win_context_numbering(spark, sf):
    block = tx.fill("[{rank}] {law} Section {number}: {title}\n{text}", rank=F.col("rank"), law=F.col("source_law"),
                    number=F.col("section_number"), title=F.col("title"), text=F.col("chunk_text"))
    return inputs.results(spark, sf).select("question_id", "rank", block.alias("block"))


@query("txt_sources_answer", "SELECT question_id, listing AS answer FROM c_context")
def txt_sources_answer(spark, sf):
    contexts = _contexts(spark, sf).where("found")
    return contexts.select("question_id", tx.sources_answer(F.col("sources")).alias("answer"))


def _failing(prompts):
    raise RuntimeError("not reachable")


def _last_line(prompts):
    return [f"{len(p)} characters: {p.splitlines()[-1]}" for p in prompts]


@query("rag_score_model", f"""SELECT question_id, length(prompt) || ' characters: ' || {quoted(fixed.GROUNDED_PROMPT.splitlines()[-1])} AS answer, 'second' AS model_used
FROM (SELECT q.question_id, {filled(fixed.GROUNDED_PROMPT, context='c.context', question='q.question')} AS prompt FROM v_questions q JOIN c_context c USING (question_id))""")
def rag_score_model(spark, sf):
    scored = answers.answer_from_context(_contexts(spark, sf), [("first", _failing), ("second", _last_line)])
    return scored.select("question_id", "answer", "model_used")


def _legal_steps(prefix: str, results: str, questions: str = "v_questions") -> None:
    """Steps with the legal answer of every question, from its ranked results."""
    step(f"{prefix}_cited", f"""SELECT question_id, string_agg('[' || source_law || ' Section ' || section_number || '] ' || title || ':' || chr(10) || chunk_text,
    chr(10) || chr(10) ORDER BY rank) AS context, string_agg(section_number, ',' ORDER BY rank) AS cited,
  array_to_string(list_sort(list(DISTINCT source_law)), ',') AS laws
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rn FROM {results} WHERE content_type = 'legal_section') WHERE rn <= 3 GROUP BY question_id""")
    step(f"{prefix}_full", rf"""SELECT q.question_id, q.question, coalesce(c.context, '') || CASE WHEN s.section_number IS NULL THEN '' ELSE
    chr(10) || chr(10) || '[Direct lookup] BNS Section ' || s.section_number || ': ' || s.full_text END AS context,
  coalesce(c.cited, '') AS sections_cited, coalesce(c.laws, '') AS source_laws
FROM {questions} q LEFT JOIN {prefix}_cited c USING (question_id)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY section_number ORDER BY source_law, title, full_text) AS rn FROM v_bns_sections) s
  ON s.rn = 1 AND s.section_number = {found('q.question', fixed.SECTION_REFERENCE)}""")
    step(prefix, rf"""SELECT question_id, context, sections_cited, source_laws, {_template_sql('question', 'context')} AS answer FROM {prefix}_full""")


def _template_sql(question: str, context: str) -> str:
    first = found(context, fixed.CITED_SECTION)
    return f"""CASE WHEN {first} IS NULL THEN {quoted(fixed.TEMPLATE_ANSWER_PLAIN)} ELSE {filled(fixed.TEMPLATE_ANSWER, section=first, question=f'lower({question})')} END"""


_legal_steps("c_legal", "c_results")


@query("rag_legal_answer", "SELECT * FROM c_legal")
def rag_legal_answer(spark, sf):
    made = answers.legal_answers(view(spark, sf, "questions"), inputs.chunk_vectors(spark, sf),
                                 view(spark, sf, "bns_sections"))
    return made.select("question_id", "context", F.array_join("sections_cited", ",").alias("sections_cited"),
                       F.array_join("source_laws", ",").alias("source_laws"), "answer")


@query("rag_scheme_answer", f"""SELECT p.profile_id, coalesce(e.found, 0) AS total_found, coalesce(e.names, '') AS eligible_schemes,
  {filled(fixed.SCHEME_PROMPT, occupation='p.occupation', state='p.state', income='p.income', category='p.category', schemes='e.lines')} AS prompt,
  {filled(fixed.SCHEME_SUMMARY, found='coalesce(e.found, 0)', occupation='p.occupation', state='p.state')} AS answer
FROM v_profiles p LEFT JOIN (SELECT profile_id, count(*) AS found, string_agg(scheme_name || '/' || ministry, '|' ORDER BY rank) AS names,
  string_agg('Scheme: ' || scheme_name || ' | Ministry: ' || ministry || ' | ' || preview, chr(10) ORDER BY rank) AS lines
  FROM c_eligible GROUP BY profile_id) e USING (profile_id)""")
def rag_scheme_answer(spark, sf):
    made = answers.scheme_answers(view(spark, sf, "profiles"), inputs.schemes(spark, sf))
    names = F.array_join(F.transform("eligible_schemes", lambda s: F.concat_ws("/", s["name"], s.ministry)), "|")
    return made.select("profile_id", "total_found", names.alias("eligible_schemes"), "prompt", "answer")


step("c_direct", """SELECT query_id, ipc_section, ipc_title, bns_section, bns_title, change_type, change_detail, impact_for_citizen FROM c_by_number
UNION ALL SELECT query_id, ipc_section, ipc_title, bns_section, bns_title, change_type, change_detail, impact_for_citizen FROM c_by_topic WHERE rank = 1""")
step("c_undecided", f"""SELECT query_id, {filled(fixed.COMPARE_RETRIEVAL_TEXT, query='query')} AS question FROM v_compare_queries
WHERE query_id NOT IN (SELECT query_id FROM c_direct)""")
vectors("c_undecided_vec", "c_undecided", "query_id", "question")
neighbours("c_undecided_near", "c_undecided_vec", "c_chunk_vec", 3)
step("c_compared", f"""SELECT q.query_id, d.query_id IS NOT NULL AS found_direct_match, d.ipc_section, d.bns_section, d.change_type, d.impact_for_citizen,
  coalesce(n.context, '') AS context, CASE WHEN d.query_id IS NOT NULL THEN {quoted(fixed.TEMPLATE_ANSWER_PLAIN)}
    ELSE {_template_sql(filled(fixed.COMPARE_FALLBACK_PROMPT, query='q.query'), "coalesce(n.context, '')")} END AS explanation
FROM v_compare_queries q LEFT JOIN c_direct d ON d.query_id = q.query_id
LEFT JOIN (SELECT n.query_id, string_agg(c.chunk_text, chr(10) ORDER BY n.rank) AS context FROM c_undecided_near n JOIN c_chunks c USING (chunk_id)
  GROUP BY n.query_id) n ON n.query_id = q.query_id""")


@query("rag_compare_answer", "SELECT * FROM c_compared")
def rag_compare_answer(spark, sf):
    made = answers.compare_answers(view(spark, sf, "compare_queries"), inputs.mapping(spark, sf),
                                   inputs.chunk_vectors(spark, sf))
    return made.select("query_id", "found_direct_match", "ipc_section", "bns_section", "change_type",
                       "impact_for_citizen", "context", "explanation")


# --- routing -----------------------------------------------------------------------------------
_DEFAULTS = ", ".join(f"coalesce({c}, {v!r}) AS {c}" for c, v in fixed.PROFILE_DEFAULTS.items())
step("c_routed", f"""SELECT * REPLACE ({_DEFAULTS}), CASE WHEN intent = 'scheme_eligibility' AND coalesce(state, income::varchar, occupation, category) IS NOT NULL THEN 'SchemeAgent'
  WHEN intent = 'law_comparison' THEN 'DiffAgent' ELSE 'BNSAgent' END AS agent_used
FROM (SELECT *, {_ladder_sql('question', fixed.AGENT_LADDER, 'legal_question')} AS intent,
  CASE WHEN len(regexp_extract_all(question, '[\\x{{900}}-\\x{{97F}}]')) >= 0.5 * len(regexp_extract_all(question, '[\\p{{L}}\\p{{M}}]'))
    AND len(regexp_extract_all(question, '[\\p{{L}}\\p{{M}}]')) > 0 THEN 'hi' ELSE 'en' END AS detected_lang FROM v_routed_questions)""")
step("c_routed_eligible", """SELECT question_id, count(*) AS found FROM (
  SELECT r.question_id, row_number() OVER (PARTITION BY r.question_id ORDER BY s.scheme_name, s.source_file) AS rank
  FROM c_routed r JOIN c_schemes s ON r.agent_used = 'SchemeAgent'
    AND (contains(lower(s.state), 'all') OR contains(lower(s.state), lower(r.state)) OR s.state IS NULL)
    AND (s.income_limit_inr IS NULL OR s.income_limit_inr >= r.income)
    AND (contains(lower(s.beneficiary_type), lower(r.occupation)) OR contains(lower(s.beneficiary_type), 'general') OR s.beneficiary_type IS NULL))
WHERE rank <= 10 GROUP BY question_id""")
step("c_routed_undecided", f"""SELECT question_id, {filled(fixed.COMPARE_RETRIEVAL_TEXT, query='question')} AS question FROM c_routed WHERE agent_used = 'DiffAgent'""")
vectors("c_routed_vec", "c_routed_undecided", "question_id", "question")
neighbours("c_routed_near", "c_routed_vec", "c_chunk_vec", 3)
step("c_routed_context", """SELECT n.query_id AS question_id, string_agg(c.chunk_text, chr(10) ORDER BY n.rank) AS context
FROM c_routed_near n JOIN c_chunks c USING (chunk_id) GROUP BY n.query_id""")


def _routed(spark, sf):
    return answers.route(view(spark, sf, "routed_questions"), inputs.chunk_vectors(spark, sf),
                         view(spark, sf, "bns_sections"), inputs.schemes(spark, sf), inputs.mapping(spark, sf))


step("c_route", f"""SELECT r.question_id, r.detected_lang, r.intent, r.agent_used,
  CASE r.agent_used WHEN 'BNSAgent' THEN l.answer WHEN 'SchemeAgent' THEN {filled(fixed.SCHEME_SUMMARY, found='coalesce(e.found, 0)', occupation='r.occupation', state='r.state')}
    ELSE {_template_sql(filled(fixed.COMPARE_FALLBACK_PROMPT, query='r.question'), "coalesce(n.context, '')")} END AS answer,
  CASE WHEN r.agent_used = 'BNSAgent' THEN l.sections_cited END AS sections_cited,
  CASE WHEN r.agent_used = 'SchemeAgent' THEN coalesce(e.found, 0) END AS total_found,
  CASE WHEN r.agent_used = 'DiffAgent' THEN false END AS found_direct_match
FROM c_routed r LEFT JOIN c_legal l USING (question_id) LEFT JOIN c_routed_eligible e USING (question_id) LEFT JOIN c_routed_context n USING (question_id)""")


@query("rag_route", "SELECT * FROM c_route")
def rag_route(spark, sf):
    return _routed(spark, sf).select(
        "question_id", "detected_lang", "intent", "agent_used", "answer",
        F.array_join("sections_cited", ",").alias("sections_cited"), "total_found", "found_direct_match")


def _to_hindi(texts):
    return [f"हिन्दी: {text}" for text in texts]


@query("rag_route_translated", """SELECT question_id, agent_used, answer, CASE WHEN detected_lang = 'hi' THEN 'हिन्दी: ' || answer END AS answer_hindi FROM c_route""")
def rag_route_translated(spark, sf):
    made = answers.route(view(spark, sf, "routed_questions"), inputs.chunk_vectors(spark, sf), view(spark, sf, "bns_sections"),
                         inputs.schemes(spark, sf), inputs.mapping(spark, sf), to_hindi=_to_hindi)
    return made.select("question_id", "agent_used", "answer", "answer_hindi")


step("c_app", f"""SELECT question_id, question, {_ladder_sql('question', fixed.APP_LADDER, 'legal_query')} AS intent FROM v_questions""")
step("c_app_schemes", """SELECT count(*) AS found, string_agg(line, chr(10) ORDER BY rn) FILTER (WHERE rn <= 5) AS context FROM (
  SELECT scheme_name || ' - ' || coalesce(ministry, 'Unknown') AS line, row_number() OVER (ORDER BY scheme_name, source_file) AS rn
  FROM c_schemes WHERE scheme_name IS NOT NULL) WHERE rn <= 10""")
step("c_app_map", """SELECT string_agg('IPC ' || ipc_section || ' → BNS ' || bns_section || ': ' || change_type, chr(10) ORDER BY ipc_section, bns_section, ipc_title) AS context
FROM (SELECT * FROM c_mapping ORDER BY ipc_section, bns_section, ipc_title LIMIT 5)""")


@query("rag_route_app", f"""SELECT a.question_id, a.intent,
  CASE a.intent WHEN 'scheme_eligibility' THEN 'SchemeAgent' WHEN 'ipc_bns_comparison' THEN 'DiffAgent' ELSE 'BNSAgent' END AS agent_used,
  CASE a.intent WHEN 'scheme_eligibility' THEN {_template_sql(filled(fixed.APP_SCHEME_PROMPT, **{k: repr(str(v)) for k, v in fixed.APP_PROFILE.items()}), "s.context")}
    WHEN 'ipc_bns_comparison' THEN {_template_sql(filled(fixed.APP_COMPARE_PROMPT, query='a.question'), "m.context")} ELSE l.answer END AS answer,
  CASE WHEN a.intent = 'scheme_eligibility' THEN s.found END AS total_found,
  CASE WHEN a.intent = 'ipc_bns_comparison' THEN true END AS found_direct_match
FROM c_app a, c_app_schemes s, c_app_map m LEFT JOIN c_legal l ON l.question_id = a.question_id""".replace(
    "FROM c_app a, c_app_schemes s, c_app_map m LEFT", "FROM c_app a JOIN c_app_schemes s ON true JOIN c_app_map m ON true LEFT"))
def rag_route_app(spark, sf):
    made = answers.route_app(view(spark, sf, "questions"), inputs.chunk_vectors(spark, sf), view(spark, sf, "bns_sections"),
                             inputs.schemes(spark, sf), inputs.mapping(spark, sf))
    return made.select("question_id", "intent", "agent_used", "answer", "total_found", "found_direct_match")


def _translated(texts):
    return [f"In English: {text}" for text in texts]


@query("rag_translated_intent", f"""SELECT question_id, 'In English: ' || question AS english_query, {_ladder_sql('question', fixed.APP_LADDER, 'legal_query')} AS intent
FROM v_questions""")
def rag_translated_intent(spark, sf):
    """Every question counts as foreign here, so that the translator sees them all."""
    routed = answers.classify(view(spark, sf, "questions"), fixed.APP_LADDER, fixed.APP_DEFAULT, script=".",
                              threshold=0.0, to_english=_translated)
    return routed.select("question_id", "english_query", "intent")


@query("rag_log_rows", """SELECT question_id::varchar AS query_id, question AS original_query, question AS english_query, detected_lang, intent, agent_used,
  length(question) AS response_time_ms FROM c_routed""")
def rag_log_rows(spark, sf):
    rows = answers.log_rows(answers.classify(view(spark, sf, "routed_questions")),
                            query_id=F.col("question_id").cast("string"), response_time_ms=F.length("question"))
    return rows.drop("timestamp")
