"""Tables of questions to contexts, answers and log rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions import text as tx
from lexspark.operators.containment import contains_pairs, first_containing, least_holding
from lexspark.operators.eligibility import eligible, eligible_by_state
from lexspark.operators.embedding import embed, embedded, failures
from lexspark.operators.lookups import lookup_by_number, lookup_by_topic, lookup_section, section_map_sample
from lexspark.operators.models import Model, score
from lexspark.operators.vectors import filter_after_ranking, nearest
from lexspark.operators.windows import top_k
from lexspark.session import saved, use_checkpoints

RESULT_COLUMNS = ["chunk_id", "section_number", "title", "chunk_text", "source_law", "content_type"]
LOG_COLUMNS = ["query_id", "original_query", "english_query", "detected_lang", "intent", "agent_used",
               "response_time_ms", "timestamp"]


# --- retrieval ---------------------------------------------------------------------------------
def embed_chunks(chunks: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Vectors of the chunks, and (chunk_id, embed_error) of those that got none; embedded once for both."""
    use_checkpoints(chunks.sparkSession)
    tried = embed(chunks, "chunk_text", **options).checkpoint()
    return embedded(tried), failures(tried)


def _ranked(questions: DataFrame, chunk_vectors: DataFrame, k: int, text: str, wanted: str | None, embedder,
            **options) -> tuple[DataFrame, DataFrame]:
    """(question_id, _ask) and (_ask, rank, chunk_id, distance, similarity): equal questions are embedded and searched once."""
    kept = [wanted] if wanted else []
    # A digest is the key, so that ids of any question are small.
    ask = F.md5(F.to_json(F.struct(text, wanted))) if wanted else F.md5(text)
    keyed = questions.select("question_id", text, *kept, ask.alias("_ask")).where(F.col(text).isNotNull())
    asked = keyed.select(F.col(text).alias("_text"), *kept, "_ask").dropDuplicates(["_ask"])
    vectors = embedded(embed(asked, "_text", embedder))
    found = nearest(vectors, chunk_vectors, k, query_id="_ask", wanted=wanted, **options)
    return keyed.select("question_id", "_ask"), found


def _described(chunks: DataFrame) -> DataFrame:
    """Texts and metadata of chunks as the side of a join; a small compressed file of them is no reason to broadcast it."""
    return chunks.select(*RESULT_COLUMNS).hint("merge")


def retrieve(questions: DataFrame, chunk_vectors: DataFrame, k: int, *, text: str = "question",
             wanted: str | None = None, embedder=None, **options) -> DataFrame:
    """Nearest chunks of every question with their metadata, best first.

    Equal questions are embedded and searched once.
    """
    keyed, found = _ranked(questions, chunk_vectors, k, text, wanted, embedder, **options)
    described = found.join(_described(chunk_vectors), "chunk_id")
    return keyed.join(described.hint("merge"), "_ask").select(
        "question_id", "rank", *RESULT_COLUMNS, "distance", "similarity")


def keyword_search(questions: DataFrame, chunks: DataFrame, k: int, text: str = "question") -> DataFrame:
    """First ``k`` chunks (by id) whose text or title contains the question as it stands."""
    fields = chunks.select("chunk_id", F.posexplode(F.array("chunk_text", "title")).alias("_part", "_field")) \
        .where(F.col("_field").isNotNull())
    keyed = fields.select(F.struct("chunk_id", "_part").alias("_key"), "_field")
    # a chunk has at most two fields, so its 2k least keys hold its k least chunks
    hits = first_containing(questions, text, keyed, "_key", "_field", 2 * k)
    pairs = hits.select(text, "_key.chunk_id").distinct()
    first = top_k(pairs, [text], ["chunk_id"], k)
    described = first.join(_described(chunks), "chunk_id")
    return questions.select("question_id", text).join(described.hint("merge"), text).select(
        "question_id", "rank", *RESULT_COLUMNS, F.lit(fixed.FALLBACK_SCORE).alias("similarity"))


def first_keyword_search(questions: DataFrame, chunks: DataFrame, k: int, wanted: str | None = None,
                         text_chars: int | None = None) -> DataFrame:
    """First ``k`` chunks (by id) holding the question's first long word, score 0.75."""
    source = F.col(wanted) if wanted else F.lit(None).cast("string")
    asked = questions.select("question_id", tx.first_long_word(F.col("question")).alias("keyword"),
                             source.alias("_wanted"))
    lowered = chunks.select("chunk_id", "source_law", F.lower("chunk_text").alias("_text"))
    sourced = least_holding(asked, "keyword", lowered, "chunk_id", "_text", "source_law", k)
    # A chunk answers requests for any source (NULL) and for its own.
    offers = sourced.select("keyword", "chunk_id", F.explode(
        F.array(F.lit(None).cast("string"), F.col("source_law"))).alias("_offer")).distinct()
    requests = asked.select(F.col("keyword").alias("_k"), "_wanted").distinct()
    matching = offers.join(requests, (F.col("keyword") == F.col("_k")) & F.col("_offer").eqNullSafe(
        F.col("_wanted"))).select("keyword", "_wanted", "chunk_id")
    first = top_k(matching, ["keyword", "_wanted"], ["chunk_id"], k)
    described = first.join(_described(chunks), "chunk_id").withColumnRenamed("_wanted", "_w") \
        .withColumnRenamed("keyword", "_k")
    joined = asked.join(described, (F.col("keyword") == F.col("_k")) & F.col("_wanted").eqNullSafe(F.col("_w")))
    return joined.select(
        "question_id", "rank", "keyword", "chunk_id", tx.or_default(F.col("section_number"), "").alias("section_number"),
        tx.or_default(F.col("title"), "").alias("title"), tx.cut(F.col("chunk_text"), text_chars).alias("chunk_text"),
        tx.or_default(F.col("source_law"), "").alias("source_law"),
        tx.or_default(F.col("content_type"), "").alias("content_type"), F.lit(fixed.KEYWORD_SCORE).alias("similarity"))


def hybrid(questions: DataFrame, chunk_vectors: DataFrame, k: int, *, text: str = "question",
           wanted: str | None = None, embedder=None) -> DataFrame:
    """Nearest chunks; questions without any fall back to keyword search."""
    # k ids per question, needed as a result and to see which questions came away empty; texts are joined afterwards.
    keyed, found = _ranked(questions, chunk_vectors, k, text, wanted, embedder)
    ids = saved(keyed.join(found.where(F.col("chunk_id").isNotNull()).hint("merge"), "_ask").drop("_ask"), "near")
    empty = questions.join(ids.select("question_id").distinct().hint("merge"), "question_id", "left_anti")
    near = ids.join(_described(chunk_vectors), "chunk_id")
    fallback = keyword_search(empty, chunk_vectors, k, text)
    columns = ["question_id", "rank", *RESULT_COLUMNS, "similarity"]
    return near.select(*columns, F.lit("semantic").alias("found_by")).unionByName(
        fallback.select(*columns, F.lit("keyword").alias("found_by")))


# --- contexts ----------------------------------------------------------------------------------
def _ordered(results: DataFrame, **fields) -> DataFrame:
    """Per question its (at most k) ranked results as an array of structs in rank order."""
    entry = F.struct("rank", *[value.alias(name) for name, value in fields.items()])
    return results.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def context(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Numbered context and list of sources per question; a message where nothing was found."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), tx.fill(
        "{law} Section {number}: {title}\n{text}", law=F.col("source_law"), number=F.col("section_number"),
        title=F.col("title"), text=F.col("chunk_text")))
    grouped = _ordered(results, block=block, source_law=F.col("source_law"), similarity=F.col("similarity"),
                       section_number=F.col("section_number"), title=F.col("title"))
    made = grouped.select(
        "question_id",
        F.array_join(F.transform("entries", lambda e: e.block), "\n\n").alias("context"),
        F.transform("entries", lambda e: F.struct(e.source_law.alias("source_law"),
                                                  e.section_number.alias("section_number"),
                                                  e.title.alias("title"),
                                                  e.similarity.alias("similarity"))).alias("sources"))
    joined = questions.select("question_id", "question").join(made, "question_id", "left")
    return joined.withColumn("found", F.col("context").isNotNull()).withColumn(
        "message", F.when(F.col("context").isNull(), F.lit(fixed.NOTHING_FOUND)))


def answer_from_context(contexts: DataFrame, models: Sequence[tuple[str, Model]] = ()) -> DataFrame:
    """Grounded prompt, answer of the first model that works, else the numbered list of sources."""
    prompted = contexts.withColumn("prompt", F.when(F.col("found"), tx.fill(
        fixed.GROUNDED_PROMPT, context=F.col("context"), question=F.col("question"))))
    fallback = F.coalesce("message", tx.sources_answer(F.col("sources")))
    return score(prompted, "prompt", models, fallback)


# --- the three kinds of answers ----------------------------------------------------------------
def legal_answers(questions: DataFrame, chunk_vectors: DataFrame, sections: DataFrame, *, law: str = "BNS",
                  lookup_needs_context: bool = False, results: DataFrame | None = None,
                  models: Sequence[tuple[str, Model]] = ()) -> DataFrame:
    """Three legal chunks out of the five nearest, plus the section that the question names."""
    near = retrieve(questions, chunk_vectors, 5) if results is None else results
    legal = filter_after_ranking(near, F.col("content_type") == "legal_section", 3, "question_id")
    block = tx.fill("[{law} Section {number}] {title}:\n{text}", law=F.col("source_law"),
                    number=F.col("section_number"), title=F.col("title"), text=F.col("chunk_text"))
    grouped = _ordered(legal, block=block, section_number=F.col("section_number"), source_law=F.col("source_law"))
    cited = grouped.select(
        "question_id",
        F.array_join(F.transform("entries", lambda e: e.block), "\n\n").alias("_context"),
        F.transform("entries", lambda e: e.section_number).alias("_cited"),
        F.array_sort(F.array_distinct(F.transform("entries", lambda e: e.source_law))).alias("_laws"))
    looked = lookup_section(questions.select("question_id", "question"), sections).join(cited, "question_id", "left")
    base = F.coalesce("_context", F.lit(""))
    direct = F.concat(F.lit("\n\n[Direct lookup] "), tx.fill(
        law + " Section {number}: {text}", number=F.col("found_section"), text=F.col("found_text")))
    usable = F.col("found_section").isNotNull()
    if lookup_needs_context:
        usable = usable & (base != "")
    none = F.array().cast("array<string>")
    shaped = looked.select(
        "question_id", "question",
        F.when(usable, F.concat(base, direct)).otherwise(base).alias("context"),
        F.coalesce("_cited", none).alias("sections_cited"),
        F.coalesce("_laws", none).alias("source_laws"))
    prompted = shaped.withColumn("prompt", tx.prompt(F.col("question"), F.col("context")))
    return score(prompted, "prompt", models, tx.template_answer(F.col("question"), F.col("context")))


def scheme_answers(profiles: DataFrame, schemes: DataFrame, models: Sequence[tuple[str, Model]] = ()) -> DataFrame:
    """Eligible schemes per profile with their number, prompt and summary."""
    entry = F.struct("rank", F.struct(F.col("scheme_name").alias("name"), "ministry").alias("scheme"),
                     tx.fill("Scheme: {name} | Ministry: {ministry} | {text}", name=F.col("scheme_name"),
                             ministry=F.col("ministry"), text=F.col("preview")).alias("line"))
    found = eligible(profiles, schemes).groupBy("profile_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    joined = profiles.join(found, "profile_id", "left").withColumn(
        "_e", F.coalesce("_e", F.array().cast(found.schema["_e"].dataType)))
    shaped = joined.select(
        *profiles.columns,
        F.transform("_e", lambda e: e.scheme).alias("eligible_schemes"),
        F.size("_e").cast("bigint").alias("total_found"),
        tx.fill(fixed.SCHEME_PROMPT, occupation=F.col("occupation"), state=F.col("state"), income=F.col("income"),
                category=F.col("category"),
                schemes=F.array_join(F.transform("_e", lambda e: e.line), "\n")).alias("prompt"))
    summary = tx.fill(fixed.SCHEME_SUMMARY, found=F.col("total_found"), occupation=F.col("occupation"),
                      state=F.col("state"))
    return score(shaped, "prompt", models, summary)


def compare_answers(queries: DataFrame, mapping: DataFrame, chunk_vectors: DataFrame,
                    models: Sequence[tuple[str, Model]] = ()) -> DataFrame:
    """Section-map row by number, else by topic, else context of the three nearest chunks."""
    by_number = lookup_by_number(queries, mapping)
    by_topic = lookup_by_topic(queries, mapping).where(F.col("rank") == 1).drop("rank")
    # One row per query at most; the rest is searched for, so the hits are needed twice.
    use_checkpoints(queries.sparkSession)
    direct = by_number.unionByName(by_topic).checkpoint()
    rest = queries.join(direct.select("query_id").hint("merge"), "query_id", "left_anti").select(
        F.col("query_id").alias("question_id"), tx.fill(fixed.COMPARE_RETRIEVAL_TEXT, query=F.col("query")).alias("question"))
    near = _ordered(retrieve(rest, chunk_vectors, 3), block=F.col("chunk_text")).select(
        F.col("question_id").alias("query_id"),
        F.array_join(F.transform("entries", lambda e: e.block), "\n").alias("_context"))
    # All three have a row per query: no broadcast.
    joined = queries.join(direct.hint("merge"), "query_id", "left").join(near.hint("merge"), "query_id", "left")
    hit = F.col("ipc_section").isNotNull()
    compare = tx.fill(fixed.COMPARE_PROMPT, old=F.col("ipc_section"), old_title=F.col("ipc_title"),
                      new=F.col("bns_section"), new_title=F.col("bns_title"), change=F.col("change_type"),
                      detail=F.col("change_detail"))
    ask = tx.fill(fixed.COMPARE_FALLBACK_PROMPT, query=F.col("query"))
    shaped = joined.select(
        "query_id", "query", hit.alias("found_direct_match"), "ipc_section", "ipc_title", "bns_section", "bns_title",
        "change_type", "impact_for_citizen", F.coalesce("_context", F.lit("")).alias("context"),
        F.when(hit, compare).otherwise(ask).alias("ask"))
    prompted = shaped.withColumn("prompt", tx.prompt(F.col("ask"), F.col("context")))
    scored = score(prompted, "prompt", models, tx.template_answer(F.col("ask"), F.col("context")))
    return scored.withColumnRenamed("answer", "explanation").drop("ask")


# --- routing -----------------------------------------------------------------------------------
def translate(df: DataFrame, source: str, target: str, language: str, model: Model | None) -> DataFrame:
    """``target``: the text in ``source``, through a caller's model where ``detected_lang`` is ``language``.

    Without a model, and where the model fails, the text stays as it is.
    """
    if model is None:
        return df.withColumn(target, F.col(source))
    foreign = F.when(F.col("detected_lang") == language, F.col(source))
    asked = df.withColumn("_foreign", foreign)
    scored = score(asked, "_foreign", [("translator", model)], F.col(source), answer="_translated", model_used="_translator")
    return scored.withColumn(target, F.col("_translated")).drop("_translated", "_translator", "_foreign")


def classify(questions: DataFrame, ladder=fixed.AGENT_LADDER, default: str = fixed.AGENT_DEFAULT,
             script: str = fixed.DEVANAGARI, threshold: float = 0.5, to_english: Model | None = None) -> DataFrame:
    """Language flag, English text, intent, and the route taken.

    A scheme question without profile (no profile column, or all of them NULL) goes the legal way but keeps
    its intent.
    """
    flagged = questions.withColumn("detected_lang", tx.script_flag(F.col("question"), script, threshold))
    labelled = translate(flagged, "question", "english_query", "hi", to_english).withColumn(
        "intent", tx.ladder(F.col("english_query"), ladder, default))
    known = [F.col(c).isNotNull() for c in fixed.PROFILE_DEFAULTS if c in questions.columns]
    has_profile = reduce(or_, known, F.lit(False))
    return labelled.withColumn(
        "agent_used",
        F.when((F.col("intent") == "scheme_eligibility") & has_profile, fixed.SCHEME_ROUTE)
        .when(F.col("intent").isin("law_comparison", "ipc_bns_comparison"), fixed.COMPARE_ROUTE)
        .otherwise(fixed.LEGAL_ROUTE))


def with_profile(questions: DataFrame, defaults: dict) -> DataFrame:
    """The four profile columns, with defaults where a column or a value is missing."""
    return questions.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in questions.columns else F.lit(v) for c, v in defaults.items()})


def route(questions: DataFrame, chunk_vectors: DataFrame, sections: DataFrame, schemes: DataFrame,
          mapping: DataFrame, models: Sequence[tuple[str, Model]] = (), to_hindi: Model | None = None,
          **classify_options) -> DataFrame:
    """Every question through its own path; one result row each.

    ``questions``: question_id, question and, for known applicants, any of state, income, occupation,
    category; what a profile lacks takes its default.
    """
    # Read by every path below; translated and classified once.
    use_checkpoints(questions.sparkSession)
    routed = classify(questions, **classify_options).checkpoint()
    asked = routed.withColumn("question", F.col("english_query"))
    legal = legal_answers(asked.where(F.col("agent_used") == fixed.LEGAL_ROUTE), chunk_vectors, sections, models=models)
    asking = with_profile(asked.where(F.col("agent_used") == fixed.SCHEME_ROUTE), fixed.PROFILE_DEFAULTS)
    # Equal profiles are matched once.
    person = ["state", "income", "occupation", "category"]
    who = F.to_json(F.struct(*person))
    profiles = asking.select(who.alias("profile_id"), *person).distinct()
    scheme = asking.select("question_id", who.alias("profile_id")).join(
        scheme_answers(profiles, schemes, models).select("profile_id", "eligible_schemes", "total_found", "answer"),
        "profile_id")
    compare = compare_answers(
        asked.where(F.col("agent_used") == fixed.COMPARE_ROUTE).select(
            F.col("question_id").alias("query_id"), F.col("question").alias("query")),
        mapping, chunk_vectors, models)
    results = (
        legal.select("question_id", "answer", "sections_cited", "source_laws")
        .unionByName(scheme.select("question_id", "answer", "eligible_schemes", "total_found"), allowMissingColumns=True)
        .unionByName(compare.select(F.col("query_id").alias("question_id"), F.col("explanation").alias("answer"),
                                    "found_direct_match", "ipc_section", "bns_section"), allowMissingColumns=True)
    )
    answered = routed.select("question_id", "question", "english_query", "detected_lang", "intent", "agent_used").join(
        results, "question_id")
    in_hindi = translate(answered, "answer", "_hindi", "hi", to_hindi) if to_hindi else answered.withColumn(
        "_hindi", F.lit(None).cast("string"))
    return in_hindi.withColumn("answer_hindi", F.when(F.col("detected_lang") == "hi", F.col("_hindi"))).drop("_hindi")


def route_app(questions: DataFrame, chunk_vectors: DataFrame, sections: DataFrame, schemes: DataFrame,
              mapping: DataFrame, models: Sequence[tuple[str, Model]] = (), to_english: Model | None = None) -> DataFrame:
    """The short form of routing: intent from the question as asked, one fixed profile, sample of the section map.

    Scheme questions get the first schemes of the whole country, five of them as context; comparisons get five
    rows of the section map as context.
    """
    use_checkpoints(questions.sparkSession)
    flagged = questions.select("question_id", "question").withColumn("detected_lang", tx.script_flag(F.col("question")))
    labelled = translate(flagged, "question", "english_query", "hi", to_english).withColumn(
        "intent", tx.ladder(F.col("question"), fixed.APP_LADDER, fixed.APP_DEFAULT))
    routed = labelled.withColumn(
        "agent_used", F.when(F.col("intent") == "scheme_eligibility", fixed.SCHEME_ROUTE)
        .when(F.col("intent") == "ipc_bns_comparison", fixed.COMPARE_ROUTE).otherwise(fixed.LEGAL_ROUTE)).checkpoint()
    asked = routed.withColumn("question", F.col("english_query"))
    legal = legal_answers(asked.where(F.col("agent_used") == fixed.LEGAL_ROUTE), chunk_vectors, sections, models=models)

    # One profile, so one row of at most ten schemes; every scheme question reads it.
    profile = questions.sparkSession.createDataFrame([(0, *fixed.APP_PROFILE.values())], "profile_id long, state string, income long, occupation string, category string")
    found = eligible_by_state(profile, schemes).groupBy("profile_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "scheme_name", "ministry"))).alias("_e"))
    line = F.transform(F.slice("_e", 1, fixed.APP_CONTEXT_SCHEMES), lambda e: F.concat_ws(" - ", e.scheme_name, e.ministry))
    shown = profile.join(found, "profile_id", "left").select(
        F.coalesce(F.size("_e"), F.lit(0)).cast("bigint").alias("total_found"),
        F.transform("_e", lambda e: F.struct(e.scheme_name.alias("name"), e.ministry.alias("ministry"))).alias("eligible_schemes"),
        F.coalesce(F.array_join(line, "\n"), F.lit("")).alias("_context"),
        tx.fill(fixed.APP_SCHEME_PROMPT, **{c: F.col(c) for c in ("occupation", "income", "state")}).alias("_ask"), F.lit(1).alias("_one"))
    # ``shown`` is one row (one profile), ``lines`` one row (a global aggregate): they are the sides to broadcast
    scheme = asked.where(F.col("agent_used") == fixed.SCHEME_ROUTE).withColumn("_one", F.lit(1)).join(F.broadcast(shown), "_one")

    lines = section_map_sample(mapping).agg(
        F.array_sort(F.collect_list(F.struct("ipc_section", "bns_section", "ipc_title", "line"))).alias("_l")).select(
        F.array_join(F.transform("_l", lambda e: e.line), "\n").alias("_context"), F.lit(1).alias("_one"))
    compare = asked.where(F.col("agent_used") == fixed.COMPARE_ROUTE).withColumn("_one", F.lit(1)).join(F.broadcast(lines), "_one").withColumn(
        "_ask", tx.fill(fixed.APP_COMPARE_PROMPT, query=F.col("question")))

    def answered(df: DataFrame) -> DataFrame:
        prompted = df.withColumn("_prompt", tx.prompt(F.col("_ask"), F.col("_context")))
        return score(prompted, "_prompt", models, tx.template_answer(F.col("_ask"), F.col("_context")))

    results = (
        legal.select("question_id", "answer", "sections_cited", "source_laws")
        .unionByName(answered(scheme).select("question_id", "answer", "eligible_schemes", "total_found"), allowMissingColumns=True)
        .unionByName(answered(compare).select("question_id", "answer", F.lit(True).alias("found_direct_match")), allowMissingColumns=True))
    return routed.join(results, "question_id")


def log_rows(routed: DataFrame, query_id=None, response_time_ms=None, timestamp=None) -> DataFrame:
    """The eight log columns; id, duration and time are made up on the spot unless given."""
    return routed.select(
        (F.uuid() if query_id is None else query_id).alias("query_id"),
        F.col("question").alias("original_query"),
        "english_query", "detected_lang", "intent", "agent_used",
        (F.lit(0) if response_time_ms is None else response_time_ms).cast("bigint").alias("response_time_ms"),
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
    )
