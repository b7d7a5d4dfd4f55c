from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.operators.models import score
from lexspark.plans import answers, corpus, evaluation


def test_sections_follow_the_two_patterns_and_page_rules(spark):
    pages = [
        ("d", 1, "intro text that is long enough to count as a page of its own, no heading"),
        ("d", 2, "CHAPTER IX"),  # too short: skipped together with its heading
        ("d", 3, "302. Punishment for murder.--Whoever commits  murder\nshall be punished with death\n\nchapter xvii of offences\n\nChapter I again"),
        ("d", 4, "303. Simple heading only here now\n\n5A. Another title line\nbody text that is long enough to stay\n\n"
                 "A plain paragraph which has no number but enough letters"),
        ("d", 5, "short\n\n12. tiny: x\n\n" + "no section, just a paragraph to fill the page up"),
    ]
    got = {r.section_number: r for r in corpus.extract_sections(
        spark.createDataFrame(pages, "doc_id string, page_no long, text string"), "IPC_1860").collect()}
    assert set(got) == {"302", "303", "5A"}
    murder = got["302"]
    assert (murder.title, murder.chapter, murder.page_number) == ("Punishment for murder", "CHAPTER xvii", 3)
    assert murder.full_text == "Whoever commits murder shall be punished with death"
    assert murder.char_count == len(murder.full_text) and murder.keywords == "Punishment, Whoever"
    assert got["303"].full_text == "303. Simple heading only here now" and got["303"].chapter == "CHAPTER xvii"
    assert got["5A"].full_text == "body text that is long enough to stay"


def test_first_page_has_unknown_chapter(spark):
    pages = [("d", 1, "7. A heading that is long enough.--And a body that is long enough")]
    row = corpus.extract_sections(spark.createDataFrame(pages, "doc_id string, page_no long, text string"), "X").first()
    assert row.chapter == "UNKNOWN"


def test_one_long_document_is_joined_like_a_small_one(spark):
    pages = [("big", i, f"page  {i}\n" if i % 7 else "  \n ") for i in range(1000)] + [("small", 0, "x " * 80), ("tiny", 0, "x")]
    got = {r.filename: r for r in corpus.join_pages(spark.createDataFrame(pages, "filename string, page_no long, text string")).collect()}
    whole = " ".join(" ".join(t for f, _, t in pages if f == "big").split())
    assert got["big"].text == whole and got["big"].char_count == len(whole)
    assert set(got) == {"big", "small"}
    cut = corpus.join_pages(spark.createDataFrame(pages, "filename string, page_no long, text string"), 1000)
    assert {r.filename: (len(r.text), r.char_count) for r in cut.collect()}["big"] == (1000, len(whole))


def test_documents_keep_their_length_when_cut(spark):
    df = spark.createDataFrame([("a", "word " * 20_000), ("b", "short"), ("c", "x" * 101), ("d", "x" * 100)], "filename string, text string")
    got = {r.filename: (len(r.text), r.char_count) for r in corpus.clean_documents(df).collect()}
    assert got == {"a": (99_999, 99_999), "c": (101, 101)}
    short = {r.filename: (len(r.text), r.char_count) for r in corpus.clean_documents(df, 50_000).collect()}
    assert short["a"] == (50_000, 99_999)


def test_chunks_are_unique_and_numbered(spark):
    sections = spark.createDataFrame(
        [("1", "t", "short", "X", "c", 1), ("1", "t", "the longest text", "X", "c", 9), ("1", "t", "the longest one!", "X", "c", 2), ("2", "u", "v", "X", "c", 1)],
        "section_number string, title string, full_text string, source_law string, chapter string, page_number long")
    schemes = spark.createDataFrame(
        [("b", "Beta", None, None, "Goa", None, "text"), ("a", "Alpha", "M", "women", None, 5, "text"), ("c", None, None, None, None, None, "t")],
        "source_file string, scheme_name string, ministry string, beneficiary_type string, state string, income_limit_inr long, full_text string")
    got = {r.chunk_id: r.chunk_text for r in corpus.unified_chunks({"ipc_": sections}, schemes).collect()}
    assert got == {"ipc_1": "t the longest one!", "ipc_2": "u v", "scheme_1": "Alpha M women text", "scheme_2": "Beta Goa text"}


CHUNKS = "chunk_id string, section_number string, title string, chunk_text string, source_law string, chapter string, content_type string"


def _vectors(spark):
    return answers.embed_chunks(spark.createDataFrame([
        ("bns_103", "103", "Murder", "Murder punishment for murder death", "BNS", "V", "legal_section"),
        ("bns_303", "303", "Theft", "Theft of movable property", "BNS", "XVII", "legal_section"),
        ("ipc_302", "302", "Murder", "Punishment for murder old law", "IPC", "XVI", "legal_section"),
        ("scheme_1", "", "Kisan Plan", "Kisan Plan farmer income support", "schemes", "M", "government_scheme"),
    ], CHUNKS))[0]


def test_hybrid_falls_back_only_where_nothing_is_near(spark):
    asked = spark.createDataFrame([(1, "Theft", None), (2, "Kisan Plan", "nowhere"), (3, "absent", "nowhere")], "question_id long, question string, wanted string")
    got = answers.hybrid(asked, _vectors(spark), 2, wanted="wanted").collect()
    assert {(r.question_id, r.found_by) for r in got} == {(1, "semantic"), (2, "keyword")}
    assert [(r.chunk_id, r.similarity) for r in got if r.question_id == 2] == [("scheme_1", 0.0)]
    assert min((r.rank, r.chunk_id) for r in got if r.question_id == 1)[1] == "bns_303"


def test_context_keeps_questions_without_results(spark):
    asked = spark.createDataFrame([(1, "murder punishment"), (2, None)], "question_id long, question string")
    got = {r.question_id: r for r in answers.context(asked, answers.retrieve(asked, _vectors(spark), 2)).collect()}
    assert got[1].context.startswith("[1] BNS Section 103: Murder\nMurder punishment") and "\n\n[2] " in got[1].context
    assert [s.section_number for s in got[1].sources] == ["103", "302"]
    assert not got[2].found and got[2].message == fixed.NOTHING_FOUND


def test_models_are_tried_in_order_and_fall_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, prompt string")

    def broken(prompts):
        raise OSError("down")

    def picky(prompts):
        if "b" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = {r.id: (r.answer, r.model_used) for r in score(df, "prompt", [("one", broken), ("two", picky)], F.lit("none"), batch_size=1).collect()}
    assert got == {1: ("A", "two"), 2: ("A", "two"), 3: ("none", fixed.NO_MODEL), 4: ("none", fixed.NO_MODEL)}
    assert {r.answer for r in score(df, "prompt", [], F.lit("x")).collect()} == {"x"}


def _sections(spark):
    return spark.createDataFrame([("103", "Murder", "Punishment for murder", "BNS", 1)], "section_number string, title string, full_text string, source_law string, page_number long")


def test_legal_answer_and_its_lookup(spark):
    asked = spark.createDataFrame([(1, "What is section 103?"), (2, "farmer support")], "question_id long, question string")
    got = {r.question_id: r for r in answers.legal_answers(asked, _vectors(spark), _sections(spark)).collect()}
    assert got[1].context.endswith("\n\n[Direct lookup] BNS Section 103: Punishment for murder")
    assert "" not in got[2].sections_cited and got[2].source_laws == ["BNS", "IPC"]
    empty = answers.retrieve(asked, _vectors(spark), 5).where("false")
    strict = answers.legal_answers(asked, _vectors(spark), _sections(spark), results=empty, lookup_needs_context=True)
    assert {r.context for r in strict.collect()} == {""}
    loose = answers.legal_answers(asked, _vectors(spark), _sections(spark), results=empty)
    assert {r.question_id: r.context.strip()[:15] for r in loose.collect()} == {1: "[Direct lookup]", 2: ""}


def _mapping(spark):
    return corpus.mapping_table(spark.createDataFrame(
        [("302", "Murder", "103", "Murder", "renamed")], "ipc_section string, ipc_title string, bns_section string, bns_title string, change_type string"))


def test_compare_goes_number_topic_neighbours(spark):
    queries = spark.createDataFrame([(1, "302"), (2, "murder"), (3, "movable property")], "query_id long, query string")
    got = {r.query_id: r for r in answers.compare_answers(queries, _mapping(spark), _vectors(spark)).collect()}
    assert [got[i].found_direct_match for i in (1, 2, 3)] == [True, True, False]
    assert got[1].prompt.find("Compare IPC Section 302 (Murder) with BNS Section 103 (Murder)") > 0
    assert got[3].context.count("\n") == 2 and "How did the law on 'movable property' change" in got[3].prompt


def test_route_sends_each_question_its_way(spark):
    asked = spark.createDataFrame([
        (1, "What is Section 103?", None, None, None, None), (2, "Which scheme suits me?", "Goa", 100, "Farmer", "General"),
        (3, "Which scheme suits me?", None, None, None, None), (4, "How did IPC 302 change?", "Goa", 100, "Farmer", "General"),
    ], "question_id long, question string, state string, income long, occupation string, category string")
    schemes = spark.createDataFrame([("a", "Alpha", "M", "farmer", None, None, "text")],
                                    "source_file string, scheme_name string, ministry string, beneficiary_type string, state string, income_limit_inr long, full_text string")
    routed = answers.route(asked, _vectors(spark), _sections(spark), schemes, _mapping(spark)).cache()
    got = {r.question_id: r for r in routed.collect()}
    assert [(got[i].intent, got[i].agent_used) for i in (1, 2, 3, 4)] == [
        ("legal_question", "BNSAgent"), ("scheme_eligibility", "SchemeAgent"), ("scheme_eligibility", "BNSAgent"), ("law_comparison", "DiffAgent")]
    assert got[2].answer == "Found 1 schemes for Farmer in Goa" and got[2].eligible_schemes[0].name == "Alpha"
    assert got[4].found_direct_match is False
    assert answers.log_rows(routed).columns == answers.LOG_COLUMNS
    assert answers.log_rows(routed).select("query_id").distinct().count() == 4


def test_hindi_goes_through_the_translators(spark):
    asked = spark.createDataFrame([(1, "हत्या की सजा क्या है?"), (2, "What is Section 103?")], "question_id long, question string")

    def to_english(texts):
        return ["How did the old law on murder change?"] * len(texts)

    got = {r.question_id: r for r in answers.classify(asked, to_english=to_english).collect()}
    assert (got[1].detected_lang, got[1].intent, got[1].question) == ("hi", "law_comparison", "हत्या की सजा क्या है?")
    assert (got[2].detected_lang, got[2].english_query) == ("en", "What is Section 103?")

    def down(texts):
        raise OSError("no model")

    assert {r.english_query for r in answers.classify(asked, to_english=down).collect()} == {r.question for r in asked.collect()}


def test_percentiles_per_group(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("response_time_ms"), F.lit("en").alias("language"))
    assert tuple(evaluation.latency_percentiles(df, ["language"]).first()) == ("en", 100, 50.0, 95.0)


def test_cases_are_prepared_and_capped(spark):
    rows = [(i, "en" if i % 2 else "hi", "Q", "a", "b", "c", "d", [None, " b ", "Z"][i % 3], None, fixed.EVALUATION_DOMAINS[0] if i % 5 else "Tax", "") for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, language string, question string, option_a string, option_b string, option_c string, option_d string, correct_answer string, topic string, subject_domain string, question_level string")
    cases = evaluation.prepare_cases(df)
    assert cases.count() == 48
    first = cases.where("item_id = 1").first()
    assert first.question == "Q\nA) a\nB) b\nC) c\nD) d" and (first.correct_answer, first.correct_text) == ("B", "b")
    assert (first.topic, first.level) == ("General", "Unknown")
    capped = evaluation.prepare_cases(df, caps={"en": 20, "hi": 15}).groupBy("language").count()
    assert {r.language: r["count"] for r in capped.collect()} == {"en": 20, "hi": 15}


def test_scores_and_metrics(spark):
    cases = spark.createDataFrame([
        (1, "hi", "Alpha theft murder", "THEFT is alpha", 10.0, False), (2, "en", "Alpha theft murder robbery", "alpha", 20.0, False),
        (3, "en", "a b", "a b", 30.0, False), (4, "en", "Alpha", "alpha", 40.0, True)],
        "test_id long, language string, correct_text string, actual_answer string, response_time_ms double, failed boolean")
    for name in ("question", "subject_domain", "topic", "level", "correct_option", "intent", "agent_used"):
        cases = cases.withColumn(name, F.lit("x"))
    results = evaluation.result_rows(evaluation.keyword_score(cases.withColumn("error", F.lit("boom"))))
    got = {r.test_id: (r.keywords_matched, r.total_keywords, r.correct, r.response_time_ms, r.actual_answer) for r in results.collect()}
    assert got[1] == (2, 3, True, 10.0, "THEFT is alpha")
    assert got[2][:3] == (1, 4, False) and got[3][:3] == (0, 0, False)
    assert got[4] == (0, 0, False, 0.0, "ERROR: boom")
    m = evaluation.full_metrics(results).first()
    assert (m.total, m.total_correct, m.hi_correct, m.p95_time_ms, m.min_time_ms) == (4, 1, 1, 30.0, 0.0)
    assert (m.overall_accuracy, m.hi_accuracy, m.other_accuracy) == (0.25, 1.0, 0.0)
    assert evaluation.metrics(results, exclude_errors=True).first().total == 3
    assert evaluation.metrics(results.where("language = 'en'")).first().hi_accuracy == 0.0
    by = {(r.dimension, r.value): r.total for r in evaluation.metrics_by(results, ["language", "topic"]).collect()}
    assert by == {("all", None): 4, ("language", "hi"): 1, ("language", "en"): 3, ("topic", "x"): 4}
