"""Nothing gets lost or is asked twice: whole texts, failed batches, NULLs, missing profiles, other folders."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexspark import session
from lexspark.functions import fixed
from lexspark.functions import text as tx
from lexspark.operators import embedding, reports
from lexspark.operators.changes import snapshot_diff
from lexspark.operators.containment import contains_pairs
from lexspark.operators.lookups import lookup_section
from lexspark.operators.models import score
from lexspark.plans import answers, corpus, evaluation, prompts

from .test_plans import _mapping, _sections, _vectors

SCHEMES = "source_file string, scheme_name string, ministry string, beneficiary_type string, state string, income_limit_inr long, full_text string"


def test_fields_and_labels_far_behind_are_found(spark, rows):
    filler = "word " * 60_000
    raw = corpus.clean_documents(spark.createDataFrame(
        [("a", "Kisan Support Plan 1. " + filler + "Ministry of Grain. For every student, up to Rs. 5,000. Bring a ration card and a bank passbook and an identity card.")],
        "filename string, text string"))
    found = corpus.extract_info(corpus.classify_schemes(corpus.scheme_table(raw))).first()
    assert (found.ministry, found.income_limit_inr, found.category) == ("Grain", 5000, "Student")
    assert len(found.full_text) > 300_000 and list(found.extracted_info.documents) == ["ration card", "bank passbook", "identity card"]
    chunk = corpus.scheme_chunks(corpus.scheme_table(raw)).first()
    assert "identity card" in chunk.chunk_text
    short = corpus.extract_info(corpus.scheme_table(raw, text_chars=30), documents_per_scheme=1).first()
    assert len(short.full_text) == 30 and not short.extracted_info.documents


def test_keywords_titles_and_sections_are_whole(spark):
    pages = spark.createDataFrame([("d", 1, "Chapter I\n\n12. Long title here.-- " + "body text " * 1000 + "Last Phrase Here")], "doc_id string, page_no long, text string")
    found = corpus.extract_sections(pages, "X").first()
    assert len(found.full_text) > 9000 and found.keywords.endswith("Last Phrase Here")
    assert len(corpus.extract_sections(pages, "X", text_chars=50).first().full_text) == 50
    many = spark.range(1).select(tx.keywords(F.lit("t"), F.lit(" a ".join(f"Name{chr(97 + i)}" for i in range(20)))).alias("k"))
    assert len(many.first().k.split(", ")) <= 20


def test_classes_list_every_name(spark):
    df = spark.range(500).select(F.lit("Women").alias("c"), F.format_string("n%03d", "id").alias("name"))
    row = reports.collect_by_class(df, "c", "name", ["name"]).first()
    assert row.scheme_count == 500 and list(row.schemes) == [f"n{i:03d}" for i in range(500)]


def test_values_that_move_between_columns_are_changes(spark, rows):
    old = spark.createDataFrame([(1, "v", None), (2, "a", "b"), (3, "x", None)], "id long, p string, q string")
    new = spark.createDataFrame([(1, None, "v"), (2, "a", "b"), (3, "x", None)], "id long, p string, q string")
    assert rows(snapshot_diff(old, new, "id")) == [(1, "update")]
    assert rows(snapshot_diff(old, new.drop("q"), "id")) == [(1, "update"), (2, "update")]


def test_failed_chunks_are_kept_and_tried_again(spark, rows):
    chunks = spark.createDataFrame([("a", "good one"), ("b", "bad one"), ("c", "good two")], "chunk_id string, chunk_text string")

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return embedding.hashed_counts()(texts)

    vectors, failed = answers.embed_chunks(chunks, embedder=picky, batch_size=1, tries=1)
    assert rows(vectors, "chunk_id") == [("a",), ("c",)] and rows(failed) == [("b", "ValueError: bad text")]
    first = embedding.embed_incremental(vectors, chunks, chunks, picky, batch_size=1, tries=1)
    assert rows(first, "chunk_id", "embed_status", "origin") == [("a", "ok", "kept"), ("b", "failed", "embedded"), ("c", "ok", "kept")]
    assert rows(embedding.status_counts(first)) == [("failed", "ValueError: bad text", 1), ("ok", None, 2)]
    second = embedding.embed_incremental(first, chunks, chunks)
    assert rows(second, "chunk_id", "embed_status", "origin") == [("a", "ok", "kept"), ("b", "ok", "embedded"), ("c", "ok", "kept")]


def test_replies_are_asked_for_once(spark, tmp_path):
    log = tmp_path / "asked"

    def counting(texts):
        with open(log, "a") as out:
            out.write("".join(f"{t}\n" for t in texts))
        return [f"{t} {os.urandom(4).hex()}" for t in texts]

    df = spark.createDataFrame([(i, f"p{i % 3}" if i % 4 else None) for i in range(12)], "id long, prompt string")
    scored = score(df, "prompt", [("m", counting)], F.lit("-"), answer="reply", model_used="by")
    again = score(scored, "reply", [("n", lambda texts: [t.upper() for t in texts])], F.lit("?"))
    got = again.collect()
    assert sorted(log.read_text().split()) == ["p0", "p1", "p2"] and len(got) == 12
    assert all(r.answer == r.reply.upper() for r in got)
    assert {r.reply for r in got if r.prompt is None} == {"-"}


def test_sections_are_looked_up_where_none_is_named(spark, rows):
    asked = spark.createDataFrame([(1, "What is section 103?"), (2, "nothing"), (3, None), (4, "section 9")], "question_id long, question string")
    assert rows(lookup_section(asked, _sections(spark)), "question_id", "found_section") == [(1, "103"), (2, None), (3, None), (4, None)]


def test_one_word_patterns_need_no_comparison(spark, rows):
    texts = spark.createDataFrame([(1, "some words here"), (2, "otherwords"), (3, "none")], "id long, body string")
    patterns = spark.createDataFrame([("words",), ("word",), ("some words",), (" words",), ("",), (None,)], "p string")
    assert rows(contains_pairs(patterns, "p", texts, "id", "body")) == sorted(
        [("words", 1), ("words", 2), ("word", 1), ("word", 2), ("some words", 1), (" words", 1)], key=repr)


def test_translated_routes_keep_both_answers(spark):
    asked = spark.createDataFrame([(1, "धारा 103 क्या है?"), (2, "What is Section 103?"), (3, "Which scheme suits me?")], "question_id long, question string")
    schemes = spark.createDataFrame([("a", "Alpha", "M", "farmer", None, None, "text")], SCHEMES)
    routed = answers.route(asked, _vectors(spark), _sections(spark), schemes, _mapping(spark), to_hindi=lambda texts: [f"H {t}" for t in texts])
    got = {r.question_id: r for r in routed.collect()}
    assert got[1].answer and got[1].answer_hindi == f"H {got[1].answer}" and got[2].answer and got[2].answer_hindi is None
    assert (got[3].intent, got[3].agent_used) == ("scheme_eligibility", "BNSAgent")  # no profile columns at all


def test_profiles_take_defaults(spark):
    asked = spark.createDataFrame([(1, "Which scheme?", "Goa", None), (2, "Which scheme?", None, None), (3, "Which scheme?", None, "Farmer")],
                                  "question_id long, question string, state string, occupation string")
    schemes = spark.createDataFrame([("a", "Alpha", "M", "farmer", None, None, "text"), ("b", "Beta", "M", "general", None, 600_000, "text"), ("c", "Gamma", "M", None, None, 100, "text")], SCHEMES)
    got = {r.question_id: r for r in answers.route(asked, _vectors(spark), _sections(spark), schemes, _mapping(spark)).collect()}
    assert got[1].answer == "Found 1 schemes for General in Goa" and [s.name for s in got[3].eligible_schemes] == ["Alpha", "Beta"]
    assert got[2].agent_used == fixed.LEGAL_ROUTE


def test_app_form_of_routing(spark):
    asked = spark.createDataFrame([(1, "What is section 103?"), (2, "scheme please"), (3, "compare murder")], "question_id long, question string")
    schemes = spark.createDataFrame([(f"f{i}", f"Plan {i:02d}", None, None, None, None, "text") for i in range(14)], SCHEMES)
    seen = answers.route_app(asked, _vectors(spark), _sections(spark), schemes, _mapping(spark), models=[("echo", lambda texts: list(texts))]).collect()
    got = {r.question_id: r for r in seen}
    assert [got[i].intent for i in (1, 2, 3)] == ["legal_query", "scheme_eligibility", "ipc_bns_comparison"]
    assert got[2].total_found == 10 and "Plan 04 - Unknown" in got[2].answer and "Plan 05" not in got[2].answer
    assert "IPC 302 → BNS 103: renamed" in got[3].answer and got[3].found_direct_match


def test_cases_without_an_answer_fail(spark):
    cases = spark.createDataFrame([(1, "en", "long", "Q1", "A", "alpha theft", "t", "d", "l"), (2, "en", "long", "Q2", "A", "beta", "t", "d", "l")],
                                  "item_id long, language string, question string, simple_question string, correct_answer string, correct_text string, topic string, subject_domain string, level string")
    routed = spark.createDataFrame([(1, "Theft by ALPHA", "legal_question", "BNSAgent")], "question_id long, answer string, intent string, agent_used string")
    got = {r.test_id: r for r in evaluation.result_rows(evaluation.keyword_score(evaluation.answered_cases(cases, routed))).collect()}
    assert (got[1].correct, got[1].keywords_matched) == (True, 2) and (got[2].correct, got[2].intent, got[2].actual_answer) == (False, "error", "ERROR: no answer")


def test_schemes_are_counted_by_the_class_a_model_gave(spark, rows):
    schemes = spark.createDataFrame([("a", "Alpha", None, None, None, None, "farm"), ("b", "Beta", None, None, None, None, "x"), ("c", None, None, None, None, None, "farm")], SCHEMES)
    counted = prompts.model_class_counts(schemes, [("m", lambda texts: [" Farmer" if "farm" in t else "" for t in texts])])
    assert rows(counted, "category", "scheme_count") == [("Farmer", 1), ("General", 1)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Cluster())


def test_queries_run_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import importlib.util as u, pyspark.sql as s; p=u.spec_from_file_location('entry', '%s/__spark_entry__.py'); m=u.module_from_spec(p); p.loader.exec_module(m);"
            "k=s.SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').config('spark.sql.shuffle.partitions','2').getOrCreate();"
            "print('ROWS', m.queries()['vec_knn'](k, '/root/testdata/sf0.001').count())" % root)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS 2500" in done.stdout, done.stderr[-2000:]
