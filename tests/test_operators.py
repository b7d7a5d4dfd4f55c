import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.operators import changes, lookups, reports, windows
from lexspark.operators.containment import contains_pairs
from lexspark.operators.eligibility import eligible, eligible_by_state, next_limits
from lexspark.plans.corpus import mapping_table


# --- numbering and windows ---------------------------------------------------------------------
def test_numbering_equals_the_plain_window(spark, rows):
    df = spark.range(1000).select(F.concat(F.lit("f"), (F.col("id") * 7919 % 1000).cast("string")).alias("name"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g")).repartition(6)
    got = rows(windows.global_row_number(df, ["name"]))
    ordered = sorted(r.name for r in df.collect())
    assert got == sorted(((n, g, ordered.index(n) + 1) for n, g in ((r.name, r.g) for r in df.collect())), key=repr)
    grouped = windows.global_row_number(df, ["name"], ["g"], total="n")
    for g, members in itertools.groupby(sorted(((r.g, r.row_id, r.name, r.n) for r in grouped.collect())), key=lambda r: r[0]):
        members = list(members)
        assert [m[1] for m in members] == list(range(1, len(members) + 1))
        assert [m[2] for m in members] == sorted(m[2] for m in members)
        assert {m[3] for m in members} == {len(members)}


def test_null_groups_are_numbered_too(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert sorted((str(r.g), r.v, r.row_id) for r in windows.global_row_number(df, ["v"], ["g"]).collect()) == \
        [("None", 1, 1), ("None", 2, 2), ("a", 3, 1)]


def test_batches_of_fifty(spark):
    df = spark.range(101).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("name"))
    counts = windows.batch_number(df, ["name"], 50).groupBy("batch_num").count().orderBy("batch_num").collect()
    assert [tuple(r) for r in counts] == [(1, 50), (2, 50), (3, 1)]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 35, 100])
def test_p95_is_the_python_position(spark, n):
    values = [float((i * 37) % n) for i in range(n)]
    df = spark.createDataFrame([(v, i, "g") for i, v in enumerate(values)], "v double, id int, g string")
    want = sorted(values)[int(0.95 * n)]
    assert windows.nearest_rank(df, "v", "id").first()[0] == want
    assert windows.nearest_rank(df, "v", "id", ["g"]).first()[1] == want


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_carry_forward_in_any_span(spark, span):
    pages = [("a", i, {2: "I", 5: "II"}.get(i)) for i in range(1, 9)] + [("b", i, None) for i in (1, 4)] + [("c", 7, "IX")]
    df = spark.createDataFrame(pages, "doc string, page long, heading string")
    got = {(r.doc, r.page): r.heading for r in windows.carry_forward(df, "doc", "page", "heading", "UNKNOWN", span).collect()}
    want, last = {}, {}
    for doc, page, heading in pages:
        last[doc] = heading or last.get(doc, "UNKNOWN")
        want[doc, page] = last[doc]
    assert got == want


# --- containment -------------------------------------------------------------------------------
_WORD = st.text(alphabet="abc", min_size=1, max_size=6)
_TEXT = st.lists(_WORD, max_size=6).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(patterns=st.lists(_TEXT, min_size=1, max_size=12), texts=st.lists(_TEXT, min_size=1, max_size=12))
def test_containment_equals_brute_force(spark, patterns, texts):
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    t = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = sorted(tuple(r) for r in contains_pairs(p, "pattern", t, "id", "body").collect())
    assert got == sorted((x, i) for x in set(patterns) if x.strip() for i, body in enumerate(texts) if x in body)


def test_containment_across_word_parts_and_exact_spaces(spark):
    p = spark.createDataFrame([("ther mur",), ("a  b",), ("%",), ("",)], "pattern string")
    t = spark.createDataFrame([(1, "another murder"), (2, "a b"), (3, "a  b 5%"), (4, "x")], "id long, body string")
    assert sorted(tuple(r) for r in contains_pairs(p, "pattern", t, "id", "body").collect()) == \
        [("%", 3), ("a  b", 3), ("ther mur", 1)]


# --- eligibility -------------------------------------------------------------------------------
_SCHEME = "source_file string, scheme_name string, ministry string, beneficiary_type string, state string, income_limit_inr long, full_text string"
_PROFILE = "profile_id long, state string, income long, occupation string, category string"


def _schemes():
    states = [None, "All India", "Uttar Pradesh", "Andhra Pradesh", "Goa State"]
    kinds = [None, "farmer", "women", "general public", "SC"]
    limits = [None, 10, 100, 1000, 55, 300]
    # a third of all schemes are in one class
    return [(f"f{i:03d}", f"Name {(i * 31) % 97:02d}", None if i % 4 == 0 else "M", kinds[1] if i % 3 == 0 else kinds[i % 5],
             states[2] if i % 3 == 0 else states[(i // 2) % 5], limits[(i * 5) % 6] if i % 3 else (i * 13) % 400, "text " * 60)
            for i in range(300)]


def _profiles():
    return [(i, ["Uttar Pradesh", "Goa", "All India", "Delhi", None, ""][i % 6], [5, 60, 250, 5000][i % 4],
             ["Farmer", "Women", "General", "Daily Wage Worker"][(i // 2) % 4], "x") for i in range(48)]


def test_eligibility_equals_brute_force(spark):
    got = {}
    for r in eligible(spark.createDataFrame(_profiles(), _PROFILE), spark.createDataFrame(_schemes(), _SCHEME).repartition(5)) \
            .orderBy("profile_id", "rank").collect():
        got.setdefault(r.profile_id, []).append(r.source_file)
    for pid, state, income, occupation, _ in _profiles():
        want = sorted(
            (name, file) for file, name, _, who, where, limit, _ in _schemes()
            if (where is None or "all" in where.lower() or (state is not None and state.lower() in where.lower()))
            and (limit is None or limit >= income)
            and (who is None or "general" in who.lower() or occupation.lower() in who.lower()))[:10]
        assert got.get(pid, []) == [file for _, file in want], pid


def test_eligibility_by_state_equals_brute_force(spark):
    got = {}
    for r in eligible_by_state(spark.createDataFrame(_profiles(), _PROFILE), spark.createDataFrame(_schemes(), _SCHEME)) \
            .orderBy("profile_id", "rank").collect():
        got.setdefault(r.profile_id, []).append((r.source_file, r.ministry, r.beneficiary_type))
    for pid, state, *_ in _profiles():
        want = sorted((name, file, ministry or "Unknown", who or "General") for file, name, ministry, who, where, *_ in _schemes()
                      if state == "All India" or where is None or where in (state, "All India"))[:10]
        assert got.get(pid, []) == [w[1:] for w in want], pid


# --- lookups, changes, reports -----------------------------------------------------------------
def _mapping(spark):
    pairs = [("302", "Murder", "103", "Murder", "renamed"), ("304A", "Death by negligence", "106", "Causing death", "modified"),
             ("103", "Private defence", "38", "Defence", "consolidated"), ("497", "Adultery", "DELETED", "N/A", "deleted")]
    return mapping_table(spark.createDataFrame(pairs, "ipc_section string, ipc_title string, bns_section string, bns_title string, change_type string"))


def test_mapping_texts(spark):
    detail = {r.ipc_section: (r.change_detail, r.impact_for_citizen) for r in _mapping(spark).collect()}
    assert detail["302"][0] == "Section renumbered from IPC 302 to BNS 103"
    assert detail["497"] == ("Section 497 removed entirely from BNS 2023", "This offense is no longer a crime under BNS")
    assert detail["304A"] == ("Modified with updates", "Review specific changes for details")


def test_number_lookup_prefers_the_old_number_and_trims(spark):
    queries = spark.createDataFrame([(1, " 103 "), (2, "106"), (3, "999"), (4, "murder")], "query_id long, query string")
    got = {r.query_id: r.ipc_section for r in lookups.lookup_by_number(queries, _mapping(spark)).collect()}
    assert got == {1: "103", 2: "304A"}


def test_topic_lookup_ignores_case(spark):
    queries = spark.createDataFrame([(1, "MURDER"), (2, "negl"), (3, "theft"), (4, "section renumbered")], "query_id long, query string")
    got = {r.query_id: r.ipc_section for r in lookups.lookup_by_topic(queries, _mapping(spark)).where("rank = 1").collect()}
    assert got == {1: "302", 2: "304A", 4: "302"}


def test_section_lookup_keeps_questions_without_a_hit(spark):
    questions = spark.createDataFrame([(1, "Section 5?"), (2, "hello"), (3, "section 9")], "question_id long, question string")
    sections = spark.createDataFrame([("5", "b", "late", "X"), ("5", "a", "first", "X")], "section_number string, title string, full_text string, source_law string")
    got = {r.question_id: r.found_text for r in lookups.lookup_section(questions, sections).collect()}
    assert got == {1: "first", 2: None, 3: None}


def test_snapshot_diff(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "chunk_id string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", "x")], "chunk_id string, text string")
    assert rows(changes.snapshot_diff(old, new, "chunk_id")) == [("b", "update"), ("c", "update"), ("d", "insert")]
    assert rows(changes.snapshot_diff(new, old, "chunk_id"))[-1] == ("d", "delete")
    assert changes.snapshot_diff(old, old, "chunk_id").count() == 0


def test_new_files(spark, rows):
    incoming = spark.createDataFrame([("a",), ("b",)], "filename string")
    assert rows(changes.new_files(incoming, spark.createDataFrame([("a",)], "filename string"))) == [("b",)]


def test_class_list_is_bounded_and_count_is_not(spark):
    df = spark.range(500).select(F.lit("Women").alias("c"), F.format_string("n%03d", "id").alias("name"))
    r = reports.collect_by_class(df, "c", "name", ["name"], 100).first()
    assert r.scheme_count == 500 and r.schemes == [f"n{i:03d}" for i in range(100)]


def test_incomes_between_the_same_limits_are_one_case(spark):
    incomes = [0, 1, 5, 99, 100, 101, 4_000, 70_000, 70_001, 10**12, -3]
    limits = [5, 100, 70_000, 10**6, 10**6 + 1]
    got = dict(next_limits(spark.createDataFrame([(i,) for i in incomes], "income long"),
                           spark.createDataFrame([(x,) for x in limits] + [(None,)], "income_limit_inr long")).collect())
    assert got == {i: min((x for x in limits if x >= i), default=None) for i in incomes}
    many = spark.range(20_000).select(F.col("id").alias("profile_id"), F.lit("Goa").alias("state"), F.col("id").alias("income"),
                                      F.lit("Farmer").alias("occupation"), F.lit("General").alias("category"))
    found = eligible(many, spark.createDataFrame(_schemes(), _SCHEME), 2)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and found.select("profile_id").distinct().count() > 0
