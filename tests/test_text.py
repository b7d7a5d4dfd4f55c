import re

from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions import text as tx


def one(spark, value, column, name="x", kind="string"):
    return spark.createDataFrame([(value,)], f"{name} {kind}").select(column).first()[0]


def test_no_match_is_null_not_empty(spark):
    assert one(spark, "nothing here", tx.extract(F.col("x"), fixed.MINISTRY)) is None
    assert one(spark, "Ministry of Rural Affairs.", tx.extract(F.col("x"), fixed.MINISTRY)) == "Rural Affairs"


def test_scheme_name_is_a_phrase_and_amounts_are_numbers(spark):
    text = "Pradhan Mantri Awas Yojana 2. limit Rs. 1,50,000 a year"
    assert one(spark, text, tx.extract(F.col("x"), fixed.SCHEME_NAME)) == "Pradhan Mantri Awas Yojana "
    assert one(spark, text, tx.amount(F.col("x"))) == 150000
    assert one(spark, "₹ 2,000", tx.amount(F.col("x"))) == 2000
    assert one(spark, "Rs. ,,", tx.amount(F.col("x"))) is None
    assert one(spark, "free", tx.amount(F.col("x"))) is None


def test_whitespace_is_what_python_calls_whitespace(spark):
    every = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029,
                              0x202F, 0x205F, 0x3000]))
    text = every + "a" + every + "b​c " + every
    assert one(spark, text, tx.squeeze(F.col("x"))) == " ".join(text.split())
    assert one(spark, text, tx.strip(F.col("x"))) == text.strip()
    assert one(spark, "  a \n b ", tx.single_spaces(F.col("x"))) == " a b "


def test_keywords_keep_first_seen_order(spark):
    df = spark.createDataFrame([("Theft Act", "Robbery and Theft Act. " + " x ".join(
        f"{w} y" for w in ["Alpha", "Beta", "Gamma", "Delta", "Eps", "Zeta", "Eta", "Iota", "Kappa", "Lam", "Mu"]))], "t string, b string")
    found = df.select(tx.keywords(F.col("t"), F.col("b"))).first()[0].split(", ")
    title_and_body = df.select(F.concat_ws(" ", "t", "b")).first()[0]
    want = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b", title_and_body)))
    assert found == want
    few = df.select(tx.keywords(F.col("t"), F.col("b"), most=10)).first()[0].split(", ")
    assert few == want[:10]
    assert one(spark, "Aéro Bien", tx.keywords(F.col("x"), F.lit(""))) == "Bien"


def test_ladders_differ_in_order_and_labels(spark):
    df = spark.createDataFrame([("Which SCHEME replaced the IPC rule?",), ("सरकारी योजना",), ("theft",), ("बदलाव क्या है",)], "q string")
    agent = [r[0] for r in df.select(tx.ladder(F.col("q"), fixed.AGENT_LADDER, fixed.AGENT_DEFAULT)).collect()]
    app = [r[0] for r in df.select(tx.ladder(F.col("q"), fixed.APP_LADDER, fixed.APP_DEFAULT)).collect()]
    assert agent == ["law_comparison", "scheme_eligibility", "legal_question", "law_comparison"]
    assert app == ["scheme_eligibility", "scheme_eligibility", "legal_query", "legal_query"]


def test_script_flag_counts_marks_and_survives_empty_text(spark):
    df = spark.createDataFrame([("हत्या की सजा क्या है?",), ("What is theft?",), ("",), (None,), ("12 !?",)], "q string")
    assert [r[0] for r in df.select(tx.script_flag(F.col("q"))).collect()] == ["hi", "en", "en", "en", "en"]


def test_section_numbers_and_references(spark):
    df = spark.createDataFrame([("302",), (" 304A ",), ("302a",), ("theft",), ("63-64",)], "q string")
    assert [r[0] for r in df.select(tx.is_section_number(F.col("q"))).collect()] == [True, True, False, False, False]
    assert one(spark, "what is SECTION  103?", tx.section_reference(F.col("x"))) == "103"
    assert one(spark, "no number", tx.section_reference(F.col("x"))) is None
    assert one(spark, "Section 5 and Section 7", tx.cited_sections(F.col("x"))) == ["5", "7"]


def test_answer_marks(spark):
    df = spark.createDataFrame([("ask", "ask Answer: a Answer:  b "), ("ask", "x उत्तर: क उत्तर: ख"), ("ask", "ask plain ")], "p string, r string")
    assert [r[0] for r in df.select(tx.clean_answer(F.col("r"), F.col("p"))).collect()] == ["b", "ख", "plain"]


def test_template_answer_uses_first_citation(spark):
    df = spark.createDataFrame([("What?", "[BNS Section 63] x Section 9"), ("What?", "")], "q string, c string")
    first, second = [r[0] for r in df.select(tx.template_answer(F.col("q"), F.col("c"))).collect()]
    assert "particularly Section 63, what? relates" in first
    assert second == fixed.TEMPLATE_ANSWER_PLAIN


def test_options(spark):
    df = spark.createDataFrame([(" b ",), (None,), ("",), ("E",)], "a string")
    options = {n: F.lit(f"text {n}") for n in "ABCD"}
    letter = tx.option_letter(F.col("a"))
    rows = [tuple(r) for r in df.select(letter, tx.option_text(letter, F.col("a"), options)).collect()]
    assert rows == [("B", "text B"), ("A", "text A"), ("A", "text A"), ("E", "E")]


def test_prompt_cuts_the_context_and_drops_it_when_empty(spark):
    df = spark.createDataFrame([("q", "c" * 600), ("q", "")], "q string, c string")
    long, short = [r[0] for r in df.select(tx.prompt(F.col("q"), F.col("c"))).collect()]
    assert "c" * 600 in long
    cut = df.select(tx.prompt(F.col("q"), F.col("c"), context_chars=500)).first()[0]
    assert "c" * 500 in cut and "c" * 501 not in cut
    assert "Context" not in short and short.endswith("उत्तर/Answer:")


def test_first_long_word(spark):
    df = spark.createDataFrame([("How is THEFT punished",), ("a b c",), (None,), ("x" * 150,)], "q string")
    assert [r[0] for r in df.select(tx.first_long_word(F.col("q"))).collect()] == ["theft", "section", "section", "x" * 150]
