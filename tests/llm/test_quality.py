import random
import re

from pyspark.sql import functions as F

from lexspark.llm import quality

from .conftest import ODD, SMALL


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    keys, covered = {}, set()
    for i in range(len(words) - 2):
        keys.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in keys.values():
        if len(places) > 1:
            covered |= {p + o for p in places for o in range(3)}
    held = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(covered), failed)


def test_measures(documents, table):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab# é \n".split(" ")) + rng.choice(["", "\n", "\u00a0", "\U0001f600"]) for _ in range(rng.randrange(120)))) for i in range(80)]
    rows += [(i + 100, t) for i, t in ODD if i is not None] + [(300, "a a a"), (301, "a a a a"), (302, " ".join(map(str, range(50_000))) + " 7 8 9")]
    got = table(quality.report(documents(rows, extra=True)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert table(quality.report(documents([]))) == []


def test_verdict_keeps_good_and_rejects_bad_labels(spark):
    rows = quality.report(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("NOT base_failed")
    found = rows.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r["quality"], r["kept"]) for r in found} == {(0, False), (1, True)}


def test_ablations(documents, table):
    df = documents([]).sparkSession.createDataFrame([(0,), (1,), (1,), (3,), (4,), (5,), (64,)], "failed_bits long")
    assert table(quality.ablations(df, "v1"), "rule", "n_failed", "n_failed_alone", "n_rejected") == sorted(
        [("too_few_words", 4, 2, 5), ("repeated_phrases", 1, 0, 5), ("symbols", 2, 1, 5), ("repeated_lines", 0, 0, 5)], key=repr)
    assert table(quality.patterns(df)) == [(0, 1), (1, 2), (3, 1), (4, 1), (5, 1), (64, 1)]
    assert len({r.bit for r in quality.RULES}) == len(quality.RULES)


def test_accepted_keeps_columns(documents):
    good = " ".join(f"word{i}" for i in range(80))
    df = documents([(1, good), (2, None), (None, good), (3, "#### " * 100)], extra=True)
    kept = quality.accepted(df)
    assert kept.columns == df.columns and kept.agg(F.count("*")).first()[0] == 2
