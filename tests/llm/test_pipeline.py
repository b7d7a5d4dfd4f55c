import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexspark.llm import packing, quality

from .conftest import SMALL
from .test_decontamination import plain as plain_contaminated
from .test_long_lines import plain_words
from .test_packing import checked
from .test_quality import plain as plain_quality
from .test_simhash import plain_components, plain_fingerprint


def rules(text):
    n_words, chars, symbols, dup, repeat, _ = plain_quality(text)
    lines = [x for x in (text or "").split("\n") if x.split()]
    values = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_lines": len(lines), "n_dup_lines": dup, "n_repeat_words": repeat,
              "n_capitals": sum("A" <= c <= "Z" for c in text or ""), "n_exclaimed": (text or "").count("!!")}
    return any(eval(r.failed.replace("AND", "and"), {}, values) for r in quality.RULES)


def test_run_against_brute_force(spark, table):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    docs = [(i, t) for i, t in docs if not rules(t)]
    docs = [(i, t) for i, t, *_ in plain_words(docs, 3, 15)]
    classes = plain_components([plain_fingerprint(t, 3) for _, t in docs], [i for i, _ in docs], distance=2)
    docs = [d for d, c in zip(docs, classes) if d[0] == c]
    bad = {r[0] for r in plain_contaminated(docs, items, 10) if r[5]}
    docs = [d for d in docs if d[0] not in bad]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = table(corpus_pipeline.run(spark, SMALL))
    used = checked(rows, docs, tokenizer, 2048)
    assert used <= 1 + np.ceil(1.01 * sum(r[3] for r in rows) / 2048)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.dtypes == docs.dtypes


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (1, None), (2, "")]])
def test_odd_tables(spark, documents, rows):
    docs = documents(rows)
    docs = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "CAST(NULL AS BIGINT) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).collect()


def test_every_stage_packs_what_is_left(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "pack"]
    assert packing.cut_points(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut_points(4096, 2048) == [(0, 2048), (2048, 2048)]
