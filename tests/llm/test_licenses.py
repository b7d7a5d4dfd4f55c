"""op11: license scan against its SQL, and the set-similarity join against a brute force over all blocks."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lexspark.llm import licenses
from lexspark.llm.queries import CHECKS

ODD = [(90001, None), (90002, ""), (90003, "Under The MIT License"), (90003, "Under The MIT License"), (None, "cc by nc cc by nc"),
       (90005, "Licensed under the Apache License, Version 2.0. " * 3), (90006, "x " * 40_000 + " released under the mit license"),
       (90007, "the mit license under"), (90008, "apache license version 20"), (90009, "redistribution and use in source and binary forms with or without permitted")]


def sql(rows):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    return sorted((tuple(r) for r in db.sql(CHECKS["op11_license_scan"]).fetchall()), key=repr)


def test_against_sql(documents, small, table):
    rows = small + ODD
    got = table(licenses.report(documents(rows)))
    assert got == sql(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[90003][2:6] == (1, 0, 0, "mit") and by_id[90005][2] == 3 and by_id[90006][6] == "mit"
    assert by_id[90007][2] == 0 and by_id[90008][2] == 0 and by_id[90009][6] == "bsd" and 0.8 <= by_id[90009][7] < 1
    assert by_id[90001][2:] == (0, None, None, "", "", 0.0)


def brute(rows, templates):
    span, found = templates.span, {}
    for n, (doc_id, text) in enumerate(rows):
        ws = licenses._plain(text or "")
        count = max(1, -(-(len(ws) - span) // span)) if ws else 0
        for b in range(count):
            block = set(ws[b * span:b * span + 2 * span])
            for t, label, tw in templates.rows:
                overlap = len(block & set(tw))
                if overlap >= templates.needed(len(tw)):
                    key = (doc_id, t)
                    found[key] = max(found.get(key, 0), overlap)
    return sorted((k[0], k[1], v) for k, v in found.items())


def test_join_against_brute_force(spark, documents):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    made = [(label, " ".join(rng.sample(words, rng.randint(3, 12)))) for label in "abcdefgh"]
    templates = licenses.Templates(made, tenths=7)
    rows = []
    for doc_id in range(300):
        ws = [rng.choice(words[:25]) if rng.random() < 0.5 else f"z{rng.randint(0, 500)}" for _ in range(rng.randint(0, 80))]
        if doc_id % 5 == 0:
            label, text = rng.choice(made)
            at = rng.randint(0, len(ws))
            ws[at:at] = [w for w in text.split() if rng.random() < 0.85]
        rows.append((doc_id, " ".join(ws)))
    docs = documents(rows).withColumn("_row", F.col("doc_id")).select("_row", licenses.words(F.col("text")).alias("_words"))
    got = sorted((r._row, r.template, r.overlap) for r in licenses.matches(docs, templates).collect())
    assert got == brute(rows, templates)
    assert len(got) > 20


def test_extra_columns_and_empty(documents):
    clash = documents([(1, "released under the MIT license")], extra=True).withColumn("labels", F.lit(3)).withColumn("_row", F.lit("y"))
    assert [tuple(r) for r in licenses.report(clash).collect()] == [(1, 5, 1, 1, 1, "mit", "mit", 1.0)]
    assert licenses.report(documents([])).count() == 0
