"""op12: fill-in-the-middle against a brute force written from the contract, on sf0.001 and odd rows."""

import hashlib
import re

from pyspark.sql import functions as F

from lexspark.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = [m.group(0) for m in UNIT.finditer(text)]
    n = len(units)
    if doc_id is None:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    hx = sha(f"42:{doc_id}")
    h = [int(hx[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = sum(map(len, units[:a])), sum(map(len, units[:b]))
    pre, mid, suf = text[:i], text[i:j], text[j:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    out = "<S>" + suf + "<P>" + pre + "<M>" + mid if h[3] % 100 < 80 else "<P>" + pre + "<S>" + suf + "<M>" + mid
    return (doc_id, n, "spm" if h[3] % 100 < 80 else "psm", i, j - i, sha(out), sha(text))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a <S> b"), (5, "a <S> b"), (None, "x y"), (7, "x " * 40_000),
       (8, " \U0001F600é  x\n"), (9, " a\u0085b "), (10, "one  two\tthree  ")] + [(i, f" w{i % 3}  x y\tz ") for i in range(100, 160)]


def test_against_brute_force(documents, small, table):
    rows = small + ODD
    got = table(fim.report(documents(rows)))
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_round_trip_and_pieces(documents):
    done = fim.transformed(documents(ODD, extra=True)).collect()
    for r in done:
        assert r.restored == (r.text or "")
        assert sum(p.length for p in r.pieces) == len(r.output)
        assert r["_spans"] == "x"  # callers' columns stay


def test_clashing_columns_and_empty(documents, spark):
    clash = documents([(1, "a b c d e f")]).withColumn("n", F.lit("x")).withColumn("output", F.lit(1))
    assert fim.report(clash).count() == 1
    assert fim.transformed(clash).select("n").first()[0] == 6
    assert fim.report(documents([])).count() == 0
