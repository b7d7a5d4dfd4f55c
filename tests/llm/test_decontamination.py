import hashlib
import random
import re

from lexspark.llm import decontamination

from .conftest import ODD


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(documents, items, window):
    tests = [(i, words_of(t)) for i, t in items]
    out = []
    for doc, text in documents:
        words, hit, ids = words_of(text), set(), set()
        for item, test in tests:
            n = min(window, len(test))
            keys = {tuple(test[k:k + n]) for k in range(len(test) - n + 1)} if n else set()
            for j in range(len(words) - n + 1 if n else 0):
                if tuple(words[j:j + n]) in keys:
                    hit |= set(range(j, j + n))
                    ids.add(item)
        named = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def made(seed, n=50):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(["ab", "Ba", "c", "é", "7"]) for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([0, 1, 4, 9, 10, 11, 25])) if i % 4 else words(30))) for i in range(2, 14)]
    items += [(13, items[0][1]), (99, None), (100, "!!"), (None, "zz yy xx ww vv uu tt ss rr qq"), (7, items[3][1])]
    items = [x for x in items if len(words_of(x[1])) != 1]
    docs = []
    for i in range(n):
        parts = [words(rng.randint(0, 12)) if rng.random() < 0.6 else (rng.choice(items)[1] or "").split()[:rng.randint(5, 30)] for _ in range(rng.randint(0, 5))]
        docs.append((i, rng.choice([" ", "-", ", "]).join(w for p in parts for w in p)))
    return docs + [(200, "Zz yy, xx ww vv uu tt ss rr QQ!")], items


def test_against_every_window(spark, documents, table):
    for seed in (1, 2):
        docs, items = made(seed)
        got = decontamination.contaminated(documents(docs, extra=True), items_frame(spark, items), 10)
        assert table(got) == plain(docs, items, 10)


def test_benchmark_in_blocks(spark, documents, table):
    docs, items = made(3)
    got = decontamination.contaminated(documents(docs), items_frame(spark, items), 10, block_bytes=150)
    assert table(got) == plain(docs, items, 10)


def test_longest_matches(spark, documents):
    item = " ".join(f"t{i}" for i in range(40))
    docs = [(1, "x y " + " ".join(f"T{i}" for i in range(5, 25)) + " z"), (2, "t1 t2")]
    rows = decontamination.overlaps(documents(docs), items_frame(spark, [(3, item), (4, "u v w")])).select("document.doc_id", "_spans", "_matches").collect()
    found = {r[0]: (r[1], [tuple(m) for m in r[2]]) for r in rows}
    assert [tuple(s) for s in found[1][0]] == [(2, 22)] and found[1][1] == [("3", 5, 2, 20)] and found[2] == ([], [])


def test_odd_rows(spark, documents, table):
    items = [(1, "x x x x x x x x x x x x"), (2, None), (3, "a b c")]
    got = decontamination.contaminated(documents(ODD), items_frame(spark, items))
    assert table(got) == plain(ODD, items, 10)
    assert table(decontamination.contaminated(documents(ODD), items_frame(spark, []))) == plain(ODD, [], 10)
    assert table(decontamination.contaminated(documents([]), items_frame(spark, items))) == []
    kept = decontamination.clean(documents(ODD, extra=True), items_frame(spark, items))
    assert kept.columns == documents(ODD, extra=True).columns and kept.count() == len(ODD) - 2
