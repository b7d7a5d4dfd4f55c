import hashlib
import random
import re

import numpy as np
import pytest

from lexspark.llm import pii
from lexspark.llm.spans import written

from .conftest import ODD


def invented(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghinorstu") for _ in range(rng.randint(2, 9)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        while not pii.luhn(x := digits(16)):
            pass
        return x

    kinds = (lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
             card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f'token = "{hashlib.md5(word().encode()).hexdigest()}"', lambda: digits(4))
    return [" ".join([word() for _ in range(rng.randint(0, 30))] + [rng.choice(kinds)()] + [word() for _ in range(rng.randint(0, 30))]) for _ in range(n)]


def test_base_spans():
    text = "Mail a.b@c.de, 1.2.3.4 and 1.2.3.400 or 4111 1111 1111 1111; 4111 1111 1111 1112 +1 (974) 555-3436 +12 34 é é@x.y"
    assert written(pii.base_spans(text), pii.BASE) == "email:5:13,ip:15:22,card:40:59,phone:81:98"
    assert [text[a:b] for _, a, b in pii.base_spans(text)] == ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (974) 555-3436"]
    assert pii.base_spans("") == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger.fresh(5, 4, 2)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    codes, gold = rng.integers(0, pii.N_CODES, (3, pii.WINDOW)), rng.integers(0, pii.TAGS, (3, pii.WINDOW))
    _, grads = tagger.gradients(codes, gold)
    for name, values in tagger.w.items():
        place = tuple(rng.integers(0, s) for s in values.shape) if name != "emb" else (codes[0, 5], 1)
        held, losses = values[place], []
        for step in (1e-4, -1e-4):
            values[place] = held + step
            losses.append(tagger.gradients(codes, gold)[0])
        values[place] = held
        assert grads[name][place] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=2e-2, abs=2e-4), name


def test_decoding_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    tagger = pii.Tagger.fresh(3, 3, 5)
    tagger.w["trans"] = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    codes = rng.integers(0, pii.N_CODES, (2, 4))
    e, tags = tagger.emissions(codes), tagger.decode(codes)
    for row, got in zip(e, tags):
        score = lambda p: row[0, p[0]] + tagger.w["head"][p[0]] + sum(row[t, p[t]] + tagger.w["trans"][p[t - 1], p[t]] for t in range(1, 4))
        best = max(np.ndindex(*[pii.TAGS] * 4), key=score)
        assert tuple(got) == best


def test_held_out_accuracy_and_added_spans():
    tagger = pii.fitted(invented(700, 1))
    held = invented(300, 2)
    hits = found = wanted = 0
    for text in held:
        starts = pii.windows(text)
        got = set(pii.reconciled(len(text), starts, tagger.decode(pii.coded(text, starts)))) if starts else set()
        want = set(pii.base_spans(text))
        hits, found, wanted = hits + len(got & want), found + len(got), wanted + len(want)
    assert hits / found > 0.9 and hits / wanted > 0.9


def test_windows_cover_every_trigger_with_a_margin():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aaaaaaaaaa1@") for _ in range(rng.randrange(400)))
        starts = pii.windows(text)
        for m in re.finditer("[0-9@]", text):
            assert any((s == 0 or s + pii.MARGIN <= m.start()) and m.start() + pii.MARGIN <= s + pii.WINDOW for s in starts)


def test_report(documents, table):
    rows = [(i, t) for i, t in enumerate(invented(120, 6))] + [(i, t) for i, t in ODD if i is not None] + [(None, "x@y.de")]
    got = table(pii.report(documents(rows, extra=True)))
    want = []
    for i, text in rows:
        base = pii.base_spans(text or "")
        line = written(base, pii.BASE)
        want.append((i, *[sum(k == kind for k, *_ in base) for kind in pii.BASE], hashlib.sha256(line.encode()).hexdigest()))
    assert sorted((r[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert sum(r[1:5]) <= len([s for s in r[6].split(",") if s])
    assert table(pii.report(documents([]))) == []
    assert table(pii.report(documents(ODD)), "spans") == [("",)] * len(ODD)
