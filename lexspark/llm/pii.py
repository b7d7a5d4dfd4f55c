"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The network is written and trained in numpy. Its labels are the spans that the patterns find in a bounded,
documented sample of texts, drawn by hash; spans of digits that fail a check (Luhn, part sizes, digit counts)
are negatives only for their own kind's pattern and stay unlabelled. All kinds hold a digit or an at sign, so
only windows with one are decoded; windows overlap, and each character takes the tag of the window in which
it stands farthest from an edge. Found spans that touch no base span are added, base spans always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.spans import Span, digest, free, with_spans

BASE = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, MARGIN = 64, 20
TAGS = 1 + 2 * len(BASE)  # outside; begin and inside of each kind
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern; those that fail their check are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def windows(text: str) -> list[int]:
    """Starts of overlapping windows; every digit and at sign stands in one with a margin on both sides."""
    out: list[int] = []
    for m in _TRIGGER.finditer(text):
        if not out or m.start() + MARGIN > out[-1] + WINDOW:
            out.append(max(0, m.start() - MARGIN))
    return out


_CODES = np.full(0x110000, 5, dtype=np.int16)  # other
_CODES[0x80:0x250] = 4  # further Latin letters
_CODES[32:127] = np.arange(32, 127) - 26  # 6 to 100
_CODES[[9, 10, 13]] = (1, 2, 3)
N_CODES = 101


def coded(text: str, starts: list[int]) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    padded = np.concatenate([_CODES[points], np.zeros(WINDOW, np.int16)])
    return padded[np.asarray(starts, dtype=np.int64)[:, None] + np.arange(WINDOW)]


@dataclass
class Tagger:
    """Embedding, two LSTMs, output layer and transitions, as a dict of float32 arrays."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int, embedding: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"emb": draw(N_CODES, embedding) * 3, "out": draw(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32),
             "trans": np.zeros((TAGS, TAGS), np.float32), "head": np.zeros(TAGS, np.float32)}
        for d in "fb":
            w["x" + d], w["h" + d] = draw(embedding, 4 * hidden), draw(hidden, 4 * hidden)
            w["b" + d] = np.zeros(4 * hidden, np.float32)
            w["b" + d][hidden:2 * hidden] = 1
        return cls(w)

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, steps, hidden = x.shape[0], x.shape[1], self.w["h" + d].shape[0]
        h = c = np.zeros((n, hidden), np.float32)
        out = np.empty((n, steps, hidden), np.float32)
        inputs = x @ self.w["x" + d] + self.w["b" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-z[:, :3 * hidden]))
            i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
            g = np.tanh(z[:, 3 * hidden:])
            before, held = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, before, held, i, f, o, g, tc))
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.w["emb"][codes]
        traces = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._lstm(x, "f", traces[0]), self._lstm(x, "b", traces[1])], axis=2)
        if keep is not None:
            keep |= {"x": x, "both": both, "f": traces[0], "b": traces[1]}
        return both @ self.w["out"] + self.w["bias"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tag sequence of every window (Viterbi)."""
        e = self.emissions(codes)
        score, back = e[:, 0] + self.w["head"], np.empty(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            paths = score[:, :, None] + self.w["trans"]
            back[:, t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + e[:, t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(e.shape[1] - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[:, t], tags[:, t, None].astype(np.int64), axis=1)[:, 0]
        return tags

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags under the CRF, and its gradient."""
        keep: dict = {}
        e = self.emissions(codes, keep)
        n, steps, _ = e.shape
        trans, rows = self.w["trans"], np.arange(n)
        norm = lambda a, axis: (m := a.max(axis=axis, keepdims=True), np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis))[1]
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + self.w["head"]
        for t in range(1, steps):
            ahead[:, t] = norm(ahead[:, t - 1][:, :, None] + trans, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            behind[:, t] = norm(trans + (behind[:, t + 1] + e[:, t + 1])[:, None, :], 2)
        z = norm(ahead[:, -1], 1)
        de = np.exp(ahead + behind - z[:, None, None])
        dtrans = np.zeros_like(trans)
        path = e[rows, 0, gold[:, 0]] + self.w["head"][gold[:, 0]]
        for t in range(1, steps):
            pair = ahead[:, t - 1][:, :, None] + trans + (e[:, t] + behind[:, t])[:, None, :] - z[:, None, None]
            dtrans += np.exp(pair).sum(axis=0)
            np.add.at(dtrans, (gold[:, t - 1], gold[:, t]), -1)
            path += e[rows, t, gold[:, t]] + trans[gold[:, t - 1], gold[:, t]]
        np.put_along_axis(de, gold[:, :, None].astype(np.int64), np.take_along_axis(de, gold[:, :, None].astype(np.int64), 2) - 1, 2)
        de /= n
        grads = {"trans": dtrans / n, "head": de[:, 0].sum(axis=0), "bias": de.sum(axis=(0, 1)),
                 "out": np.einsum("nth,ntk->hk", keep["both"], de, optimize=True)}
        dboth = de @ self.w["out"].T
        hidden = self.w["hf"].shape[0]
        dx = np.zeros_like(keep["x"])
        for d, part in (("f", dboth[:, :, :hidden]), ("b", dboth[:, :, hidden:])):
            wx, wh = self.w["x" + d], self.w["h" + d]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.w["b" + d])
            dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
            for t, before, held, i, f, o, g, tc in reversed(keep[d]):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gx += keep["x"][:, t].T @ dz
                gh += before.T @ dz
                gb += dz.sum(axis=0)
                dx[:, t] += dz @ wx.T
                dh, dc = dz @ wh.T, dc * f
            grads |= {"x" + d: gx, "h" + d: gh, "b" + d: gb}
        grads["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(grads["emb"], codes, dx)
        return float((z - path).mean()), grads


def train(codes: np.ndarray, gold: np.ndarray, hidden: int = 24, embedding: int = 12, epochs: int = 20, batch: int = 64,
          rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam over shuffled batches with a rate that falls to zero; the same rows give the same network."""
    tagger, rng = Tagger.fresh(hidden, embedding, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in tagger.w.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(codes) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            _, grads = tagger.gradients(codes[chosen], gold[chosen])
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                scale = rate * (1 - (step - 1) / steps)
                tagger.w[k] = (tagger.w[k] - scale * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return tagger


def gold_tags(text: str, starts: list[int], spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text) + WINDOW, np.int8)
    for kind, a, b in spans:
        k = 1 + 2 * BASE.index(kind)
        tags[a:b] = k + 1
        tags[a] = k
    return tags[np.asarray(starts, dtype=np.int64)[:, None] + np.arange(WINDOW)]


def reconciled(length: int, starts: list[int], tags: np.ndarray) -> list[Span]:
    """One tag for each character, from the window in which it is most inward, then the spans of the whole text."""
    spans: list[Span] = []
    whole: dict[int, tuple[int, int]] = {}
    for start, row in zip(starts, tags):
        for k in np.flatnonzero(row).tolist() if row.any() else ():
            depth = min(k if start else WINDOW, WINDOW - 1 - k)
            if start + k < length and depth >= whole.get(start + k, (-1, 0))[0]:
                whole[start + k] = (depth, int(row[k]))
    for start, row in zip(starts, tags):  # a more inward "outside" overrules
        for k in np.flatnonzero(row == 0).tolist():
            held = whole.get(start + k)
            if held and min(k if start else WINDOW, WINDOW - 1 - k) > held[0]:
                del whole[start + k]
    for at in sorted(whole):
        kind, begins = (whole[at][1] - 1) // 2, whole[at][1] % 2 == 1
        if spans and not begins and spans[-1][2] == at and spans[-1][0] == BASE[kind]:
            spans[-1] = (BASE[kind], spans[-1][1], at + 1)
        else:
            spans.append((BASE[kind], at, at + 1))
    return spans


def plausible(text: str, span: Span) -> bool:
    """Whole in itself: it holds enough digits, or an at sign with a dot behind, and no word or number is cut."""
    kind, a, b = span
    held = text[a:b]
    if a and text[a - 1].isalnum() and held[0].isalnum() or b < len(text) and text[b].isalnum() and held[-1].isalnum():
        return False
    if kind == "email":
        return bool(re.fullmatch(r"\S+@\S+\.\S+", held))
    digits = sum(c.isdigit() for c in held)
    return digits >= (4 if kind == "ip" else 9) and not re.search(r"[^0-9 ().+-]", held)


def training_sample(documents: DataFrame, sample_texts: int, sample_bytes: int) -> list[str]:
    """At most ``sample_texts`` distinct texts that hold a digit or an at sign, least hashes first.

    The rows are counted first, so that only about twice as many as wanted are ever sorted.
    """
    rows = documents.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= sample_bytes)).select(
        "text", F.xxhash64("text").alias("h"))
    share = min(1.0, 2 * sample_texts / max(1, rows.count()))
    few = rows.filter(F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63)).distinct()
    return [r["text"] for r in few.orderBy("h", "text").limit(sample_texts).select("text").collect()]


def fitted(texts: list[str], **options) -> Tagger | None:
    """A tagger from the base spans of the texts; None if they hold none."""
    codes, gold = [], []
    for text in dict.fromkeys(texts):
        starts, spans = windows(text), base_spans(text)
        clean = [s for s in starts if not any(a < s + WINDOW < b or a < s < b for _, a, b in spans)]
        if clean:
            codes.append(coded(text, clean))
            gold.append(gold_tags(text, clean, spans))
    if not codes or not np.concatenate(gold).any():
        return None
    return train(np.concatenate(codes), np.concatenate(gold), **options)


def personal_data(documents: DataFrame, sample_texts: int = 1500, sample_bytes: int = 20_000) -> DataFrame:
    """All columns of ``documents`` but text, and ``_spans``: kind, start, end (code points), base or added.

    The network is fitted on the driver to at most ``sample_texts`` texts of at most ``sample_bytes`` bytes, and used
    on every window of every whole text. Null text counts as empty. Repeated rows are judged each for
    itself. Without any base span in the sample there is no network and only base spans are found.
    """
    tagger = fitted(training_sample(documents, sample_texts, sample_bytes))

    def finder():
        def find(texts: list[str]):
            places = [windows(t) if tagger else [] for t in texts]
            rows = [coded(t, s) for t, s in zip(texts, places) if s]
            if rows:
                codes = np.concatenate(rows)
                tags = np.concatenate([tagger.decode(block) for block in np.array_split(codes, 1 + len(codes) // 2048)])
            out, at = [], 0
            for text, starts in zip(texts, places):
                base, more = base_spans(text), []
                if starts:
                    more = [s for s in reconciled(len(text), starts, tags[at:at + len(starts)]) if plausible(text, s)]
                    at += len(starts)
                out.append((base, free(more, base)))
            return out

        return find

    return with_spans(documents, finder)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return digest(personal_data(texts), BASE, BASE)
