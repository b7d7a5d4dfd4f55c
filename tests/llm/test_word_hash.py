"""Stretch hashes modulo 2**61 - 1: equal stretches agree anywhere, Thue-Morse words no longer collide."""

import numpy as np
import pyarrow as pa

from lexspark.llm import words


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_thue_morse_words_differ():
    a, b = thue_morse(2048), thue_morse(2048, flip=True)
    found = words.Words(pa.array([a, b, a])).hashes()
    assert found[0] != found[1] and found[0] == found[2]


def test_equal_stretches_agree_wherever_they_stand():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, size=5000, dtype=np.uint64)
    values[3000:3100] = values[100:200]
    seq = words.Sequences(values)
    same = seq.between(np.array([100, 3000, 101]), np.array([200, 3100, 200]))
    assert same[0] == same[1] and same[0] != same[2]
    windows = seq.windows(50)
    assert len(set(windows.tolist())) == len(windows) - 51  # only the planted repeats collide


def test_sums_against_python():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 2**64 - 1, size=300, dtype=np.uint64)
    for prime, sums in zip(words.PRIMES, words._sums(values, 12345)):
        assert words._powers(7, 300, prime).tolist() == [pow(7, i, prime) for i in range(300)]
        want, total = [0], 0
        for i, v in enumerate(values.tolist()):
            total = (total + v % prime * pow(12345, i, prime)) % prime
            want.append(total)
        assert sums.tolist() == want


def test_substring_dedup_keeps_thue_morse_documents(documents, table):
    from lexspark.llm import substrings

    a, b = thue_morse(2048), thue_morse(2048, flip=True)
    rows = [(1, " ".join([a] * 50)), (2, " ".join([b] * 50) + " end"), (3, " ".join([a] * 50) + " tail")]
    got = {r[0]: r[2] for r in table(substrings.RepeatedPassages(documents(rows), window=50).remaining(), "doc_id", "n_words", "n_removed")}
    assert got == {1: 0, 2: 0, 3: 50}
