import random
import string

import pytest

from lexspark.llm import secret_scan
from lexspark.llm.vocabularies import byte_bpe

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


@pytest.fixture(scope="module")
def lengths():
    encoding = byte_bpe(None)
    return lambda text: [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(text)]


@pytest.mark.parametrize("alphabet, n", [(UPPER + "234567", 16), (UPPER + "234567", 32), (UPPER + "234567", 52), (LOWER + "234567", 32),
                                         (LOWER + string.digits, 20), (LOWER + UPPER, 24), (LOWER, 24), (UPPER, 24)])
def test_recall_by_alphabet(lengths, alphabet, n):
    rng = random.Random(n)
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
    for before in ("", "config/service/production/keys/", "deployment_settings_for_service="):
        found = 0
        for key in keys:
            spans = secret_scan.random_spans(f"see {before}{key} here", lengths, 2.2)
            found += any(a <= 4 + len(before) and 4 + len(before) + n <= b for _, a, b in spans)
        assert found >= (0.92 if alphabet == LOWER else 0.95) * 300  # one-case words and keys overlap most


def test_clean_text_is_left(lengths, small):
    words = ["Rechtsschutzversicherungsgesellschaften", "anticonstitutionnellement", "org/apache/spark/sql/catalyst/expressions", "MAX_BUFFER_SIZE_DEFAULT",
             "getElementsByClassName", "electroencefalografista", "objects/" + "0123456789ABCDEF" * 2 + "01234567", "-" * 40]
    assert [w for w in words if secret_scan.random_spans(w, lengths, 2.2)] == []
    letters = [t[a:b] for _, t in small for _, a, b in secret_scan.random_spans(t or "", lengths, 2.2) if t[a:b].isalpha()]
    assert letters == []
