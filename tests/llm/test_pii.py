import hashlib
import random
import re
import time

import pytest
from helpers import SF

from quern.llm.pii import BASE, detect_pii, find_spans, luhn, mod97
from quern.llm.queries import QUERIES

# The patterns as the contract states them.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def check(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in BASE for m in PLAIN[k].finditer(text) if check(k, m[0])]


def base(text):
    return [s[:3] for s in find_spans(text) if s[0] in BASE]


def noise(rng):
    parts = ["a@b.c", "x.y+z@d-e.fr", "@", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49.", "é", " ", "0", "12", "-", ".", "(", "+"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))


def test_base_kinds_equal_the_plain_patterns():
    rng = random.Random(11)
    for _ in range(20_000):
        text = noise(rng)
        assert base(text) == brute(text), text


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")


@pytest.mark.parametrize("text, kind", [
    ("IBAN GB82 WEST 1234 5698 7654 32 bitte", "iban"), ("taxpayer 123-45-6789", "ssn"), ("token = 24be64439e3e49cf46b2d7c90f3602a3", "secret"),
    ("Passwort: 24be64439e3e49cf", "secret"), ("contraseña 24be64439e3e49cf", "secret"), ("Steuernummer 123-45-6789", "ssn"),
])
def test_context_in_four_languages_confirms_a_span(text, kind):
    assert [s[0] for s in find_spans(text) if s[0] not in BASE] == [kind]


@pytest.mark.parametrize("text", ["123-45-6789", "24be64439e3e49cf", "numéro de série 123-45-6789 social", "GB82 WEST 1234 5698 7654 33 iban"])
def test_without_context_or_checksum_there_is_no_span(text):
    assert [s for s in find_spans(text) if s[0] not in BASE] == []


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "é a@b.cd", "z"), (3, "é a@b.cd", "z"), (None, "+1 743 555 3824", "w")]
    out = detect_pii(spark.createDataFrame(rows, "doc_id long, text string, pii string")).collect()
    assert sorted((str(r.doc_id), [tuple(s)[:3] for s in r.pii]) for r in out) == [
        ("1", []), ("2", []), ("3", [("email", 2, 8)]), ("3", [("email", 2, 8)]), ("None", [("phone", 0, 15)]),
    ]
    assert detect_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("part", ["1", "1.", "a", "a@", "a.", "+1 ", "1 ", "A1", "-", "@a."])
def test_time_grows_with_a_text_not_its_square(part):
    began = time.time()
    find_spans(part * 400_000)
    assert time.time() - began < 10


def test_the_query_equals_the_plain_patterns(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["op2_pii"](spark, SF).collect()}
    assert set(out) == set(docs)
    for d, text in docs.items():
        found = brute(text)
        assert tuple(out[d][f"n_{k}"] for k in BASE) == tuple(sum(f[0] == k for f in found) for k in BASE)
        assert out[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
