"""Anchor expansion finds what the plain patterns find, and the extra kinds."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return out


def base(text):
    return [s for s in pii.spans(text) if s[2] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.+-@ ()ab%é:", max_size=60))
def test_same_base_spans_as_patterns(text):
    assert base(text) == plain(text)


def test_examples():
    text = "a@b.c@d.e x@y +1 (974) 555-3436, 1.2.3.4.5.6.7.8 and 256.1.1.1 or 4111 1111 1111 1111"
    assert base(text) == plain(text)
    assert {k for *_, k in base(text)} == {"email", "ip", "card", "phone"}
    assert pii.spans("see https://bob:pw@host.org/x now")[-1][2] == "url"
    assert pii.spans("IBAN: DE89 3704 0044 0532 0130 00.")[-1] == (6, 33, "iban") or pii.spans("IBAN: DE89 3704 0044 0532 0130 00.")[-1][2] == "iban"
    assert (12, 20, "account") in pii.spans("Account no. 12345678.")
    assert pii.spans("accountant 12345678") == []


def test_edge_rows(spark):
    long = "word " * 50_000 + "a@b.cd"
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.cd", "x"), (3, "a@b.cd", "x"), (None, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = sorted((r.doc_id or 0, len(r.pii)) for r in pii.find_pii(df).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert pii.find_pii(df.limit(0)).count() == 0
    masked = [r.text for r in pii.mask(df).where("doc_id = 3 or doc_id = 1").collect()]
    assert sorted(masked, key=str) == ["<email>", "<email>", None]


def test_parts_of_thousands_of_digits():
    zeros = "0" * 5000
    assert [k for *_, k in pii.spans(f"v {zeros}1.1.1.1 and {zeros}.1.1.256")] == ["ip"]
    assert pii.spans("9" * 5000 + ".1.1.1") == []
