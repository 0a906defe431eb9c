"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over every whole text and reports anchors: at-signs, plus signs,
digits, URL schemes and words that announce an identifier. From an anchor a deterministic local
parser expands to both sides, finds the boundaries and validates. Text without anchors is never
looked at again.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone``, and those of the extra parsers: ``url``
(a URL that carries user data before an at-sign), ``iban`` (checked by its remainder) and
``account`` (the number after a cue such as "account no."). Spans are code point offsets, the end
exclusive. Within a kind spans are leftmost and never overlap; a candidate that fails its check is
dropped and its characters are not tried again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import configure

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'@/]+@[^\s<>\"'@]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_ACCOUNT = re.compile(r"(?:\x20*(?:no|nr|number|id))?[.]?\x20*[:#=]?\x20*([0-9](?:[\x20.-]?[0-9]){5,19})(?![0-9])", re.I)
_DIGITS = re.compile(r"[^0-9]")

# fixed values: what the automaton looks for
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("account", "acct", "konto", "cuenta", "compte", "iban", "passport", "ssn", "customer", "member")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "digit", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for spelling in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(spelling, ("cue", len(spelling)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """From an at-sign to the left over the local part, not before ``free``, and to the right."""
    begin = at
    while begin > free and text[begin - 1] in _LOCAL:
        begin -= 1
    if begin == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return (begin, domain.end()) if domain else None


def spans(text: str | None, automaton: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of one text, by kind as listed, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    number_end = 0  # end of the run of digits that was last looked at

    def take(kind: str, begin: int, end: int, valid: bool) -> None:
        free[kind] = end
        if valid:
            out[kind].append((begin, end))

    for last, (what, length) in (automaton or _automaton()).iter(text):
        at = last - length + 1
        if what == "digit":
            if at < number_end:
                continue
            number_end = at + 1
            while number_end < len(text) and "0" <= text[number_end] <= "9":
                number_end += 1
            if at >= free["ip"] and (m := _IP.match(text, at)):
                take("ip", at, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))))
            if at >= free["card"] and (m := _CARD.match(text, at)):
                digits = _DIGITS.sub("", m[0])
                take("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif what == "@":
            if at >= free["email"] and (found := _email(text, at, free["email"])):
                take("email", *found, True)
        elif what == "+":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= len(_DIGITS.sub("", m[0])) <= 15)
        elif what == "scheme":
            if at >= free["url"] and (m := _URL.match(text, last + 1)):
                take("url", at, m.end(), True)
        elif at >= free["account"]:
            word = text[at : last + 1].lower()
            if (at and text[at - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
                continue
            if word == "iban":
                begin = last + 1
                while begin < len(text) and text[begin] in " :=#":
                    begin += 1
                if begin >= free["iban"] and (m := _IBAN.match(text, begin)):
                    take("iban", begin, m.end(), _iban_holds(m[0]))
            elif m := _ACCOUNT.match(text, last + 1):
                take("account", m.start(1), m.end(1), True)
    return [(a, b, k) for k in KINDS for a, b in out[k]]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


@F.pandas_udf(_SPANS)
def _spans_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    automaton = _automaton()
    for text in texts:
        yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in spans(t, automaton)] for t in text], dtype=object)


def find_pii(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``pii``, an array of (start, end, kind) by kind, then start.

    Null and empty texts have no spans; rows that repeat are searched each; an empty table gives
    no rows. A column of ``docs`` that is named ``pii`` is replaced.
    """
    configure(docs.sparkSession)
    return docs.withColumn("pii", _spans_of("text"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in angle brackets; where spans
    overlap, the one that starts first, and then the longer one, is replaced."""
    configure(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for text in texts:
            yield pd.Series([_masked(t, automaton) for t in text], dtype=object)

    return docs.withColumn("text", masked("text"))


def _masked(text: str | None, automaton: ahocorasick.Automaton) -> str | None:
    out, at = [], 0
    for a, b, kind in sorted(spans(text, automaton), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]]) if out else text
