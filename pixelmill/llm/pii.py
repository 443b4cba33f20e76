"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod 97).  Every pattern runs in time linear in the
text: an e-mail is looked for around each ``@``, digit runs are entered at their first digit only.  An empty table gives an empty
result, columns besides doc_id and text are not read, and spans that begin at one place stand in the order of their kinds,
then of their ends.  A null or empty text
has no spans; repeated rows each give a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pixelmill.llm.spans import Span, scan_spans

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# A kind's score without context, and the words nearby that raise it.
_BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
_CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
}
_AGAINST = ("version", "example", "test", "sample", "order", "serial")


def luhn(digits: str) -> bool:
    """Whether the Luhn sum of ASCII digits is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _scored(text: str, kind: str, start: int, end: int) -> Span:
    near = (text[max(0, start - 40) : start] + " " + text[end : end + 24]).lower()
    hit = next((w for w in _CONTEXT[kind] if re.search(rf"(?<![a-z]){w}", near)), "")
    score = _BASE_SCORE[kind] + (0.2 if hit else 0.0) - (0.2 if any(w in near for w in _AGAINST) else 0.0)
    return kind, start, end, round(min(1.0, max(0.0, score)), 4), hit


def pii_spans(text: str) -> list[Span]:
    """All spans of a text, base kinds first."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            found.append(("iban", m.start(), m.end()))
    return [_scored(text, *x) for x in found]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, found (spans with score and context word), n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return scan_spans(docs, pii_spans, KINDS, by_kind=True)
