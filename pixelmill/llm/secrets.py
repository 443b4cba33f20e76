"""Secret scan by assignment-aware lexing.

The lexer walks over the operators ``=``, ``:``, ``:=`` and ``=>`` of a text, reads the name to the left of each and the
expression to the right: quoted literals, bare words and sums of these, in the syntax that source code, shell, YAML,
JSON, INI and .env files share.  Literals that a name gets are kept as constants; a name to the right of a later
operator stands for its constant, so ``A = "x1..."; password = A`` marks the literal ``x1...``; so do ``$A`` and ``${A}``,
bare or in double quotes, alone or several in a row.  A literal scores by how
sensitive the words of its target name are and by its form (length, mix of characters, no placeholder).  Literals of at
least ``threshold`` are spans of kind ``literal``.

A bare word ends before the next operator, so the lexer's time is in proportion to the text.  Quoted literals and names
end where a line ends, comments are read like code, and a name has the literal it got last: scopes are not told apart.

Base kinds assign, access and hex are found by patterns and always kept.  A null or empty text has no spans; repeated
rows each give a row; an empty table gives an empty result; columns besides doc_id and text are not read.  Where spans
begin at one place, the kinds stand in the order assign, access, hex, literal.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from pixelmill.llm.spans import Span, scan_spans

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# What the words of a name say about the literal that it gets.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.6, "signature": 0.6, "salt": 0.5, "dsn": 0.5,
    "key": 0.5, "access": 0.4, "api": 0.4, "client": 0.2, "session": 0.4, "cookie": 0.4, "encryption": 0.4, "webhook": 0.4,
}
_HARMLESS = {"public", "id", "name", "url", "uri", "path", "file", "length", "size", "count", "type", "index", "expires", "limit", "max", "min"}
_PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "required", "string", "redacted"}

_OPERATOR = re.compile(r":=|=>|==|!=|<=|>=|[:=]")
_QUOTED = re.compile(r"""[bBrRuUfF]{0,2}("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)""")
#: A bare word ends before the next operator; the = that pad base64 at its end belong to it.
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>=:]+(?:={1,2}(?![^\s"'`,;(){}\[\]<>]))?""")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z")
_REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
_REFERENCES = re.compile(rf"""(?:{_REFERENCE.pattern})+(?![^\s"'`,;()\[\]<>])""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Length, characters, first and last ones of a literal, and whether it holds "://".
Mix = tuple[int, Counter[str], str, str, bool]
_EDGE = 1 + max(map(len, _PLACEHOLDERS))
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.$")


def base_spans(text: str) -> list[Span]:
    """The spans of the three patterns, leftmost and without overlap in each kind."""
    out: list[Span] = [("assign", m.start(), m.end(), 1.0, m[1].lower()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 1.0, "") for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end(), 0.6, "") for m in _HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """0 to 1 from the words of a name in snake, kebab or camel case."""
    parts = [x.lower() for x in _WORDS.findall(name)]
    if not parts or parts[-1] in _HARMLESS:
        return 0.0
    joined = "".join(parts)
    score = sum(_SENSITIVE.get(x, 0.0) for x in set(parts))
    return min(1.0, max(score, 0.9 if joined.endswith(("apikey", "secretkey", "accesskey", "privatekey")) else 0.0))


class Value:
    """What a name gets: literals (content, start, end) and other values in order; its form is that of all joined.

    Values are shared, so a text's values take memory in proportion to the text.
    """

    __slots__ = ("mix", "parts")

    def __init__(self, parts: list[tuple[str, int, int] | Value]):
        self.parts, self.mix = parts, None

    def form(self) -> float:
        """0 to 1 from the joined literal's length and mix of characters; placeholders, references and prose are 0."""
        todo = [self]
        while todo:
            value = todo[-1]
            if value.mix is None and (missing := [x for x in value.parts if isinstance(x, Value) and x.mix is None]):
                todo += missing
                continue
            todo.pop()
            if value.mix is None:
                value.mix = _joined([x.mix if isinstance(x, Value) else _mix(x[0]) for x in value.parts])
        return _form(*self.mix)


def _mix(literal: str) -> Mix:
    return len(literal), Counter(literal), literal[:_EDGE], literal[-2:], "://" in literal


def _joined(parts: list[Mix]) -> Mix:
    """What :func:`_mix` gives for the joined literals."""
    if len(parts) == 1:
        return parts[0]
    n, counts, head, tail, url = 0, Counter(), "", "", False
    for n_, counts_, head_, tail_, url_ in parts:
        url = url or url_ or "://" in tail + head_[:2]
        head = head if n >= _EDGE else head + head_[: _EDGE - n]
        n, tail = n + n_, (tail + tail_)[-2:]
        counts.update(counts_)
    return n, counts, head, tail, url


def form(literal: str) -> float:
    """The form of one literal."""
    return _form(*_mix(literal))


def _form(n: int, counts: Counter[str], head: str, _: str, url: bool) -> float:
    if n < 6 or (n < _EDGE and head.lower() in _PLACEHOLDERS) or head.startswith(("${", "$(", "{{", "<", "%(")) or " " in counts or url:
        return 0.0
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if kinds < 2:
        return 0.0
    entropy = -sum(p * math.log2(p) for c in counts.values() if (p := c / n))
    return min(1.0, 0.15 * kinds + 0.1 * entropy + 0.01 * min(n, 24))


def _name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, spaces and one quote aside."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] in "\"'`]":
        i -= 1
        while i and text[i - 1] in "\"'`":
            i -= 1
    end = i
    while i and text[i - 1] in _NAME:
        i -= 1
    return text[i:end].strip(".-")


def _terms(text: str, at: int) -> tuple[list[tuple[str, int, int, bool]], int]:
    """The terms of ``a + b + ...`` from ``at``: content, start, end, quoted; and the place behind them."""
    out = []
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        if m := _QUOTED.match(text, at):
            out.append((m[1][1:-1], m.start(1) + 1, m.end(1) - 1, True))
        elif m := _REFERENCES.match(text, at) or _BARE.match(text, at):
            out.append((m[0], m.start(), m.end(), False))
        else:
            return out, at
        at = m.end()
        after = at
        while after < len(text) and text[after] in " \t":
            after += 1
        if text[after : after + 1] != "+":
            return out, at
        at = after + 1


def _resolved(content: str, quoted: bool, before: str, constants: dict[str, Value]) -> list[Value]:
    """The constants that a term stands for: a bare name, or references like $A and ${A}, bare or in double quotes."""
    if not quoted and _IDENTIFIER.match(content) and content in constants:
        return [constants[content]]
    if "$" not in content or (quoted and before != '"') or not _REFERENCES.fullmatch(content):
        return []
    names = [m[1] or m[2] for m in _REFERENCE.finditer(content)]
    found = [constants.get(x) or constants.get(f"${x}") for x in names]
    return [] if None in found else found


def lexed_spans(text: str, threshold: float = 0.75) -> list[Span]:
    """Literals that sensitive names get, directly or through constants."""
    constants: dict[str, Value] = {}
    marked: list[tuple[float, str, Value]] = []
    at = 0
    while m := _OPERATOR.search(text, at):
        at = m.end()
        if m[0] in ("==", "!=", "<=", ">="):
            continue
        name = _name_before(text, m.start())
        if not name or name[0].isdigit():
            continue
        terms, end = _terms(text, at)
        if any(x[3] for x in terms):
            at = max(at, end)
        if not terms:
            continue
        parts: list[tuple[str, int, int] | Value] = []
        for content, a, b, quoted in terms:
            parts += _resolved(content, quoted, text[a - 1 : a], constants) or [(content, a, b)]
        value = constants[name] = Value(parts)
        weight = sensitivity(name)
        if weight and (score := weight * value.form()) >= threshold * 0.8:
            marked.append((score, name, value))
    # from the highest score down, so each value is walked once
    out: dict[tuple[int, int], Span] = {}
    seen: set[int] = set()
    for score, name, value in sorted(marked, key=lambda x: -x[0]):
        todo: list[tuple[str, int, int] | Value] = [value]
        while todo:
            part = todo.pop()
            if not isinstance(part, Value):
                _, a, b = part
                if b > a and (a, b) not in out:
                    out[a, b] = ("literal", a, b, round(score, 4), name)
            elif id(part) not in seen:
                seen.add(id(part))
                todo += reversed(part.parts)
    return list(out.values())


def secret_spans(text: str) -> list[Span]:
    """All spans of a text: the base kinds, and literals that lie in no base span of kind assign."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base
    taken = [(s[1], s[2]) for s in base if s[0] == "assign"]  # in order, without overlap
    starts = [a for a, _ in taken]

    def covered(a: int, b: int) -> bool:
        i = bisect_right(starts, a) - 1
        return i >= 0 and b <= taken[i][1]

    return base + [s for s in lexed_spans(text) if not covered(s[1], s[2])]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found (spans with score and the name that made them sensitive), n_assign, n_access, n_hex, base_sha256, spans."""
    return scan_spans(docs, secret_spans, KINDS, by_kind=False)
