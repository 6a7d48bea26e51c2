"""Operator 3: secret scan by assignment-aware lexing.

Source and configuration syntax is lexed into name-literal pairs. Names keep
the literals assigned to them, so a literal that reaches a sensitive name
through constants or concatenation is scored by that name. Pattern spans
(assignments, access keys, hex runs) are always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "lexed")

OPERAND = r""""(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'|[A-Za-z0-9+/_=.$@!%^*~-]++"""
#: name, an operator of assignment, and one or more operands joined by + signs
STATEMENT = re.compile(
    rf"""(?<![\w.-])(?P<name>[A-Za-z_][\w.-]*+)(?:["']\]?)?[ \t]*+(?:=>|:=|=(?!=)|:(?![:/]))[ \t]*+(?P<value>(?:{OPERAND})(?:[ \t]*+\+[ \t]*+(?:{OPERAND}))*+)""",
    re.A,
)
OPERANDS = re.compile(OPERAND, re.A)
NAME = re.compile(r"[A-Za-z_][\w.-]*", re.A)
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)
#: Words of sensitive names and how much each tells.
SENSITIVE = {"password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.6, "secret": 0.6, "token": 0.6, "apikey": 0.6, "credential": 0.6, "credentials": 0.6, "bearer": 0.5, "auth": 0.4, "private": 0.4, "access": 0.3, "api": 0.3, "key": 0.3, "salt": 0.3, "signature": 0.3}
PLACEHOLDER = re.compile(r"(?i:change.?me|example|placeholder|your|xxxx|todo|none|null|true|false|environ|getenv)|[$%]\{?[A-Za-z_]", re.A)


@dataclass(frozen=True)
class Limits:
    """Lengths of the pattern kinds and the score from which a lexed literal is reported."""

    assign: int = 12
    access: int = 18
    hex: int = 16
    score: float = 0.9


def name_score(name: str) -> float:
    words = [w.lower() for w in PIECE.findall(name)]
    return min(0.7, sum(SENSITIVE.get(w, 0.0) for w in dict.fromkeys(words)))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def literal_score(value: str) -> float:
    """How much a literal looks like key material: length, entropy and kinds of characters."""
    if len(value) < 8 or PLACEHOLDER.search(value) or " " in value:
        return 0.0
    classes = sum(1 for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]") if re.search(p, value))
    return 0.2 + 0.2 * (entropy(value) >= 3.0) + 0.1 * (classes >= 2)


def lexed_spans(text: str, least: float) -> list[tuple[int, int]]:
    """Spans of literals whose score with a sensitive target name is ``least`` or more.

    Constants are propagated in reading order; a name holds the literals of its
    last assignment. A literal that reaches several names is reported once.
    """
    held: dict[str, tuple[str, tuple]] = {}
    found = set()
    for m in STATEMENT.finditer(text):
        value, spans, quoted = "", [], False
        for o in OPERANDS.finditer(text, m.start("value"), m.end("value")):
            word = o.group()
            if word[0] in "\"'":
                value, quoted = value + word[1:-1], True
                spans.append((o.start() + 1, o.end() - 1))
            elif word in held:
                value, quoted = value + held[word][0], True
                spans += held[word][1]
            elif re.search("[0-9]", word) and not NAME.fullmatch(word) or len(word) >= 8 and sum(c.isdigit() for c in word) >= 2:
                value += word
                spans.append((o.start(), o.end()))
        if not spans:
            held.pop(m["name"], None)
            continue
        held[m["name"]] = (value, tuple(dict.fromkeys(spans)))
        if name_score(m["name"]) + literal_score(value) >= least:
            found.update(spans)
    return sorted(s for s in found if s[1] > s[0])


def secret_spans(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int, int]]:
    """All spans as (start, kind number, end, start of the secret itself), by start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= limits.assign]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= limits.access]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= limits.hex]
    out += [(s, 3, e, s) for s, e in lexed_spans(text, limits.score)]
    return sorted(out)


def told(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, int, int]], mark: str) -> str:
    """The text with every secret (of an assignment its value) replaced by ``mark``; touching spans become one."""
    out, at = [], 0
    for start, end in sorted((inner, e) for _, _, e, inner in spans):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of each whole text, one row per input row, without a shuffle.

    Offsets are code points, ends exclusive. A null or empty text has no spans
    (``base_sha256`` is then the digest of the empty text); a null id stays
    null; repeated rows are scanned alike; an empty table gives no rows.
    """

    def start():
        def row(key, body):
            spans = secret_spans(body or "", limits)
            base = [s for s in spans if s[1] < 3]
            counts = Counter(s[1] for s in spans)
            return key, counts[0], counts[1], counts[2], hashlib.sha256(told(base).encode()).hexdigest(), told(spans), counts[3]

        return row

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return map_rows(rows, start, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lexed bigint")


def redact_documents(docs: DataFrame, limits: Limits = Limits(), mark: str = "<SECRET>") -> DataFrame:
    """Every document, its secrets replaced by ``mark``, in the columns of ``documents``; ``n_chars`` follows the text."""

    def start():
        def row(key, body, lang, source, n_chars):
            spans = secret_spans(body or "", limits)
            if not spans:
                return key, body, lang, source, n_chars
            clean = redacted(body, spans, mark)
            return key, clean, lang, source, len(clean)

        return row

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return map_rows(rows, start, "doc_id bigint, text string, lang string, source string, n_chars bigint")
