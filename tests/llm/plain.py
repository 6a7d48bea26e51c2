"""Plain Python versions of what the corpus operators return, and a small table with every odd case."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that clash with columns the operators use inside.
CLASH = {"f0": "1", "key": "2", "node": "3", "words": "4", "spans": "5", "kept": "6", "h": "7", "window": "8", "component_id": "9", "value": "10", "part": "11"}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def prose(n: int, seed: int = 0) -> str:
    """Invented words in lines of ten."""
    words = [f"w{xxhash.xxh32_intdigest(f'{seed}.{i}') % 5000}" for i in range(n)]
    return "\n".join(" ".join(words[i : i + 10]) + "." for i in range(0, n, 10))


def odd_documents() -> list[tuple]:
    """(doc_id, text): null and empty texts, a null id, repeated rows and ids, ties, a long line and a long text."""
    base = prose(200)
    return [
        (1, base),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, base),
        (5, base),
        (6, base.replace("w", "W", 1)),
        (7, "a" * 30_000),
        (8, prose(8_000, 7)),
        (9, "x y z"),
        (9, "other text of the same id"),
        (None, prose(50, 3)),
        (None, None),
        (10, "café ☃ \U0001f600 naïve 　end\x1c\x85 it's\n\n  two  blanks \r\n"),
        (11, "<|endoftext|> <|im_end|>\0 nul"),
    ]


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text: str | None) -> int:
    words = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in found:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(found))


def joined(nodes, linked) -> dict:
    """Smallest reachable node by all pairs of nodes."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {n: top(n) for n in nodes}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: all(int(p) <= 255 for p in g.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda g, d: 13 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 9 <= len(d) <= 15),
    }
    counts, spans = [], []
    for kind, (pattern, valid) in checks.items():
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if valid(m.group(), re.sub("[^0-9]", "", m.group()))]
        counts.append(len(own))
        spans += own
    return (*counts, sha(",".join(spans)))


def secret(text: str | None) -> tuple:
    kinds = (
        (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    )
    counts, spans = [], []
    for k, (pattern, valid) in enumerate(kinds):
        own = [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", re.A) if valid(m)]
        counts.append(len(own))
        spans += own
    return (*counts, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))))


def quality(text: str | None) -> tuple:
    """Words, their characters, symbols, repeated lines, words in repeated windows, and the base verdict."""
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def letter_words(text: str | None) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def leaks(docs, items, least: float = 0.8) -> dict:
    """(doc_id, item_id) to the largest share of an item's shingle weight in any window of its size."""
    held = {i: (len(w), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, t in items if i is not None and len(w := letter_words(t)) >= 5}
    df = Counter(s for _, ss in held.values() for s in ss)
    weight = {s: 1 + math.log(len(held) / c) for s, c in df.items()}
    by = defaultdict(set)
    for i, (_, ss) in held.items():
        for s in ss:
            by[s].add(i)
    out = {}
    for d, t in docs:
        words = letter_words(t)
        found = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        for i in {i for s in found for i in by.get(s, ())} if d is not None else ():
            n, ss = held[i]
            total = sum(weight[s] for s in ss)
            share = max(sum(weight[s] for s in set(found[a : a + n - 4]) & ss) / total for a in range(max(1, len(words) - n + 1)))
            if share >= least - 1e-9:
                out[d, i] = max(out.get((d, i), 0), round(share, 6))
    return out
