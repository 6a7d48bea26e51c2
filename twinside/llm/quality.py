"""Operator 8: line-first quality rules.

Every line is judged by punctuation, navigation, boilerplate and repetition
rules; failing lines go; a document that loses too much of its text, or fails
the whole-text base rules, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import map_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Phrases of page furniture; a line that is theirs to a large part is boilerplate.
BOILERPLATE = ("all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "terms of use")
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict."""

    min_words: int = 10  # a shorter text fails
    max_repeat_percent: int = 20  # a text with more of its words in repeated windows fails
    max_symbols_per_word: float = 0.4  # a line with more is decoration
    max_shouted: float = 0.6  # a line of 3 words or more with more of them ending in two marks such as !! is shouting
    min_separators: int = 3  # a line with so many | or > or bullets between words is navigation, if its share of them is large enough
    min_separator_share: float = 0.2  # of its words, separators included
    min_boilerplate_share: float = 0.2  # a line with so many of its words in boilerplate phrases is boilerplate
    max_stutter: float = 0.4  # a line of 4 words or more with more of them equal to the word before stutters
    max_lost_percent: int = 50  # a text losing more of its word characters is rejected


SHOUT = re.compile(r"[!?]{2,}$")
SEPARATOR = re.compile(r"^[|>»•·]+$")


def line_fails(line: str, words: list[str], rules: Rules) -> str | None:
    """The first rule that a line with words breaks: symbols, shouting, navigation, stutter or boilerplate."""
    if len(SYMBOLS.findall(line)) > rules.max_symbols_per_word * len(words):
        return "symbols"
    if len(words) >= 3 and sum(1 for w in words if SHOUT.search(w)) > rules.max_shouted * len(words):
        return "shouting"
    if sum(1 for w in words if SEPARATOR.match(w)) >= max(rules.min_separators, rules.min_separator_share * len(words)):
        return "navigation"
    if len(words) >= 4 and sum(map(str.__eq__, words, words[1:])) > rules.max_stutter * len(words):
        return "stutter"
    low = line.lower()
    phrases = sum(low.count(p) * len(p.split()) for p in BOILERPLATE)
    if phrases and phrases >= rules.min_boilerplate_share * len(words):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five words found twice or more."""
    first, hit = {}, bytearray(len(words))
    for i in range(len(words) - WINDOW + 1):
        at = first.setdefault(tuple(words[i : i + WINDOW]), i)
        if at != i:
            hit[i : i + WINDOW] = hit[at : at + WINDOW] = b"\x01" * WINDOW
    return hit.count(1)


def judged(text: str | None, rules: Rules) -> tuple:
    """Counts, verdict and cleaned text of one document."""
    text = text or ""
    n_words = chars = n_dup = lost = 0
    every, seen, kept_lines = [], set(), []
    for line in text.split("\n"):
        words = WORD.findall(line)
        every += words
        own = sum(map(len, words))
        chars += own
        if not words:
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or line_fails(line, words, rules):
            lost += own
        else:
            kept_lines.append(line)
    n_words = len(every)
    repeat = repeated_words(every)
    failed = n_words < rules.min_words or 100 * repeat > rules.max_repeat_percent * n_words
    kept = not failed and 100 * lost <= rules.max_lost_percent * chars
    return n_words, chars, len(SYMBOLS.findall(text)), n_dup, repeat, failed, kept, lost, "\n".join(kept_lines)


VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint"


def starter(rules: Rules, cleaned: bool) -> Callable:
    def start():
        def row(doc_id, text):
            found = judged(text, rules)
            return (doc_id, *found) if cleaned else (doc_id, *found[:-1])

        return row

    return start


def quality_verdicts(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", cleaned: bool = False) -> DataFrame:
    """Counts and verdict of every document, one row per input row, without a shuffle.

    A null or empty text has no words and fails; a null id stays null; repeated
    rows are judged alike; a very long line or text is judged whole; an empty
    table gives no rows. ``cleaned`` adds the text without its failing lines.
    """
    ddl = f"doc_id bigint, {VERDICT}" + ", clean_text string" * cleaned
    return map_rows(docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")), starter(rules, cleaned), ddl)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``documents``.

    ``n_chars`` follows the text; columns other than the five of ``documents`` go.
    """
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"

    def start():
        def row(doc_id, text, lang, source):
            *_, kept, _, clean = judged(text, rules)
            return doc_id, clean, lang, source, len(clean), kept

        return row

    return map_rows(docs.select("doc_id", "text", "lang", "source"), start, ddl).filter("kept").drop("kept")
