"""Names, labels and identifiers as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Words that mark a person slot as unfilled.
PLACEHOLDER_WORDS = ("unknown", "tbd", "tbc", "default", "fallback", "none", "null", "nan")
# Whole texts that mark an appointment as missing.
PLACEHOLDER_TEXTS = (
    "not appointed",
    "not available",
    "to be confirmed",
    "unknown",
    "tbc",
    "tbd",
    "n appointed",
    "n available",
    "t be confirmed",
)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def _lookup(key: Column, names: Mapping[str, str]) -> Column:
    if not names:
        return key
    pairs = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def canonical_name(name: Column, names: Mapping[str, str]) -> Column:
    """Trimmed name through a small dictionary; unknown names stay, null stays null."""
    return _lookup(F.trim(name), names)


def short_name(name: Column, names: Mapping[str, str]) -> Column:
    return _lookup(name, names)


def person_name(name: Column) -> Column:
    """``'Tom  Bramley (pictured)'`` -> ``'T Bramley'``; null gives an empty text."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\s*\(pictured\)\s*", ""))
    words = F.split(F.regexp_replace(clean, r"\s+", " "), " ")
    first = F.replace(words.getItem(0), F.lit("."), F.lit(""))
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), " ")
    return F.when(F.size(words) < 2, words.getItem(0)).otherwise(
        F.concat(F.upper(F.substring(first, 1, 1)), F.lit(" "), rest)
    )


def is_person(name: Column) -> Column:
    """At least two words of letters and ``. ' - ’``, none of them a placeholder."""
    word = r"[.'’\-]*\p{L}[\p{L}.'’\-]*"
    words = F.split(F.lower(F.trim(name)), r"\s+")
    placeholders = F.array(*[F.lit(w) for w in PLACEHOLDER_WORDS])
    return F.coalesce(F.trim(name).rlike(rf"^{word}(\s+{word})+$") & ~F.arrays_overlap(words, placeholders), F.lit(False))


def is_appointable(name: Column) -> Column:
    """Appointment check: Latin words with two or more parts and no placeholder text."""
    t = F.trim(name)
    return F.coalesce(
        t.rlike(r"^[A-Za-z][A-Za-z .'-]* [A-Za-z][A-Za-z '-]*$") & ~F.lower(t).isin(*PLACEHOLDER_TEXTS), F.lit(False)
    )


def text_id(fields: Sequence[Column], null_text: str = "None") -> Column:
    """First 20 hex digits of SHA-1 over the ``|``-joined fields.

    Nulls are spelled out, since ``concat_ws`` would silently drop them and
    let two different rows share an id.
    """
    parts = [F.coalesce(f.cast("string"), F.lit(null_text)) for f in fields]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20)


def reversed_score(score: Column) -> Column:
    return F.array_join(F.reverse(F.split(score, ":")), ":")


def clean_header(name: str) -> str:
    """Column name without byte-order marks (also when read in the wrong encoding) or outer blanks."""
    return name.replace("﻿", "").replace("ï»¿", "").strip()
