"""Operator 7: personal data, in DataFrame and SQL functions only.

Regular expressions propose spans, checksums confirm card and bank account
numbers, and context words just before a span adjust its score. Base kinds are
always reported; the other kinds need a score.

The expressions are written for Java's matcher, so that no text makes them
slow: a run of characters is entered at its start only (or where the previous
match ended) and never given back. They match exactly what the plain forms in
``KINDS`` match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    plain: str  # what is meant
    pattern: str  # the same matches, without backtracking
    hint: str  # a text without it has no match
    valid: str  # SQL over the matched text t
    context: str  # words that speak for it when they stand before it
    score: float  # without context, when valid
    base: bool = True
    ahead: bool = False  # the pattern is a look-ahead whose first group is the match, so that matches may overlap


#: ISO 13616: how long account numbers are in each country that has them, the countries that only announced theirs too.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BF BI BJ CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC NI", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?=((?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])))"

LUHN = (
    "aggregate(transform(sequence(1, length(d)), i -> IF(i % 2 = 1, int(substring(reverse(d), i, 1)), "
    "2 * int(substring(reverse(d), i, 1)) - IF(substring(reverse(d), i, 1) >= '5', 9, 0))), 0, (a, x) -> a + x) % 10 = 0"
)
DIGITS = "regexp_replace(t, '[^0-9]', '')"
CARD = f"IF(length({DIGITS}) BETWEEN 13 AND 19, exists(array({DIGITS}), d -> {LUHN}), false)"
IP = "forall(split(t, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"
PHONE = f"length({DIGITS}) BETWEEN 9 AND 15"
#: ISO 13616: the first four characters go to the end, letters count from 10, the number is 1 modulo 97.
MOD97 = (
    "exists(array(replace(t, ' ', '')), c -> length(c) BETWEEN 15 AND 34 AND aggregate(sequence(1, length(c)), 0, (a, i) -> "
    "IF(substring(substring(c, 5) || left(c, 4), i, 1) <= '9', a * 10 + int(ascii(substring(substring(c, 5) || left(c, 4), i, 1)) - 48), "
    "a * 100 + ascii(substring(substring(c, 5) || left(c, 4), i, 1)) - 55) % 97) = 1)"
)

KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", "mail|contact|write", 0.8),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", IP, "ip|host|server|address", 0.6),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+", "", CARD, "card|visa|pay|credit|debit", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "+", PHONE, "phone|tel|call|mobile|fax", 0.6),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30} of its country's length", IBAN, "", MOD97, "iban|account|bank|konto", 0.9, base=False, ahead=True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "left(t, 3) NOT IN ('000', '666') AND left(t, 1) <> '9' AND substring(t, 5, 2) <> '00' AND right(t, 4) <> '0000'", "ssn|social security|tax id", 0.4, base=False),
)
#: Code points before a span that are searched for its context words, what they add, and the score a span needs.
CONTEXT_CHARS, CONTEXT_SCORE, LEAST_SCORE = 40, 0.3, 0.6
SPAN = "array<struct<s:bigint,e:bigint,t:string,before:string>>"


def located(gaps: str, found: str, ahead: bool = False) -> str:
    """SQL for the spans of the matches ``found`` between ``gaps``: running sums of both lengths.

    Sums run inside blocks of about the square root of the number of matches,
    and over the blocks, so a text of many matches does not copy its list for
    each of them. ``tail`` is the end of the text so far, earlier matches
    included. Matches of a look-ahead have no width, and their first gap begins
    with a line break that is not in the text.
    """
    step = f"int(ceil(sqrt(size({found}))))"
    start = f"a.at + length({gaps}[i])"
    before = f"right(concat(a.tail, {gaps}[i]), {CONTEXT_CHARS})"
    width, tail = ("0", before) if ahead else (f"length({found}[i])", f"right(concat(a.tail, {gaps}[i], {found}[i]), {CONTEXT_CHARS})")
    one = f"named_struct('at', {start} + {width}, 'tail', {tail}, 'out', concat(a.out, array(named_struct('s', {start}, 'e', {start} + length({found}[i]), 't', {found}[i], 'before', {before}))))"
    state = f"struct<at:bigint,tail:string,out:{SPAN}>"
    block = f"aggregate(sequence(b, least(b + {step}, size({found})) - 1), cast(named_struct('at', o.at, 'tail', o.tail, 'out', array()) AS {state}), (a, i) -> cast({one} AS {state}))"
    outer = f"struct<at:bigint,tail:string,out:array<{SPAN}>>"
    return (
        f"IF(size({found}) = 0, cast(array() AS {SPAN}), aggregate(sequence(0, size({found}) - 1, {step}), cast(named_struct('at', {-1 if ahead else 0}, 'tail', '', 'out', array()) AS {outer}), "
        f"(o, b) -> cast(element_at(transform(array({block}), z -> named_struct('at', z.at, 'tail', z.tail, 'out', concat(o.out, array(z.out)))), 1) AS {outer}), o -> flatten(o.out)))"
    )


def literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def told(kind: Kind) -> Column:
    return F.expr(f"transform({kind.name}, x -> concat('{kind.name}:', x.s, ':', x.e))")


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of each whole text, one row per input row, without a shuffle.

    Offsets are code points, ends exclusive. A null or empty text has no spans
    (``base_sha256`` is then the digest of the empty text); a null id stays
    null; repeated rows are searched alike; an empty table gives no rows.
    ``scores`` has one number for each entry of ``spans``.
    """
    df = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    none = "cast(array() AS array<string>)"
    found = {k.name: F.expr((f"IF(contains(text, '{k.hint}'), " if k.hint else "IF(true, ") + f"regexp_extract_all(text, {literal(k.pattern)}, {int(k.ahead)}), {none})") for k in kinds}
    df = df.withColumns({f"m_{n}": c for n, c in found.items()})
    df = df.withColumns({f"g_{k.name}": F.expr(f"IF(size(m_{k.name}) = 0, {none}, split({"concat(chr(10), text)" if k.ahead else "text"}, {literal(k.pattern)}, -1))") for k in kinds}).drop("text")
    df = df.withColumns({k.name: F.expr(f"filter({located(f'g_{k.name}', f'm_{k.name}', k.ahead)}, x -> exists(array(x.t), t -> {k.valid}))") for k in kinds})
    scored = {k.name: F.expr(f"transform({k.name}, x -> struct(x.s, x.e, cast(IF(lower(x.before) RLIKE '(?:{k.context})', least(1.0D, {k.score}D + {CONTEXT_SCORE}D), {k.score}D) AS double) AS score))") for k in kinds}
    df = df.select("doc_id", *[c.alias(n) for n, c in scored.items()])
    added = {k.name: F.expr(f"filter({k.name}, x -> x.score >= {LEAST_SCORE}D)") for k in kinds if not k.base}
    df = df.withColumns(added) if added else df
    base = [told(k) for k in kinds if k.base]
    every = [told(k) for k in kinds]
    return df.select(
        "doc_id",
        *[F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in kinds if k.base],
        F.sha2(F.concat_ws(",", F.concat(*base)), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(*every)).alias("spans"),
        F.concat_ws(",", F.concat(*[F.expr(f"transform({k.name}, x -> format_number(x.score, 2))") for k in kinds])).alias("scores"),
    )
