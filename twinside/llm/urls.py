"""Operator 2: url filters with an index on each rule's rarest literal token.

A rule is a regular expression over ``host + path`` (with a leading ``//``) and
the literal tokens that every match must hold as whole tokens. The corpus
counts of the rules' tokens choose the rarest one of each rule; a url's tokens
fetch the candidate rules, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twinside.llm.common import map_rows

TOKEN = re.compile(r"[0-9a-z]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bound of a rule list: it is held by every task.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``//host/path``; ``tokens`` are whole [0-9a-z]+ runs of each text it fits."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    stated: bool = True  # a stated rule is reported; the others only give the default verdict


def host_rule(action: str, text: str) -> Rule:
    """Rule for a host, its subdomains and paths that start with the rule's.

    A path's last run of letters and digits is an index token only if the rule
    ends after it, since a longer run may follow in the url.
    """
    host, slash, path = text.partition("/")
    path = slash + path
    whole = TOKEN.findall(host) + [m.group() for m in TOKEN.finditer(path.lower()) if m.end() < len(path)]
    return Rule(text, action, rf"^//(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole))


#: The stated rules of the query.
STATED = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)


def word_rule(first: str, second: str) -> Rule:
    """Blocks urls whose host has the two words as neighbours, as in ``first-second.example.org``."""
    return Rule(f"{first}-{second}", "block", rf"^//(?:[^/]*[.-])?{first}-{second}[.-]", (first, second), stated=False)


#: Unstated rules: they judge only urls that no stated rule fits.
DEFAULTS = (
    word_rule("casino", "win"),
    word_rule("free", "bets"),
    word_rule("cheap", "pills"),
    Rule("login", "block", r"/(?:login|signin)(?:/|$)", (), stated=False),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/"))).otherwise(F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def parts(urls: DataFrame, key: str, url: str) -> DataFrame:
    named = urls.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"))
    named = named.withColumn("url", F.coalesce("url", F.lit("")))
    host, path = split_url(F.col("url"))
    return named.select("page_id", host.alias("host"), path.alias("path"))


def token_counts(split: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """Urls that hold each token of the rules; the result is bounded by the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    text = F.translate(F.concat("host", F.lit("/"), "path"), UPPER, LOWER)
    tokens = F.array_intersect(F.regexp_extract_all(text, F.lit("[0-9a-z]+"), 0), F.array(*map(F.lit, wanted)))
    found = split.select(F.explode(tokens).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in found}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token (of equals the first by name), and those without any token."""
    by_token, always = defaultdict(list), []
    for k, r in enumerate(rules):
        if r.tokens:
            by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(k)
        else:
            always.append(k)
    return dict(by_token), always


def judge_urls(urls: DataFrame, stated: tuple[Rule, ...] = STATED, defaults: tuple[Rule, ...] = DEFAULTS, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, deciding rule and verdict of each url, one row per input row.

    The longest fitting stated rule decides (of equally long ones a block, then
    the smaller text); a url that none fits gets the verdict of the unstated
    rules, block if any fits, else ``default``. A null url, or one without
    ``://``, has an empty host and path and gets ``default`` unless a rule fits
    the empty text. Repeated rows are judged alike; an empty table gives no rows.
    """
    rules = (*stated, *defaults)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held by a task")
    split = parts(urls, key, url)
    by_token, always = rule_index(rules, token_counts(split, rules))

    def start():
        compiled: dict[int, re.Pattern] = {}

        def fits(k, text):
            if k not in compiled:
                compiled[k] = re.compile(rules[k].pattern)
            return compiled[k].search(text)

        def row(page_id, host, path):
            text = f"//{host}{path}"
            near = {k for t in set(TOKEN.findall(text.lower())) for k in by_token.get(t, ())}
            hit = [rules[k] for k in (*always, *near) if fits(k, text)]
            best = min((r for r in hit if r.stated), key=lambda r: (-len(r.name), r.action != "block", r.name), default=None)
            if best:
                return page_id, host, path, best.name, best.action
            return page_id, host, path, None, "block" if any(r.action == "block" for r in hit) else default

        return row

    return map_rows(split, start, "page_id bigint, host string, path string, rule string, verdict string")
