"""Url rules, secrets, html text, personal data and quality rules against plain versions."""

import random
import re

import pytest
from plain import CLASH, odd_documents, personal, prose, quality, secret, sha
from pyspark.sql import functions as F

from twinside.llm import html_text, pii, quality as rules, secrets, urls


def wide(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def judged(url):
    """Every rule tried on every url."""
    rest = re.split("[?#]", url.split("://", 1)[1])[0] if url and "://" in url else ""
    host, slash, path = rest.partition("/")
    host, path = re.sub("[A-Z]", lambda m: m.group().lower(), host), slash + path
    best = None
    for r in urls.STATED:
        own, _, tail = r.name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(r.name) > len(best.name)):
            best = r
    if best:
        return host, path, best.name, best.action
    return host, path, None, "block" if any(re.search(r.pattern, f"//{host}{path}") for r in urls.DEFAULTS) else "allow"


def test_urls(spark):
    rng = random.Random(1)
    bits = ["http://", "https://", "com", "example", "net", "www", ".", "/", "en", "es", "/en/", "/fr/", "?", "#", "://", "X", "casino-win", "example.com", "www.example.com/en/", "login", "\n", "K", ""]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(1_500)]
    rows += [(None, None), (7, None), (7, ""), (8, "HTTP://WWW.Example.COM/en/" + "a" * 50_000)]
    got = urls.judge_urls(wide(spark.createDataFrame(rows, "page_id bigint, url string"))).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((k, *judged(u))) for k, u in rows)
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_rules_stand_under_their_rarest_token():
    index, always = urls.rule_index((*urls.STATED, *urls.DEFAULTS), {"com": 900, "net": 300, "example": 800, "www": 100, "en": 500, "es": 20, "fr": 10, "casino": 5, "win": 6})
    names = (*urls.STATED, *urls.DEFAULTS)
    assert {t: [names[k].name for k in ks] for t, ks in index.items()}["www"] == ["www.example.com/en/"]
    assert [names[k].name for k in index["fr"]] == ["net/fr/"] and [names[k].name for k in always] == ["login"]
    partial = urls.host_rule("block", "example.com/ca")
    assert partial.tokens == ("example", "com")  # /ca may go on as /casino
    with pytest.raises(ValueError):
        urls.judge_urls(None, stated=urls.STATED * 100_000)


SOURCE = 'base = "Zx81kkQpw02LmN"\nname = "plain words here"\nDB_PASSWORD = base\nkey = "abc" + "Tq9Zw7Lk2Xv"\nclient_secret: "changeme-please-1"\n'


def test_secrets(spark):
    rng = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCD1234EFGH5678IJ", "0123456789abcdef0", "Zx81kkQpw02LmN", "\n", "ſ", "\U0001f600", "deadbeef", "-", "x"]
    rows = odd_documents() + [(100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(800)]
    rows += [(90, 'token = "' + "a1" * 40_000 + '"'), (91, "a=" * 20_000), (92, "f" * 100_000)]
    df = wide(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = secrets.scan_secrets(df).collect()
    assert sorted((str(r[0]), *tuple(r)[1:5]) for r in found) == sorted((str(d), *secret(t)) for d, t in rows)
    for r, base in ((r, r["base_sha256"]) for r in found):
        assert sha(",".join(s for s in r["spans"].split(",") if s and not s.startswith("lexed"))) == base
    assert secrets.scan_secrets(df.limit(0)).collect() == []


def test_constants_reach_sensitive_names():
    spans = [SOURCE[a:b] for a, b in secrets.lexed_spans(SOURCE, secrets.Limits().score)]
    assert spans == ["Zx81kkQpw02LmN"]
    assert secrets.lexed_spans('a = "Qw8"\nb = a + "Er7Ty6Ui5"\nauth_token = b\n', 0.9) == [(5, 8), (19, 28)]
    assert secrets.lexed_spans("The secret: information about tokens is here.", 0.9) == []
    text = 'x token = "f3ef4d6b2755a36d7d9c" y'
    assert secrets.redacted(text, secrets.secret_spans(text), "<SECRET>") == 'x token = "<SECRET>" y'


PAGES = {
    "div": ('<body><div id="nav"><a>Home</a></div><div class="content"><h2>T &amp; x</h2><p>First  para long enough\n to be text.<p>Second &eacute;<br>c</div><div class="comments"><p>a long comment by some reader of the page</div><div class=footer>f', "T & x\n\nFirst para long enough to be text.\n\nSecond é c"),
    "plain": ("just text", "just text"),
    "script": ('<script>var a="<p>x</p>"</script><style>p{}</style><p>Hello <i>wor</i>ld<!-- no -->', "Hello world"),
    "article": ("<nav><ul><li>Home</ul></nav><article><h1>A</h1><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><aside>side</aside><form>sub</form><p>tail</article><footer>z</footer>", "A\n\none\n\ntwo\n\nx\n\ny\n\ntail"),
    "notice": ('<div class="cookie-notice">We use cookies</div><main><section><p>Alpha beta.</section><section><p>Gamma delta.</section></main>', "Alpha beta.\n\nGamma delta."),
    "sidebar": ('<body class="has-sidebar"><article class="post"><p>Text one.</p></article><article class="comment"><p>A comment that is long, longer, longest of all texts.</p></article>', "Text one."),
    "furniture": ("<nav>a</nav><footer>b</footer>", ""),
    "empty": ("", ""),
    "broken": ("<p>a < b & c</b></i><p>end <unknown>tag", "a < b & c\n\nend tag"),
}


def test_pages(spark):
    rows = [(k, f"u{k}", PAGES[n][0]) for k, n in enumerate(PAGES)] + [(None, None, None), (99, None, "<article>" + "<p>word " * 20_000), (99, None, "<div>" * 3_000 + "deep")]
    got = html_text.extract_pages(wide(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None and r["page_id"] < 99} == {k: PAGES[n][1] for k, n in enumerate(PAGES)}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and sorted(r["n_chars"] for r in got if r["page_id"] == 99) == [4, 20_000 * 4 + 19_999 * 2]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_ratios_are_smoothed():
    flat = html_text.smoothed([1.0, 1.0, 1.0])
    assert all(abs(v - 1) < 1e-12 for v in flat) and html_text.smoothed([]) == []
    assert html_text.content_lines([2, 3, 2, 200, 180, 210, 3, 2, 2], [4, 4, 6, 1, 1, 1, 6, 5, 6]) == [False, False, True, True, True, True, True, False, False]  # smoothing takes in the neighbours


def test_personal_data(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "_", "%", "1.2.3.4", ".", "255", " ", "+1 ", "\U0001f600", "(", "4929348385146306", "-", "5", "\n", "DE89370400440532013000", " account ", "123-45-6789", " ssn ", "x@y", "é", "+49 30 1234567"]
    rows = odd_documents() + [(100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))) for k in range(800)]
    rows += [(90, "1" * 3_000), (91, "1 2-" * 5_000), (92, "a@b.c " * 3_000), (93, "1." * 9_000), (94, "+1" + " " * 9_000)]
    df = wide(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = pii.find_pii(df).collect()
    assert sorted((str(r[0]), *tuple(r)[1:6]) for r in found) == sorted((str(d), *personal(t)) for d, t in rows)
    assert pii.find_pii(df.limit(0)).collect() == []
    for r in found:
        assert len(r["spans"].split(",")) == len(r["scores"].split(","))


def test_checksums_and_context(spark):
    rows = [(1, "account DE89370400440532013000 now"), (2, "account DE89370400440532013001 now"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789"), (5, "GB82 WEST 1234 5698 7654 32")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "iban:8:30", 2: "", 3: "ssn:4:15", 4: "", 5: "iban:0:27"}


def test_quality(spark):
    rows = odd_documents() + [(20, "line one here now ok\n" * 4 + prose(60)), (21, " ".join(f"{w}***" for w in prose(80).split())), (22, "A!! B!! C!! D!! " * 9), (23, prose(40) + "\n" + " | ".join(prose(30, 2).split()))]
    df = wide(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = rules.quality_verdicts(df).collect()
    assert sorted((str(r[0]), *tuple(r)[1:7]) for r in found) == sorted((str(d), *quality(t)) for d, t in rows)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert kept[1] and kept[8] and not kept[21] and not kept[22] and not kept[2] and kept[23]
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert rules.quality_verdicts(df.limit(0)).collect() == []


def test_lines_go_before_documents():
    r = rules.Rules()
    assert [rules.line_fails(x, x.split(), r) for x in ("a*** b$$$ c###", "X!! Y!! Z!!", "home » news » sport » more", "so so so so so so", "All rights reserved by us", "a plain line of text.")] == ["symbols", "shouting", "navigation", "stutter", "boilerplate", None]
    *_, kept, lost, clean = rules.judged("one two three four five six seven eight nine ten eleven.\nhome | news | sport | more", r)
    assert kept and lost and clean == "one two three four five six seven eight nine ten eleven."
