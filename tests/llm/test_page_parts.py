"""Articles in sibling containers of uneven size stay whole."""

import pytest

from twinside.llm import html_text

LONG, SHORT = "Alpha beta gamma delta epsilon zeta eta theta. " * 13, "Iota kappa lambda mu nu xi omicron pi rho sigma. " * 7
ADVERT, FURNITURE = '<div class="advert">Buy this, it is cheap and very good indeed for all.</div>', "<nav><a>Home</a></nav><footer>f</footer>"


@pytest.mark.parametrize(
    "page",
    [
        "<div id=text><div><p>{a}</div>{x}<div><p>{b}</div></div>",
        '<div class="post"><div class="post-content"><p>{a}</div>{x}<div class="post-content"><p>{b}</div></div>',
        "<main><article><p>{a}</article>{x}<article><p>{b}</article></main>",
    ],
    ids=["div", "post-content", "articles"],
)
def test_uneven_parts(page):
    body = f"<body>{FURNITURE}{page.format(a=LONG, b=SHORT, x=ADVERT)}</body>"
    assert html_text.main_text(body) == f"{LONG.strip()}\n\n{SHORT.strip()}"
