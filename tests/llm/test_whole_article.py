"""Main text of articles whose parts are very unequal."""

import pytest

from tickframe.llm import html_text

LONG = "many words of running text that go on and on " * 30


@pytest.mark.parametrize(
    "page, lines",
    [
        (f"<nav>n</nav><article><h1>Title</h1><p>lead</p><div class='body'><p>{LONG}</p></div></article><footer>f</footer>", ["Title", "lead", LONG.strip()]),
        (f"<body><article><section><p>{LONG}</p></section><section><p>short one</p></section></article><div>beside</div></body>", [LONG.strip(), "short one"]),
        (f"<main><h1>Title</h1><div><p>{LONG}</p></div></main>", ["Title", LONG.strip()]),
        ("<body><p>a</p><p>b</p><div>" + f"<p>{LONG}</p>" * 30 + "</div><div>" + f"<p>{LONG}</p>" * 2 + "</div></body>", ["a", "b"] + [LONG.strip()] * 32),
    ],
)
def test_nothing_of_the_article_is_lost(page, lines):
    assert html_text.extract(page) == "\n".join(lines)
