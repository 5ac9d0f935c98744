"""Main text of pages whose elements and names mislead or say nothing, so that the ratios decide."""

import pytest

from tickframe.llm import html_text

LONG = "many words of running text that go on and on " * 12
BODY = f"<h1>A title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
TEXT = f"A title\n{LONG.strip()}\nShort one.\n{LONG.strip()}"
MENU = "".join(f'<a href="/{i}"><span>Item {i}</span></a><br>' for i in range(3)) + "".join(f'<div><a href="/{i}">Part {i}</a></div>' for i in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f'<nav>menu</nav><div class="content-with-sidebar"><article>{BODY}</article></div><footer>f</footer>',
        f'<nav>menu</nav><div class="layout-right-sidebar">{BODY}</div><footer>f</footer>',
        f'<body><div class="search"><article>{BODY}</article></div></body>',
        f'<body><nav>menu</nav><article class="post social">{BODY}</article></body>',
        f"<body><form><nav>menu</nav><div>{BODY}</div><select><option>a</select><footer>f</footer></form></body>",
        f'<body><article>{BODY}<div class="comments"><p>{LONG * 20}</p></div></article></body>',
        f'<body><div>{BODY}<div id="commentList"><p>{LONG}</p></div><div class="cookieBanner">ok</div></div></body>',
        f'<body><div class="sidebar"><p>{LONG}</p></div><div>{BODY}</div></body>',
    ],
)
def test_hints_that_hold_the_content_are_overruled(page):
    assert html_text.extract(page) == TEXT


UNNAMED = [
    f"<body><div>{MENU}</div><div>{BODY}</div><div>All rights reserved.</div></body>",
    f"<body><table><tr><td>{MENU}</td><td><div>{BODY}</div></td></tr></table><p>The end</p></body>",
    f"<body><div><div>{MENU}</div><div>{BODY}</div></div><div>Buy this now.</div></body>",
]


@pytest.mark.parametrize("page", UNNAMED)
def test_ratios_find_content_without_telling_names(page):
    assert html_text.extract(page) == TEXT


def test_ratios_decide(monkeypatch):
    monkeypatch.setattr(html_text, "smooth", lambda values: values * 0 + 1)
    monkeypatch.setattr(html_text, "content_lines", lambda lines: [True] * len(lines))
    assert all(html_text.extract(page) != TEXT for page in UNNAMED)


def test_inline_boilerplate_and_deep_nesting():
    page = f'<article><p>Text <button>Press</button>goes <span class="share">share</span>on.</p><p>{LONG}</p></article>'
    assert html_text.extract(page) == f"Text goes on.\n{LONG.strip()}"
    deep = "<div>line " * 20_000
    assert html_text.extract(deep) == "\n".join(["line"] * 20_000)
    assert html_text.extract('<div class="sidebar">x' * 3000 + f"<p>{LONG}") .endswith(LONG.strip())
    assert len(html_text.extract("<" * 20_000 + f"<p>{LONG}</p>")) > 0


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_pages(none, keep=("url",)).collect() == []
