"""What an article holds stays."""

import pytest
from test_html_text import LONG

from docloom.llm import html_text

LINKS = "<li><a href=1>First reference</a></li><li><a href=2>Second reference</a></li>"
BOTH = "First reference\nSecond reference"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG}</p><ul>{LINKS}</ul></article>", f"{LONG}\n{BOTH}"),
        (f"<main><p>{LONG}</p><section><h2>Reading</h2><ol>{LINKS}</ol></section></main>", f"{LONG}\nReading\n{BOTH}"),
        (f"<article><h2 id='related-work'>Related work</h2><p class='notice'>{LONG}</p><h3 id=search>Search</h3></article>", f"Related work\n{LONG}\nSearch"),
        (f"<article><p>{LONG}</p><div class='related'><p>{LONG}</p></div><p hidden>no</p><nav>no</nav></article>", LONG),
        (f"<body><p class=notice>{LONG}</p><div><p>{LONG}</p><ul>{LINKS}</ul></div></body>", LONG),
    ],
)
def test_articles(page, want):
    assert html_text.main_text(page) == want
