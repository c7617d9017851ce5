import html
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import html_text

LONG = "This is a long paragraph of the article, with commas, and enough words to earn points for its container."


def test_all_pages_against_the_generator(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
        (f"<body><div class=sidebar><p>{LONG}</p></div><div id=content><p>{LONG}</p><p>Short.</p></div><div class='comments'><p>{LONG}</p></div></body>", f"{LONG}\nShort."),
        (f"<div role=navigation>{LONG}</div><main><h2>Head</h2><form>{LONG}</form><p>a&nbsp; b<br>c &#233;&lt;</p><script>x = '<p>'</script></main>", "Head\na b c é<"),
        (f"<article><p>{LONG}<p>two</article><footer>f</footer>", f"{LONG}\ntwo"),
        (f"<div><ul><li><a href=1>one link</a></li><li><a href=2>two links</a></li></ul><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<div><p>{LONG}</p><!-- a <p>comment", LONG),
        (f"</div></p><td>{LONG}</td>", LONG),
        ("<p>" * 3000 + "x" + "<div>" * 3000, "x"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_rows(spark):
    rows = [(1, None, None), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    assert sorted(map(str, (tuple(r) for r in html_text.extract(df).collect()))) == sorted(map(str, [(1, None, "", 0), (2, "u", "x", 1), (2, "u", "x", 1), (None, "v", "", 0)]))
    assert html_text.extract(df.limit(0)).collect() == []
