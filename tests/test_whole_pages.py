"""Queries that take all of a page."""

import pytest

from docloom.plans import text_queries


def brute(html):
    level, k, found = 0, 0, []
    for c in "}" + html[:400] + "}}" + html[400:] + "{":
        if c in "{}":
            if c == "}" and level == 0:
                found.append(k)
            else:
                level += 1 if c == "{" else -1
            k += 1
    return found


def test_braces_after_the_first_600_characters(spark, tmp_path):
    pages = [(1, "<p>" + "x" * 700 + "}{}}"), (2, "{{" + "y" * 60_000 + "}" * 3), (3, "short }"), (4, ""), (5, "{" * 5 + "z" * 595 + "}" * 9)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = text_queries.brace_unmatched(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, html in pages for k in brute(html))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_braces_of_the_tables(spark, folder):
    path = f"/root/testdata/{folder}"
    pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "html").collect()
    got = text_queries.brace_unmatched(spark, path).collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, html in pages for k in brute(html))
