import pytest

from docloom.llm import decontaminate, queries, url_filter

FOLDER = "/root/testdata/sf0.01"


def test_queries_against_sql(spark, same):
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, FOLDER), sql, FOLDER)


def test_urls(spark):
    rows = [(1, None), (2, "x"), (3, "http://A.COM/"), (4, "http://a.net/fr/x?y"), (5, "u://http://b.com/"), (6, "http://net/es/\n#"), (7, "http://notexample.com/en/"), (8, "http://www.example.com/en/a"), (8, "http://www.example.com/en/a"), (9, "http://m.example.com/en/")]
    df = spark.createDataFrame(rows, "page_id int, url string").selectExpr("*", "'c' AS verdict", "'d' AS key")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["key"]) for r in url_filter.filter_urls(df).fillna("-", ["rule"]).collect())
    assert got == [
        (1, "", "", "-", "allow", "d"), (2, "", "", "-", "allow", "d"), (3, "a.com", "/", "com/", "allow", "d"), (4, "a.net", "/fr/x", "net/fr/", "block", "d"),
        (5, "http:", "//b.com/", "-", "allow", "d"), (6, "net", "/es/\n", "net/es/", "block", "d"), (7, "notexample.com", "/en/", "com/", "allow", "d"),
        (8, "www.example.com", "/en/a", "www.example.com/en/", "allow", "d"), (8, "www.example.com", "/en/a", "www.example.com/en/", "allow", "d"), (9, "m.example.com", "/en/", "example.com/en/", "block", "d"),
    ]
    assert url_filter.filter_urls(df.limit(0)).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(df, spark.createDataFrame([], "action string, host string, path string")).collect()} == {"allow"}


@pytest.mark.parametrize(("name", "value"), [("BITS_PER_RULE", 0), ("FILTER_BYTES", 0), ("BROADCAST_BYTES", -1)])
def test_full_filter_no_filter_and_no_broadcast(spark, monkeypatch, name, value):
    monkeypatch.setattr(url_filter, name, value)
    rules = [("block", f"h{i}.com", "/") for i in range(300)] + [("allow", "h1.com", "/"), ("allow", "H2.com", "/"), ("allow", "h3.com", "/x")]
    pages = spark.range(600).selectExpr("id AS page_id", "concat('http://h', id, '.com/x', repeat('/y', 50000)) AS url", "1 AS hits", "2 AS bits", "3 AS best", "4 AS rule_host", "5 AS `key`", "'6' AS rule")
    found = url_filter.filter_urls(pages, rules)
    assert found.columns == ["page_id", "url", "hits", "bits", "best", "rule_host", "key", "rule", "host", "path", "verdict"]
    assert sorted(r["page_id"] for r in found.where("verdict = 'block'").select("page_id").collect()) == [0, 1, 2, *range(4, 300)]


def test_pages_without_a_hit_are_not_exchanged(spark):
    plan = queries.QUERIES["op6_url_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange hashpartitioning(host" not in plan


def test_native_plans(spark):
    for name in ("op6_url_filter", "op10_decontaminate"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_decontamination(spark):
    documents = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (3, " A b, c. D", 5), (3, "x A-B-C d zz the é", 6), (None, "q", 1), (4, "the quick, brown fox jumps over a lazy dog and then some the quick", 6), (4, "the quick, brown fox jumps over a lazy dog and then some the quick", 6)],
        "doc_id int, text string, n_words int",
    )
    benchmark = spark.createDataFrame([(1, None), (2, "a b c"), (3, "the"), (None, "q"), (4, "QUICK brown fox jumps over a lazy dog and then")], "item_id int, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["text"]) for r in decontaminate.decontaminate(documents, benchmark, "spans").fillna("-", ["text"]).collect())
    assert got == [
        ("1", 0, 0, [], "-"), ("2", 0, 0, [], ""), ("3", 4, 3, ["2"], " . D"), ("3", 8, 4, ["2", "3"], "x  d zz  é"),
        ("4", 14, 12, ["3", "4"], " some  quick"), ("4", 14, 12, ["3", "4"], " some  quick"), ("None", 1, 1, [], ""),
    ]
    assert decontaminate.decontaminate(documents, benchmark, "documents").count() == 2
    assert decontaminate.decontaminate(documents, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(documents.limit(0), benchmark).collect() == []


def test_long_documents_are_scanned_whole(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    documents = spark.createDataFrame([(1, long)], "doc_id int, text string")
    benchmark = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(59_980, 60_000)))], "item_id int, text string")
    r = decontaminate.decontaminate(documents, benchmark).first()
    assert (r["n_words"], r["n_hit"]) == (60_000, 20)


def test_names_of_every_kind(spark):
    names = ["spans", "ids", "doc", "key", "own_key", "passed", "bits", "words", "hash", "window", "__hit", "Items"]
    documents = spark.createDataFrame([(1, "x a b c")], "doc_id int, text string").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    benchmark = spark.createDataFrame([(1, "A, B, C", "t")], "item_id int, text string, hash string")
    for remove, text in ((None, "x a b c"), ("spans", "x ")):
        r = decontaminate.decontaminate(documents, benchmark, remove).first().asDict()
        assert all(r[n] == n for n in names[:-1]) and r["text"] == text and r["items"] == ["1"]


@pytest.mark.parametrize(("name", "value"), [("BROADCAST_BYTES", -1), ("FILTER_BYTES", 1500), ("BITS_PER_WINDOW", 0)])
def test_the_other_sides_of_bounds(spark, same, monkeypatch, name, value):
    """A shuffled set, a set in several parts, and bits that let all windows pass."""
    monkeypatch.setattr(decontaminate, name, value)
    folder = FOLDER if name == "BROADCAST_BYTES" else "/root/testdata/sf0.001"
    same(decontaminate.op10_decontaminate(spark, folder), decontaminate.ORACLE_SQL, folder)


@pytest.mark.parametrize("broadcast", [-1, 64 << 20])
def test_hits_of_all_parts_of_a_set(spark, monkeypatch, broadcast):
    """One part for each window: a document's hits come from any of them, and from several."""
    benchmark = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(5)] + [(5, "b0 c0 a1")], "item_id int, text string")
    documents = spark.createDataFrame([(i, f"x a{i} b{i} c{i} y") for i in range(5)] + [(5, "a0 b0 c0 a1 z a4 b4 c4"), (6, "a0 b0"), (None, "A3-b3-C3")], "doc_id int, text string")
    want = [("0", 5, 3, ["0"]), ("1", 5, 3, ["1"]), ("2", 5, 3, ["2"]), ("3", 5, 3, ["3"]), ("4", 5, 3, ["4"]), ("5", 8, 7, ["0", "4", "5"]), ("6", 2, 0, []), ("None", 3, 3, ["3"])]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    for most in (64 << 20, 24, 8):
        monkeypatch.setattr(decontaminate, "FILTER_BYTES", most)
        for run in (decontaminate.counts, decontaminate.decontaminate):
            rows = run(documents, benchmark).collect()
            assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in rows) == want
            assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)
