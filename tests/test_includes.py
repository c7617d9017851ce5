"""Include trees: edges with cycles and long chains, and papers of several files."""

import pytest

from docloom.operators import overlay
from docloom.sources import projects


def test_flattened(spark):
    files = [
        ("p", "main.tex", "\\documentclass{a}\n% \\input{no}\nA \\input{sub/One} B \\input{two.tex}\\input{gone} \\% \\input{two}"),
        ("p", "sub/one.tex", "one % x\n\\input{two}"),
        ("p", "two.tex", "[two]"),
        ("q", "main.tex", "q \\input{a}"),
        ("q", "a.tex", "a(\\input{./b})"),
        ("q", "b.tex", "b(\\input{a}\\input{unread})"),
        ("q", "unread.tex", None),
        ("r", "other.tex", "not asked"),
        ("s", "main.tex", "x\\input{f1}"),
        *[("s", f"f{i}.tex", f"{i} \\input{{f{i + 1}}}") for i in range(1, 1500)],
        ("s", "f1500.tex", "end"),
    ]
    mains = [(p, "main.tex") for p in "pqs"] + [("t", "main.tex")]
    got = projects.flattened(spark.createDataFrame(files, "project string, path string, content string"), spark.createDataFrame(mains, "project string, path string")).collect()
    rows = {r["project"]: tuple(r)[2:] for r in got}
    gone, cycle = projects.MISSING_FILE, projects.CYCLE
    assert rows["p"] == (f"\\documentclass{{a}}\nA one \n[two] B [two]{gone} \\% [two]", ["gone"], [])
    assert rows["q"] == (f"q a(b({cycle}{gone}))", ["unread"], ["a"])
    assert rows["s"] == ("x" + "".join(f"{i} " for i in range(1, 1500)) + "end", [], [])
    assert rows["t"] == (None, ["main.tex"], [])
    assert set(rows) == set("pqst")


def test_cycles_are_flagged(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "parent long, child long")
    got = overlay.include_tree(edges, spark.createDataFrame([(1,), (5,)], "node long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 0, None), (1, 2, 1, None), (1, 3, 2, None), (1, 4, 3, None), (1, 1, 3, "cycle"), (5, 5, 0, None), (5, 5, 1, "cycle")], key=str)


@pytest.mark.parametrize(("n", "flags"), [(4, 0), (5, 1), (9, 1)])
def test_depth_is_flagged(spark, n, flags):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "parent long, child long")
    got = overlay.include_tree(edges, spark.createDataFrame([(0,)], "node long"), depth=4).collect()
    assert [r["node"] for r in got if r["flag"] == "deeper"] == [5] * flags
    assert sorted(r["node"] for r in got if r["flag"] is None) == list(range(min(n, 4) + 1))
