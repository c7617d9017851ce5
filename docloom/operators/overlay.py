"""Span overlay, runs and neighbour edits as joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Put around matches; a text that holds it is scanned twice instead.
MARK = "\x00"


def match_sizes(text: Column, pattern: str, rule: int) -> Column:
    """Of each match, leftmost and non-overlapping: rule, match, the characters before it (after the one before) and its own."""
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)  # gap, match, gap, match, ..., gap
    gaps, matches = F.filter(marked, lambda x, i: i % 2 == 0), F.filter(marked, lambda x, i: i % 2 == 1)
    holds = F.contains(text, F.lit(MARK))
    gaps, matches = F.when(holds, F.split(text, pattern, -1)).otherwise(gaps), F.when(holds, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(matches)
    sizes = F.zip_with(gaps, matches, lambda gap, size: F.struct(F.length(gap).alias("gap"), F.length(size).alias("size")))
    found = F.filter(sizes, lambda x: x["size"].isNotNull())
    return F.transform(found, lambda x, i: F.struct(F.lit(rule).alias("rule"), i.alias("match"), x["gap"].alias("gap"), x["size"].alias("size")))


def match_spans(docs: DataFrame, patterns: list[str], text: str = "tex", state: int = 0) -> DataFrame:
    """doc_id, rule, match, a, b, state of all matches, with a span (rule -1, state 1) of each whole text; offsets count characters from 0.

    The texts are scanned once; only sizes are exchanged, by doc_id, as overlay() needs them. A match starts after the
    sizes of all matches before it and of what stands between them.
    """
    t = F.col(text)
    whole = F.array(F.struct(F.lit(-1).alias("rule"), F.lit(0).alias("match"), F.lit(0).alias("gap"), F.length(t).alias("size")))
    every = docs.select("doc_id", F.explode(F.concat(whole, *[match_sizes(t, p, n) for n, p in enumerate(patterns)])).alias("m")).select("doc_id", "m.*")
    b = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "rule").orderBy("match")).cast("int")
    placed = every.repartition("doc_id").withColumn("b", b)
    return placed.select("doc_id", "rule", "match", (F.col("b") - F.col("size")).alias("a"), "b", F.when(F.col("rule") < 0, 1).otherwise(state).alias("state"))


def overlay(spans: DataFrame, rules: Sequence[int]) -> DataFrame:
    """doc_id, a, b, state: elementary intervals, each with the state that was written last.

    Spans of one rule don't overlap. One sweep over a document's points keeps, for each rule, the span that began last;
    at a point the highest rule whose span goes on has written last.
    """
    point = spans.where("b > a").select("doc_id", "rule", "b", "state", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(True).alias("begins")), F.struct(F.col("b").alias("at"), F.lit(False).alias("begins")))).alias("p")).select("*", "p.*")
    began = [F.max(F.when(F.col("begins") & (F.col("rule") == r), F.struct("b", "state"))).alias(f"r{i}") for i, r in enumerate(sorted(rules))]
    w = Window.partitionBy("doc_id").orderBy("at")
    points = point.groupBy("doc_id", "at").agg(*began)
    last = points.select("doc_id", "at", F.lead("at").over(w).alias("b"), *[F.last(f"r{i}", ignorenulls=True).over(w).alias(f"r{i}") for i in range(len(began))])
    state = F.coalesce(*[F.when(F.col(f"r{i}.b") > F.col("at"), F.col(f"r{i}.state")) for i in reversed(range(len(began)))])
    return last.where("b IS NOT NULL").select("doc_id", F.col("at").alias("a"), "b", state.alias("state")).where("state IS NOT NULL")


def runs(intervals: DataFrame) -> DataFrame:
    """doc_id, seq, a, b, state: neighbouring intervals of one state joined."""
    w = Window.partitionBy("doc_id").orderBy("a")
    new = F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(0))
    grouped = intervals.withColumn("new", new).withColumn("seq", F.sum("new").over(w))
    return grouped.groupBy("doc_id", "seq").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("state").alias("state"))


def donate_space(segments: DataFrame) -> DataFrame:
    """White space at ends of transformed segments moves to preserved neighbours."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    s, keep = F.col("string"), F.col("preserve")
    before, after = F.lag("preserve").over(w), F.lead("preserve").over(w)
    left, right = F.coalesce(before, F.lit(False)) & ~keep, F.coalesce(after, F.lit(False)) & ~keep
    lead = F.regexp_extract(s, r"(?U)\A\s*", 0)
    bare = F.regexp_replace(s, r"(?U)\A\s+", "")
    mid = F.when(left, bare).otherwise(s)
    tail = F.when(right, F.regexp_extract(mid, r"(?U)\s*\z", 0)).otherwise("")
    edited = segments.select(
        "doc_id", "seq", "preserve", "string", F.when(left, lead).otherwise("").alias("give_left"), tail.alias("give_right"),
        F.when(right, F.regexp_replace(mid, r"(?U)\s+\z", "")).otherwise(mid).alias("rest"),
    )
    got_left, got_right = F.coalesce(F.lag("give_right").over(w), F.lit("")), F.coalesce(F.lead("give_left").over(w), F.lit(""))
    return edited.select("doc_id", "seq", "preserve", F.when(keep, F.concat(got_left, "string", got_right)).otherwise(F.col("rest")).alias("string"))


def unmatched_braces(text: Column) -> Column:
    """Places (from 0) of closing braces that close nothing."""
    scan = F.aggregate(
        F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("level"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("found")),
        lambda s, x: F.when((x == "}") & (s["level"] == 0), F.struct(F.lit(0).alias("level"), (s["i"] + 1).alias("i"), F.concat(s["found"], F.array(s["i"])).alias("found"))).otherwise(
            F.struct((s["level"] + F.when(x == "{", 1).otherwise(-1)).alias("level"), (s["i"] + 1).alias("i"), s["found"].alias("found"))
        ),
    )
    return scan["found"]


def include_tree(edges: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """root, node, depth, flag: everything reached from the roots.

    A node already on the way to itself has the flag 'cycle' and one below the depth 'deeper'; neither is followed.
    """
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE reached(root, node, depth, way, flag) MAX RECURSION LEVEL {depth + 8} AS (
          SELECT node AS root, node, 0 AS depth, array(node) AS way, CAST(NULL AS STRING) AS flag FROM {{roots}}
          UNION ALL
          SELECT r.root, e.child, r.depth + 1, array_append(r.way, e.child),
            CASE WHEN array_contains(r.way, e.child) THEN 'cycle' WHEN r.depth >= {depth} THEN 'deeper' END
          FROM reached r JOIN {{edges}} e ON e.parent = r.node WHERE r.flag IS NULL)
        SELECT root, node, depth, flag FROM reached""", edges=edges, roots=roots)
