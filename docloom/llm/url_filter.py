"""URL filters: a blocked Bloom filter passes possible hits on, an exact hash join removes its false positives.

DataFrame functions only. A rule is (action, host, path): it fits its host and every subdomain, for paths that start
with its path; of the fitting rules the one with the longest host + path wins (then the longest host). A url's
candidate keys are its host suffixes times the path lengths that occur in the rules. The filter has blocks of 64 bits
and sets three bits of one block for a key; it is probed within the row, so a url without a possible hit is never
exchanged, and of the others each distinct host and path is looked up once, however often a host repeats. What was
found is written, and joined by a broadcast if its size allows, else by a join with an exchange on both sides.

The filter is as large as the list needs; a list whose filter would be over FILTER_BYTES has none, and every key goes to
the exact join.

Defined results: a null url or one without "://" has empty host and path and gets no rule; a url that no rule fits has
a null rule and the default verdict, allow (an unlisted url passes a block list). Repeated (host, path) rules: block
wins. Repeated rows and other columns are kept as they are, whatever their names; a column with the name of an added one
is replaced. An empty rule list lets all pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import bit_table, free_name, may_hold, table, written

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules above this many bytes of keys aren't broadcast; Spark then joins by hash with a shuffle.
BROADCAST_BYTES = 8 << 20
BITS_PER_RULE = 16
FILTER_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict. rules: tuples, or a DataFrame of action, host, path.

    Repeated (host, path) rules with different actions: block wins.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    listed = (
        rules.select("action", F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"))
        .groupBy("h", "p")
        .agg(F.max("action").alias("action"))
        .select(F.concat(F.col("h"), F.lit(" "), F.col("p")).alias("key"), F.concat("h", "p").alias("rule"), "action", F.length("h").alias("h_len"), F.length("p").alias("p_len"))
    )
    facts = listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + 40).alias("bytes"), F.collect_set("p_len").alias("lengths")).first()
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if not facts["n"]:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(facts["lengths"])]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(" "), p))))
    blocks = facts["n"] * BITS_PER_RULE // 64 + 1
    bits, hits = free_name(out, "bits"), free_name(out, "hits")
    probed = out
    if 8 * blocks <= FILTER_BYTES:
        probed = probed.withColumn(bits, bit_table(listed.select(F.xxhash64("key").alias("h")), blocks))
        keys = F.filter(keys, lambda k: may_hold(F.col(bits), F.xxhash64(k), blocks))
    probed = probed.withColumn(hits, F.when(F.col("host") != "", keys)).drop(bits)
    possible = F.coalesce(F.size(hits), F.lit(0)) > 0
    asked = probed.where(possible).select("host", "path", F.explode(hits).alias("key")).distinct()
    small = facts["bytes"] <= BROADCAST_BYTES
    rule_host, rule_path, best = (free_name(out, x) for x in ("rule_host", "rule_path", "best"))
    found = (
        asked.join(F.broadcast(listed) if small else listed, "key")
        .groupBy(F.col("host").alias(rule_host), F.col("path").alias(rule_path))
        .agg(F.max(F.struct(F.length("rule").alias("n"), "h_len", "rule", "action")).alias(best))
    )
    found = written(found, "rules")
    hit = probed.where(possible).drop(hits).join(found, (F.col("host") == F.col(rule_host)) & (F.col("path") == F.col(rule_path)), "left")
    hit = hit.withColumn("rule", F.col(f"{best}.rule")).withColumn("verdict", F.coalesce(F.col(f"{best}.action"), F.lit(default))).drop(rule_host, rule_path, best)
    free = probed.where(~possible).drop(hits).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    return hit.unionByName(free)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    return ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)


ORACLE_SQL = f"""
WITH rules(action, rh, rp) AS (VALUES {_sql_rules()}),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT rid, rh || rp AS rule, action,
    row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT rid, rule, action FROM fits WHERE k = 1) USING (rid)
"""
