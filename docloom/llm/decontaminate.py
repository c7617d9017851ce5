"""Benchmark decontamination with DataFrame functions only.

Every window of ten words of a benchmark item is an element of a hash set, keyed by a 64-bit hash of its words. A scan
hashes all windows of a document from its words' hashes, by doubling (two words, four, eight, then ten), and probes a
table of bits within the row. Only windows that pass become rows, with their words; they join the set of windows by
hash, and the words are compared. The scan reads the texts once and exchanges nothing; the set is broadcast up to
BROADCAST_BYTES, and beyond it joined by an exchange of the windows that passed. A set whose bits would take more than
FILTER_BYTES is dealt by hash, and the texts are scanned once for each part.

Defined results: null text has no words; items and documents without words have no windows; an item of fewer than ten
words is one window; an item whose id is null can hit but is not listed. Repeated rows give one row each.
Documents keep their other columns, whatever their names; a column with the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import bit_table, free_name, may_hold, table, written

WORDS_PER_WINDOW = 10
#: Windows beyond this many bytes aren't broadcast; the join then is a shuffled one.
BROADCAST_BYTES = 64 << 20
BITS_PER_WINDOW = 64
FILTER_BYTES = 64 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is named: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(words: Column, length: int) -> Column:
    """The hash of every run of so many words, in order; an empty array if there are fewer.

    Hashes of one word make those of two, these those of four and so on; runs of other lengths are put together from these.
    """

    def later(hashes: Column, shift: int) -> Column:
        return F.slice(hashes, F.lit(shift + 1), F.size(hashes))

    def joined(first: Column, second: Column, shift: int) -> Column:  # the last ones, which have no second, are cut at the end
        return F.zip_with(first, later(second, shift), lambda a, b: F.xxhash64(a, b))

    def step(spans: dict[int, Column]) -> Column:
        width = max(spans)
        if 2 * width <= length:
            return bound(joined(spans[width], spans[width], width), lambda x: step(spans | {2 * width: x}))
        out, have = spans[width], width
        for part in sorted(spans, reverse=True)[1:]:
            if have + part <= length:
                out, have = joined(out, spans[part], have), have + part
        return F.slice(out, F.lit(1), F.greatest(F.size(spans[1]) - (length - 1), F.lit(0)))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda x: step({1: x}))


def windows_of(benchmark: DataFrame) -> DataFrame:
    """hash, length, window, items: one row for each distinct window."""
    n = F.size("words")
    hashes = F.when(n >= WORDS_PER_WINDOW, window_hashes(F.col("words"), WORDS_PER_WINDOW))
    for k in range(1, WORDS_PER_WINDOW):
        hashes = F.when(n == k, window_hashes(F.col("words"), k)).otherwise(hashes)
    part = lambda h, i: F.struct(h.alias("hash"), F.array_join(F.slice("words", i + 1, WORDS_PER_WINDOW), " ").alias("window"))
    return (
        benchmark.select("item_id", words_of(F.col("text")).alias("words"))
        .select("item_id", F.least(n, F.lit(WORDS_PER_WINDOW)).alias("length"), F.explode(F.transform(hashes, part)).alias("part"))
        .groupBy("part.hash", "length", "part.window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def text_key(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def scan(documents: DataFrame, windows: DataFrame, lengths: list[int], n_windows: int) -> DataFrame:
    """doc_id, text_key, n_words and passed (start, length, hash and words of the windows that may be in the set) of every document."""
    blocks = n_windows * BITS_PER_WINDOW // 64 + 1

    def passed(words: Column, bits: Column, n: int) -> Column:
        may = F.transform(window_hashes(words, n), lambda h, i: F.when(may_hold(bits, h, blocks), F.struct(i.alias("start"), F.lit(n).alias("length"), h.alias("hash"))))
        return F.transform(F.filter(may, lambda x: x.isNotNull()), lambda x: x.withField("part", F.array_join(F.slice(words, x["start"] + 1, x["length"]), " ")))

    def seen(words: Column) -> Column:
        every = bound(F.col("bits"), lambda bits: F.concat(*[passed(words, bits, n) for n in lengths]))
        return F.struct(F.size(words).cast("long").alias("n_words"), every.alias("passed"))

    # One select names the table once, so that Spark takes it in: as a column it would be copied into every row.
    table_ = bit_table(windows.select(F.col("hash").alias("h")), blocks)
    rows = documents.select("doc_id", "text", table_.alias("bits")).select("doc_id", text_key(F.col("text")).alias("text_key"), bound(words_of(F.col("text")), seen).alias("seen"))
    return rows.select("doc_id", "text_key", "seen.n_words", "seen.passed")


def scanned_and_found(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key and n_words of every document; and doc_id, text_key, spans (start, length) and items of those with windows of the set."""
    windows = written(windows_of(benchmark), "windows")
    sizes = F.octet_length("window") + F.aggregate("items", F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    facts = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(sizes), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    parts = max(1, -(-facts["n"] * BITS_PER_WINDOW // (8 * FILTER_BYTES)))
    lengths, share = sorted(facts["lengths"]) or [WORDS_PER_WINDOW], -(-facts["n"] // parts)
    scans = [written(scan(documents, windows.where(F.pmod("hash", F.lit(parts)) == k), lengths, share), "scan") for k in range(parts)]
    passed = reduce(DataFrame.union, [x.select("doc_id", "text_key", F.explode("passed").alias("p")).select("doc_id", "text_key", "p.*") for x in scans])
    table_ = F.broadcast(windows) if facts["bytes"] <= BROADCAST_BYTES else windows
    hits = passed.join(table_.withColumnRenamed("length", "long"), "hash").where((F.col("part") == F.col("window")) & (F.col("length") == F.col("long"))).select("doc_id", "text_key", "start", "length", "items")
    found = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # A scan knows only what passed its own part; what every scan has of a document is the same otherwise.
    return scans[0].drop("passed"), written(found, "found")


def covered(spans: Column) -> Column:
    """The number of words in any of the spans, which come by their starts."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["start"] + x["length"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["start"] + x["length"]).alias("end"))
    return F.coalesce(F.aggregate(spans, start, step)["n"], F.lit(0)).cast("long")


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str | None = None) -> DataFrame:
    """documents with n_words, n_hit, items (sorted ids), contaminated and hit_words (places of hit words).

    remove: None keeps all texts; "documents" drops contaminated documents; "spans" cuts the hit words from their texts.
    """
    _, found = scanned_and_found(documents, benchmark)
    rest = documents.drop("n_words", "n_hit", "items", "contaminated", "hit_words")
    doc, key, spans, items, own = (free_name(rest, x) for x in ("doc", "key", "spans", "ids", "own_key"))
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(spans), F.col("items").alias(items))
    # What was found is small next to the texts: Spark broadcasts it by its size, and else exchanges both sides.
    joined = rest.withColumn(own, text_key(F.col("text"))).join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    out = (
        joined.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))
        .withColumn("n_hit", covered(F.col(spans)))
        .withColumn("items", F.coalesce(items, F.array().cast("array<string>")))
        .withColumn("contaminated", F.col(spans).isNotNull())
        .withColumn("hit_words", F.coalesce(places, F.array().cast("array<int>")))
        .drop(doc, key, spans, *([items] if items != "items" else []), own)
    )
    if remove == "documents":
        return out.where(~F.col("contaminated"))
    if remove == "spans":
        return out.withColumn("text", F.when(F.col("contaminated"), without_words(F.col("text"), F.col("hit_words"))).otherwise(F.col("text")))
    return out


def without_words(text: Column, hit: Column) -> Column:
    """The text without the words at these places and what stands between neighbours of them."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps = F.split(text, word)
    # Arrays go into the lambdas as elements: what a lambda names from outside is computed for every word.
    marked = F.transform(
        F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w, i: F.struct(w.alias("w"), F.array_contains(hit, i).alias("gone"), F.array_contains(hit, i + 1).alias("next_gone"))
    )
    pieces = F.zip_with(
        marked, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))),
        lambda x, gap: F.concat(F.when(x["gone"], "").otherwise(x["w"]), F.when(x["gone"] & x["next_gone"], "").otherwise(gap)),
    )
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))


def counts(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated of every document, from the scan alone."""
    seen, found = scanned_and_found(documents, benchmark)
    found = found.select(F.col("doc_id").alias("doc"), F.col("text_key").alias("key"), "spans", "items")
    every = seen.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key")), "left")
    return every.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM item WHERE len(ws) > 0)),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
spot AS (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM doc WHERE len(ws) > 0),
hit AS (
  SELECT rid, i, n, item_id FROM (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM spot, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(ws))
  JOIN win USING (n, w)),
word AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (rid) LEFT JOIN ids USING (rid)
"""
