"""An edition in two languages: the second document with the first one's body text before its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import bilingual, repair, segment
from docloom.operators.batches import cut


def one_space(text: str) -> str:
    return " ".join(text.split())


def joined_caption(en: str, zh: str, color: str) -> str:
    en, zh = one_space(en), one_space(zh)
    if not zh:
        return en
    return f"{en} \\quad \\quad {{\\color{{{color}}}[翻译] {zh}}}" if en else f"{{\\color{{{color}}}{zh}}}"


def with_captions(first: str, second: str, merged: str, color: str = tex.COLOR) -> str:
    """merged with its captions, as far as all three have them, replaced by the first's and the second's together."""
    one, two = ([e[4] for e in repair.caption_entries(t)] for t in (first, second))
    out, at = [], 0
    for (start, end, prefix, suffix, _), en, zh in zip(repair.caption_entries(merged), one, two, strict=False):
        out += [merged[at:start], prefix, joined_caption(en, zh, color), suffix]
        at = end
    return "".join(out) + merged[at:]


def _caption_rows(color: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, ("en", "zh", "merged")):
            rows = zip(*(batch.column(n).to_pylist() for n in ("en", "zh", "merged")), strict=True)
            texts = [None if m is None else with_captions(a or "", b or "", m, color) for a, b, m in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("error")], ["doc_id", "tex", "error"])

    return run


def edition(docs: DataFrame, color: str = tex.COLOR) -> DataFrame:
    """doc_id, tex and error of docs(doc_id, en, zh).

    The second document is the frame; each transformed segment of its body is rendered with the first one's at the same
    place, captions are joined, and the preamble gets what the colour needs. A document whose numbers of segments differ,
    or without a body on one side only, has an error and no text; the others go on.
    """
    sides = {n: segment.segment(docs.select("doc_id", F.coalesce(n, F.lit("")).alias("tex")), "bilingual") for n in ("en", "zh")}
    order = Window.partitionBy("doc_id").orderBy("seq")
    number = F.sum(F.when(F.col("preserve"), 0).otherwise(1)).over(order)
    zh = sides["zh"].withColumn("n", number)
    en = sides["en"].withColumn("n", number).where("NOT preserve").select("doc_id", "n", F.col("string").alias("en_string"))
    pair = zh.join(en, ["doc_id", "n"], "left")
    strip = F.regexp_replace("string", r"(?U)\A\s+|\s+\z", "")
    text = F.when(F.col("preserve"), F.col("string")).otherwise(bilingual.rendered(F.regexp_replace("en_string", r"(?U)\s+\z", ""), strip, color))
    merged = repair.concatenated(pair.select("doc_id", "seq", text.alias("string"))).withColumnRenamed("tex", "merged")
    counts = [sides[n].groupBy("doc_id").agg(F.count_if(~F.col("preserve")).alias(f"n_{n}")) for n in ("en", "zh")]
    all_ = docs.select("doc_id", "en", "zh").join(merged, "doc_id", "left").join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left")
    error = F.when(~F.col("n_en").eqNullSafe(F.col("n_zh")), F.format_string("numbers of segments differ: %s and %s", F.coalesce("n_en", F.lit(-1)), F.coalesce("n_zh", F.lit(-1))))
    frame = all_.select("doc_id", "en", "zh", error.alias("error"), "merged").withColumn("merged", F.when(F.col("error").isNull(), F.coalesce("merged", "zh")))
    out = frame.mapInArrow(_caption_rows(color), f"doc_id {dict(docs.dtypes)['doc_id']}, tex string, error string")
    kept = bilingual.without_repeated_packages(out.where("tex IS NOT NULL")).select("doc_id", bilingual.preamble(F.col("tex"), color).alias("tex"))
    return kept.withColumn("error", F.lit(None).cast("string")).union(out.where("tex IS NULL").select("doc_id", "tex", "error"))
