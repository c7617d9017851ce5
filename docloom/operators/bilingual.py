"""Bilingual editions: positional joins of two segmentations and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import tex


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """doc_id, n, en, zh, error: transformed segments by position; where one side has none at a place, an error says so."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    number = lambda d, name: d.where("NOT preserve").select("doc_id", F.row_number().over(order).alias("n"), F.col("string").alias(name))
    both = number(first, "en").join(number(second, "zh"), ["doc_id", "n"], "full")
    return both.withColumn("error", F.when(F.col("en").isNull() | F.col("zh").isNull(), "numbers of segments differ"))


def rendered(en: Column, zh: Column, color: str = tex.COLOR) -> Column:
    """Paragraph by paragraph if both have the same number of plain paragraphs, else one after the other."""
    begin, end = F.lit(f"\\begingroup\\color{{{color}}}"), F.lit("\\par\\endgroup")
    strip = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    a, b = tex.paragraphs(en), tex.paragraphs(zh)
    each = F.flatten(F.zip_with(a, b, lambda x, y: F.when(tex.is_command_only(x), F.array(x, y, F.lit(""))).otherwise(F.array(x, F.lit(""), begin, y, end, F.lit("")))))
    whole = F.array(F.regexp_replace(en, r"(?U)\s+\z", ""))
    whole = F.when(strip(zh) != "", F.concat(whole, F.array(F.lit(""), begin, strip(zh), end, F.lit("")))).otherwise(whole)
    split = (F.size(a) == F.size(b)) & (F.size(a) > 1) & tex.can_split(en) & tex.can_split(zh)
    return F.concat(strip(F.array_join(F.when(split, each).otherwise(whole), "\n\n")), F.lit("\n\n"))


def without_repeated_packages(docs: DataFrame, text: str = "tex") -> DataFrame:
    """doc_id and tex: a \\usepackage line of the preamble that an earlier one equals goes; texts without a body stay."""
    at = F.locate("\\begin{document}", F.col(text))
    head, body = F.call_function("substring", F.col(text), F.lit(1), at - 1), F.call_function("substring", F.col(text), at, F.length(text))
    rows = F.split(head, "\n")
    strip = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    package = lambda x: F.startswith(strip(x), F.lit("\\usepackage"))
    names = F.transform(rows, strip)
    kept = F.filter(rows, lambda x, i: ~package(x) | ~F.array_contains(F.slice(names, F.lit(1), i), strip(x)))
    return docs.select("doc_id", F.when(at > 0, F.concat(F.array_join(kept, "\n"), body)).otherwise(F.col(text)).alias("tex"))


def preamble(text: Column, color: str = tex.COLOR) -> Column:
    """xcolor after the documentclass and the colour before the body, where they are missing."""
    package = F.when(F.contains(text, F.lit("{xcolor}")), text).otherwise(tex.after_documentclass(text, F.lit("\\usepackage{xcolor}\n")))
    define = F.lit(f"\\definecolor{{{color}}}{{RGB}}{{128,128,128}}\n")
    at = F.locate("\\begin{document}", package)
    put = F.when(at > 0, F.concat(F.call_function("substring", package, F.lit(1), at - 1), define, F.call_function("substring", package, at, F.length(package)))).otherwise(F.concat(package, F.lit("\n"), define))
    return F.when(F.contains(text, F.lit(f"\\definecolor{{{color}}}")), text).otherwise(put)
