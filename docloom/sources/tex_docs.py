"""Synthetic LaTeX documents: markup around the text of `documents`, the same in Spark and in SQL.

A part is literal text, or (sql,) for an expression that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"
PARTS: list[str | tuple[str]] = [
    "\\documentclass", ("CASE WHEN doc_id % 2 = 0 THEN '[11pt]' ELSE '' END",), "{article}\n",
    "\\usepackage{graphicx}\n\\usepackage{graphicx}\n\\usepackage[x]{graphicx}\n",
    "\\title{", ("source",), " ", ("cast(doc_id AS string)",), "}\n\\begin{document}\n\\maketitle\n",
    ("CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(chr(92), 'begin{abstract}', chr(10), substring(text, 1, 300), chr(10), chr(92), 'end{abstract}', chr(10)) END",),
    "\\section{", ("lang",), "}\n", (f"replace(text, {NL}, concat({NL}, {NL}))",), "\n% trailing comment\n",
    "\\begin{equation}\nE = mc^2\n\\end{equation}\n$$x + y$$\n\\label{e", ("cast(doc_id AS string)",), "}\n",
    "\\begin{figure}\n\\caption{", (f"replace(substring(text, 1, 80), {NL}, ' ')",), " {\\bf nested} tail}\n\\end{figure}\n",
    "\\begin{itemize}\n\\item the first point of this list is here to be translated\n\\item 50% of a_b and \\% and c\\_d\n\\end{itemize}\n",
    (f"CASE WHEN doc_id % 7 = 0 THEN concat(chr(92), 'begin{{quote}}', {NL}, repeat(concat('a line of it', {NL}), 43), chr(92), 'end{{quote}}', {NL}) ELSE '' END",),
    "\\appendix\n\\bibliography{refs}\n\\end{document}\n",
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tex_column() -> Column:
    return F.concat(*[F.expr(p[0]) if isinstance(p, tuple) else F.lit(p) for p in PARTS])


def tex_sql() -> str:
    return "concat(" + ", ".join(p[0] if isinstance(p, tuple) else _quoted(p) for p in PARTS) + ")"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tex_docs(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """doc_id, source, lang, text and tex. plain: dollar signs of the texts, which could start a formula, are spelled out."""
    docs = documents(spark, sf_dir)
    if plain:
        docs = docs.withColumn("text", F.replace("text", F.lit("$"), F.lit("USD")))
    return docs.select("doc_id", "source", "lang", "text", tex_column().alias("tex"))


#: The head of SQL that reads tex_docs.
TEX_SQL = f"WITH tex_docs AS (SELECT doc_id, source, lang, text, {tex_sql()} AS tex FROM documents)"
PLAIN_TEX_SQL = TEX_SQL.replace("FROM documents", "FROM (SELECT * REPLACE (replace(text, '$', 'USD') AS text) FROM documents)")
