"""Queries of bilingual editions."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import bilingual, repair, segment
from docloom.plans import segment_sql
from docloom.plans.base import query
from docloom.sources.tex_docs import TEX_SQL, documents, tex_docs


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("en"), F.replace(F.concat(F.lit("Z"), F.replace("text", F.lit("\n"), F.lit("\n\nZ"))), F.lit("e"), F.lit("Z")).alias("zh"))


_PARTS = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS p, list_transform(p, lambda x: 'Z' || x) AS z FROM documents)"""


@query(_PARTS + " SELECT doc_id, unnest(generate_series(1, len(p)))::BIGINT AS n, unnest(p) AS en, replace(unnest(z), 'e', 'Z') AS zh FROM s")
def paragraph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _sides(spark, sf_dir).select("doc_id", F.arrays_zip(tex.paragraphs(F.col("en")).alias("en"), tex.paragraphs(F.col("zh")).alias("zh")).alias("p"))
    return both.select("doc_id", F.posexplode("p").alias("n", "x")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "x.en", "x.zh")


_OPEN, _CLOSE = r"'\begingroup\color{bilingualzhcolor}'", r"'\par\endgroup'"


@query(segment_sql.BILINGUAL + rf""", t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n, string AS en, replace(string, 'e', 'Z') AS zh FROM segments WHERE NOT preserve),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(en, '\n\s*\n+'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS parts FROM t)
SELECT doc_id, n::INT AS n, en, zh, CASE WHEN len(parts) > 1
  THEN array_to_string(list_transform(parts, lambda x: x || repeat(chr(10), 4) || {_OPEN} || chr(10) || chr(10) || replace(x, 'e', 'Z') || chr(10) || chr(10) || {_CLOSE}), repeat(chr(10), 4)) || chr(10) || chr(10)
  ELSE rtrim(en, ' ' || chr(10)) || repeat(chr(10), 4) || {_OPEN} || chr(10) || chr(10) || trim(zh, ' ' || chr(10)) || chr(10) || chr(10) || {_CLOSE} || chr(10) || chr(10) END AS rendered FROM p""")
def bilingual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the body of a document and of its other side, which has the same structure, rendered in pairs."""
    found = segment.segment(tex_docs(spark, sf_dir, plain=True), "bilingual")
    other = found.withColumn("string", F.when(F.col("preserve"), F.col("string")).otherwise(F.replace("string", F.lit("e"), F.lit("Z"))))
    return bilingual.paired(found, other).drop("error").withColumn("rendered", bilingual.rendered(F.col("en"), F.col("zh")))


@query(TEX_SQL + r""", a AS (SELECT doc_id, trim(regexp_replace(regexp_extract(tex, '\\caption\{([^{]*\{[^}]*\}[^}]*)\}', 1), '\s+', ' ', 'g')) AS c FROM tex_docs)
SELECT doc_id, 0::BIGINT AS idx, '\caption{' || c || ' \quad \quad {\color{bilingualzhcolor}[翻译] ' || replace(c, 'e', 'Z') || '}}' AS merged FROM a""")
def captions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of both sides by position, joined into the command's text."""
    one = repair.captions(tex_docs(spark, sf_dir))
    two = one.select("doc_id", "idx", F.replace("caption", F.lit("e"), F.lit("Z")).alias("zh"))
    text = tex.caption(tex.one_space(F.col("caption")), tex.one_space(F.col("zh")))
    return one.join(two, ["doc_id", "idx"]).select("doc_id", F.col("idx").cast("long").alias("idx"), F.concat("prefix", text, "suffix").alias("merged"))


@query(TEX_SQL + r""", a AS (SELECT doc_id, replace(tex, '\usepackage{graphicx}' || chr(10) || '\usepackage{graphicx}', '\usepackage{graphicx}') AS t FROM tex_docs),
b AS (SELECT doc_id, regexp_replace(t, '(\\documentclass[^\n]*\n)', '\1\\usepackage{xcolor}' || chr(10)) AS t FROM a)
SELECT doc_id, replace(t, '\begin{document}', '\definecolor{bilingualzhcolor}{RGB}{128,128,128}' || chr(10) || '\begin{document}') AS tex FROM b""")
def bilingual_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilingual.without_repeated_packages(tex_docs(spark, sf_dir)).select("doc_id", bilingual.preamble(F.col("tex")).alias("tex"))
