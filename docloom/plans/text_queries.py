"""Queries of scalar functions on LaTeX text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import overlay, repair, segment
from docloom.plans.base import query
from docloom.sources.tex_docs import TEX_SQL, tex_docs



@query(TEX_SQL + r""", a AS (SELECT doc_id, list_filter(string_split(CASE WHEN ends_with(tex, chr(10)) THEN left(tex, length(tex) - 1) ELSE tex END, chr(10)), lambda x: NOT starts_with(ltrim(x), '%')) AS l FROM tex_docs)
SELECT doc_id, replace(regexp_replace(replace(array_to_string(l, chr(10)), '\%', chr(1)), '%[^\n]*', '', 'g'), chr(1), '\%') AS bare FROM a""")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex_docs(spark, sf_dir).select("doc_id", tex.strip_comments(F.col("tex")).alias("bare"))


@query(TEX_SQL + r""", a AS (SELECT doc_id, regexp_extract(tex, '(?s)\\title\{(.*?)\}', 1) AS t, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE regexp_extract(tex, '(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}', 1) END AS b FROM tex_docs)
SELECT doc_id, t AS title, coalesce(replace(replace(replace(b, chr(10), ' '), '  ', ''), '  ', ''), 'unknown') AS abstract FROM a""")
def title_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex_docs(spark, sf_dir).select("doc_id", tex.normalized_meta(tex.title(F.col("tex"))).alias("title"), tex.normalized_meta(tex.abstract(F.col("tex"))).alias("abstract"))


@query(TEX_SQL + r""" SELECT doc_id, regexp_replace(tex, '(\\documentclass[^\n]*\n)', '\1\\usepackage{ctex}' || chr(10) || CASE WHEN contains(tex, '{url}') THEN '' ELSE '\\usepackage{url}' || chr(10) END) AS tex FROM tex_docs""")
def cjk_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex_docs(spark, sf_dir).select("doc_id", tex.cjk_preamble(F.col("tex")).alias("tex"))


@query(TEX_SQL + r""" SELECT doc_id, replace(replace(tex, '\documentclass{article}', '\documentclass[fontset=windows,UTF8]{article}'), '\documentclass[11pt]{article}', '\documentclass[11pt,fontset=windows,UTF8]{article}') AS tex FROM tex_docs""")
def documentclass_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex_docs(spark, sf_dir).select("doc_id", tex.documentclass_options(F.col("tex")).alias("tex"))


_N = "chr(10)"


@query(TEX_SQL + rf""" SELECT doc_id, CASE WHEN contains(tex, '\begin{{abstract}}') THEN tex ELSE replace(tex, '\maketitle' || {_N}, '\maketitle' || {_N} || {_N} || {_N} || {_N} || '\begin{{abstract}}' || {_N} || 'This paper has no abstract section.' || {_N} || '\end{{abstract}}' || {_N} || {_N} || {_N}) END AS tex FROM tex_docs""")
def insert_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex_docs(spark, sf_dir).select("doc_id", tex.insert_abstract(F.col("tex")).alias("tex"))


@query(r"""WITH a AS (SELECT doc_id, replace(text || ' 5% of a_b \% \section {x} \ ref{y}', '\%', chr(1)) AS r, text || ' \_ and \_' AS o FROM documents),
b AS (SELECT doc_id, o, replace(regexp_replace(regexp_replace(replace(replace(r, '%', '\%'), chr(1), '\%'), '\\([a-z]{2,10}) \{', '\\\1{', 'g'), '\\ ([a-z]{2,10})\{', '\\\1{', 'g'), '_', '\_') AS r FROM a)
SELECT doc_id, r AS repaired FROM b""")
def escape_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result, original = F.concat("text", F.lit(r" 5% of a_b \% \section {x} \ ref{y}")), F.concat("text", F.lit(r" \_ and \_"))
    return docs.select("doc_id", tex.repaired(result, original).alias("repaired"))


@query(r"""SELECT doc_id, '\cite{a,b:c} x，y \ref{' || replace(replace(text, '：', ':'), '，', ',') || ':z}' AS fixed FROM documents""")
def fullwidth_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit(r"\cite{a，b：c} x，y \ref{"), "text", F.lit("：z}"))
    return docs.select("doc_id", tex.ascii_punctuation(text).alias("fixed"))


@query("""WITH a AS (SELECT page_id, html, strpos(reverse(html), '}') AS r FROM pages),
b AS (SELECT *, length(html) - r + 1 AS k, length(regexp_extract(left(html, length(html) - r), '(?s)^.*[{}]')) AS j FROM a)
SELECT page_id, CASE WHEN r = 0 THEN replace(html, 'e', 'Z') ELSE replace(left(html, j), 'e', 'Z') || substring(html, j + 1) END AS fixed FROM b""")
def join_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with other letters whose last closing brace is lost: after the brace before it the original goes on."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    result = F.replace(F.regexp_replace("html", r"(?s)\}([^}]*)\z", "$1"), F.lit("e"), F.lit("Z"))
    return pages.select("page_id", repair.aligned(result, F.col("html")).alias("fixed"))


@query("""SELECT page_id, (length(html) - length(replace(html, '{', ''))) - (length(html) - length(replace(html, '}', ''))) AS level FROM pages""")
def brace_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tex.brace_level(F.col("html")).alias("level"))


_BRACES = "concat('}', substring(html, 1, 400), '}}', substring(html, 401), '{')"


@query(f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all({_BRACES}, '[{{}}]')) AS ch, unnest(range(len(regexp_extract_all({_BRACES}, '[{{}}]')))) AS k FROM pages),
b AS (SELECT page_id, k, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY k) AS level FROM c),
m AS (SELECT page_id, k, level, coalesce(min(level) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM b)
SELECT page_id, k::BIGINT AS brace FROM m WHERE level < least(0, low)""")
def brace_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(overlay.unmatched_braces(F.expr(_BRACES))).alias("brace")).select("page_id", F.col("brace").cast("long").alias("brace"))


# A package for each of seven kinds of documents, the last one after the first 5000 characters.
_PACKAGES = ["fontspec", "xeCJK", "xetex", "unicode-math", "xltxtra", "xunicode", "graphicx"]


@query(TEX_SQL + f""" SELECT doc_id, CASE WHEN doc_id % 8 < 6 THEN 'xelatex' ELSE 'pdflatex' END AS compiler FROM tex_docs""")
def xelatex_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of documents have a listed package, one has none, and one has it past the first 5000 characters."""
    kind = F.col("doc_id") % 8
    package = F.element_at(F.array(*[F.lit(f"\\usepackage{{{p}}}\n") for p in _PACKAGES]), (kind + 1).cast("int"))
    late = F.concat(F.repeat(F.lit("%"), 5000), F.lit("\\usepackage{fontspec}\n"), "tex")
    return tex_docs(spark, sf_dir).select("doc_id", F.when(tex.needs_xelatex(F.when(kind == 7, late).otherwise(F.concat(package, "tex"))), "xelatex").otherwise("pdflatex").alias("compiler"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))


_START = r"strpos(tex, '\section{')"


@query(TEX_SQL + rf""" SELECT doc_id, ({_START} - 1)::BIGINT AS a, (strpos(tex, '\appendix') - 1)::BIGINT AS b FROM tex_docs""")
def body_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the first section and of the first mark of the body's end after it, the text's end without one."""
    start = F.regexp_instr(F.col("tex"), F.lit(r"\\section\*?\{"))
    marks = r"\\appendix\b|\\bibliography\{|\\begin\{thebibliography\}|\\section\*\{(?i:Acknowledg?ements|Author Contributions|References)\}"
    rest = F.call_function("substring", F.col("tex"), F.col("a") + 1, F.length(F.col("tex")))
    found = tex_docs(spark, sf_dir).select("doc_id", "tex", (F.nullif(start, F.lit(0)) - 1).cast("long").alias("a"))
    end = F.nullif(F.regexp_instr(rest, F.lit(marks)), F.lit(0)) - 1 + F.col("a")
    return found.select("doc_id", "a", F.coalesce(end, F.length(F.col("tex"))).cast("long").alias("b"))


@query(TEX_SQL + r""", a AS (SELECT doc_id, regexp_extract(tex, '\\caption\{([^{]*\{[^}]*\}[^}]*)\}', 1) AS c, strpos(tex, '\caption{') - 1 AS s FROM tex_docs)
SELECT doc_id, 0::BIGINT AS idx, s::BIGINT AS start, (s + 10 + length(c))::BIGINT AS "end", '\caption{' AS prefix, '}' AS suffix, c AS caption FROM a""")
def caption_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.captions(tex_docs(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


@query(TEX_SQL + r""", l AS (SELECT doc_id, unnest(string_split(left(tex, strpos(tex, '\begin{document}') - 1), chr(10))) AS line, generate_subscripts(string_split(left(tex, strpos(tex, '\begin{document}') - 1), chr(10)), 1) AS k FROM tex_docs),
r AS (SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS n FROM l),
h AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS head FROM r WHERE n = 1 OR NOT starts_with(line, '\usepackage') GROUP BY doc_id)
SELECT doc_id, head || substring(tex, strpos(tex, '\begin{document}')) AS tex FROM h JOIN tex_docs USING (doc_id)""")
def usepackage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.bilingual import without_repeated_packages

    return without_repeated_packages(tex_docs(spark, sf_dir))
