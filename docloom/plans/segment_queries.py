"""Queries of the segmenter: spans, overlay, runs, neighbour edits."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import chat, overlay, repair, segment
from docloom.plans import segment_sql
from docloom.plans.base import query
from docloom.sources.tex_docs import TEX_SQL, tex_docs

# The rules that need no recursion or brace counting, in Java's and in RE2's dialect alike.
RULES = [
    r"(?s)\A(.*?)\\maketitle", r"(?s)\A(.*?)\\begin\{document\}", r"(?s)\$\$[^$]+\$\$|\\\[.*?\\\]",
    r"\\(?:section\*?|subsection|subsubsection)\{[^}\n]*\}", r"\\(?:bibliography|bibliographystyle)\{[^}\n]*\}",
    r"\\(?:clearpage|newpage|appendix|tableofcontents|include\{[^}\n]*\})", r"\\(?:(?:vspace|hspace|label|begin|end)\{[^}\n]*\}|item )",
]


def _cover(docs: DataFrame) -> DataFrame:
    return overlay.overlay(overlay.match_spans(docs, RULES), range(-1, len(RULES)))


def _runs(docs: DataFrame) -> DataFrame:
    return overlay.runs(_cover(docs))


# The same by characters: each takes the state of the last rule that covers it. Positions come from the lengths of what
# lies between matches.
_SPANS = ["SELECT doc_id, -1 AS rule, 0::BIGINT AS match, 0::BIGINT AS a, length(tex)::BIGINT AS b, 1 AS state FROM tex_docs"]
for _number, _pattern in enumerate(RULES):
    _SPANS.append(f"""SELECT doc_id, {_number}, i::BIGINT, (list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0))::BIGINT AS a,
  (list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + list_sum(list_transform(ms[1:i + 1], lambda x: length(x))))::BIGINT, 0
  FROM (SELECT doc_id, string_split_regex(tex, '{_pattern}') AS gaps, regexp_extract_all(tex, '{_pattern}') AS ms, unnest(generate_series(0, len(regexp_extract_all(tex, '{_pattern}')) - 1)) AS i FROM tex_docs)""")
_RUNS_SQL = TEX_SQL + ", spans AS (" + " UNION ALL ".join(_SPANS) + """),
points AS (SELECT DISTINCT doc_id, unnest([a, b]) AS a FROM spans),
cuts AS (SELECT * FROM (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM points) WHERE b IS NOT NULL),
cover AS (SELECT c.doc_id, c.a, c.b, arg_max(s.state, s.rule * 1000000 + s.match) AS state FROM cuts c JOIN spans s ON s.doc_id = c.doc_id AND s.a <= c.a AND s.b >= c.b GROUP BY ALL),
flagged AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY doc_id ORDER BY a) <> state THEN 1 ELSE 0 END AS fresh FROM cover),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS seq FROM flagged),
runs AS (SELECT doc_id, seq::BIGINT AS seq, min(a) AS a, max(b) AS b, first(state) AS state FROM numbered GROUP BY doc_id, seq),
parts AS (SELECT doc_id, seq, state, substring(tex, a + 1, b - a) AS s FROM runs JOIN tex_docs USING (doc_id)),
kept AS (SELECT doc_id, seq, s, state = 0 OR length(trim(s, chr(10))) < 42 AS preserve FROM parts)"""


@query(_RUNS_SQL + " SELECT doc_id, seq, a, b, state::BIGINT AS state FROM runs")
def runs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(tex_docs(spark, sf_dir)).select("doc_id", "seq", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("state").cast("long").alias("state"))


@query(_RUNS_SQL + " SELECT doc_id, sum(CASE WHEN state = 0 THEN b - a ELSE 0 END)::BIGINT AS preserved, sum(CASE WHEN state = 1 THEN b - a ELSE 0 END)::BIGINT AS transformed FROM cover GROUP BY doc_id")
def span_overlay_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = _cover(tex_docs(spark, sf_dir))
    size = F.col("b") - F.col("a")
    return cover.groupBy("doc_id").agg(F.sum(F.when(F.col("state") == 0, size).otherwise(0)).alias("preserved"), F.sum(F.when(F.col("state") == 1, size).otherwise(0)).alias("transformed"))


@query(_RUNS_SQL + " SELECT doc_id, count(*) FILTER (preserve) AS preserved, count(*) FILTER (NOT preserve) AS transformed, sum(CASE WHEN preserve THEN 0 WHEN length(s) < 1024 THEN 1 ELSE (length(s) + 1023) // 1024 END)::BIGINT AS chunks FROM kept GROUP BY doc_id")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments each document has, and how many chunks it would cost."""
    docs = tex_docs(spark, sf_dir)
    string = F.call_function("substring", F.col("tex"), F.col("a") + 1, F.col("b") - F.col("a"))
    parts = _runs(docs).join(docs.select("doc_id", "tex"), "doc_id").select("doc_id", "state", string.alias("s"))
    preserve = (F.col("state") == 0) | (F.length(F.trim("s", F.lit("\n"))) < 42)
    n = F.when(preserve, 0).when(F.length("s") < 1024, 1).otherwise(F.ceil(F.length("s") / 1024))
    return parts.groupBy("doc_id").agg(F.count_if(preserve).alias("preserved"), F.count_if(~preserve).alias("transformed"), F.sum(n.cast("long")).alias("chunks"))


@query(segment_sql.MAIN + segment_sql.ROWS)
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(tex_docs(spark, sf_dir, plain=True))


@query(segment_sql.BILINGUAL + segment_sql.ROWS)
def bilingual_segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(tex_docs(spark, sf_dir, plain=True), "bilingual")


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with white space at their ends, every second one preserved."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "s"))
    return line.select("doc_id", F.col("seq").cast("long").alias("seq"), (F.col("seq") % 2 == 0).alias("preserve"), F.concat(F.lit("  "), F.trim("s"), F.lit(" \n")).alias("string"))


_THREE = """WITH l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS seq, unnest(string_split(text, chr(10))) AS s FROM documents),
p AS (SELECT doc_id, seq, seq % 2 = 0 AS preserve, '  ' || trim(s) || ' ' || chr(10) AS string FROM l)"""


@query(_THREE + r""", e AS (SELECT *, coalesce(lag(preserve) OVER w, false) AND NOT preserve AS lft, coalesce(lead(preserve) OVER w, false) AND NOT preserve AS rgt FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
f AS (SELECT *, CASE WHEN lft THEN regexp_extract(string, '^\s*') ELSE '' END AS gl, CASE WHEN lft THEN regexp_replace(string, '^\s+', '') ELSE string END AS mid FROM e),
g AS (SELECT *, CASE WHEN rgt THEN regexp_extract(mid, '\s*$') ELSE '' END AS gr, CASE WHEN rgt THEN regexp_replace(mid, '\s+$', '') ELSE mid END AS rest FROM f)
SELECT doc_id, seq, preserve, CASE WHEN preserve THEN coalesce(lag(gr) OVER w, '') || string || coalesce(lead(gl) OVER w, '') ELSE rest END AS string FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
def whitespace_donation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.donate_space(_three(spark, sf_dir))


@query(_THREE + """, n AS (SELECT *, 1 AS lines FROM p)
SELECT doc_id, seq, (coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 2)::BIGINT AS line_from, (sum(lines) OVER (PARTITION BY doc_id ORDER BY seq) + 2)::BIGINT AS line_to FROM n""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seq")
    n = tex.occurrences(F.col("string"), "\n")
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _three(spark, sf_dir).select("doc_id", "seq", (before - 2).alias("line_from"), (F.sum(n).over(w) + 2).alias("line_to"))


_LINES = """WITH s AS (SELECT doc_id, 0 AS seg_idx, text AS string FROM documents),
c AS (SELECT doc_id, seg_idx, string, unnest(CASE WHEN length(string) < 1024 THEN [0] ELSE generate_series(0, length(string) - 1, 1024) END) AS spot FROM s),
d AS (SELECT doc_id, seg_idx::BIGINT AS seg_idx, (spot // 1024)::BIGINT AS chunk_idx, CASE WHEN length(string) < 1024 THEN 'segment-0' ELSE 'segment-0.part-' || (spot // 1024) || '.tex' END AS tag, substring(string, spot + 1, 1024) AS content FROM c)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(0).cast("long").alias("seg_idx"), F.col("text").alias("string"))
    return chat.chunks(docs).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query(_LINES + " SELECT * FROM d")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(_LINES + " SELECT doc_id, seg_idx, string_agg(replace(content, 'e', 'Z'), '' ORDER BY chunk_idx) AS string FROM d GROUP BY doc_id, seg_idx")
def chunk_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.regroup(_chunks(spark, sf_dir).withColumn("response", F.replace("content", F.lit("e"), F.lit("Z"))), "response")


@query(_LINES + " SELECT doc_id, chunk_idx, '" + (chat.PROMPTS["translate_zh"][0].replace("{more}", "MORE ")) + "' || content AS prompt, '" + chat.PROMPTS["translate_zh"][1] + "' AS sys_prompt FROM d")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prompts(_chunks(spark, sf_dir), "translate_zh", "MORE ").select("doc_id", "chunk_idx", "prompt", "sys_prompt")


@query("""SELECT doc_id, 'm.tex:' || (doc_id % 90 + 1) || ': error' || chr(10) || 'm.tex:' || (doc_id % 50 + 7) || ': e' AS log, least(doc_id % 90 + 1, doc_id % 50 + 7)::BIGINT - 1 AS line FROM documents""")
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log = F.expr("concat('m.tex:', doc_id % 90 + 1, ': error', chr(10), 'm.tex:', doc_id % 50 + 7, ': e')")
    return docs.select("doc_id", log.alias("log")).select("doc_id", "log", repair.error_line(F.col("log")).cast("long").alias("line"))


@query(segment_sql.MAIN + """, done AS (SELECT doc_id, seq, string, NOT preserve AND doc_id % 90 BETWEEN line - 10 AND line + ends_ + 10 AS back, preserve FROM placed)
SELECT doc_id, string_agg(CASE WHEN preserve OR back THEN string ELSE replace(string, 'e', 'Z') END, '' ORDER BY seq) AS tex, count(*) FILTER (back) AS reverted FROM done GROUP BY doc_id""")
def error_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Translations' with other letters, reverted within ten lines of one error line."""
    found = segment.segment(tex_docs(spark, sf_dir, plain=True))
    return repair.reassemble(found.withColumn("result", F.replace("string", F.lit("e"), F.lit("Z"))).withColumn("errors", F.array((F.col("doc_id") % 90).cast("int"))), 10)


@query(_RUNS_SQL + """ SELECT doc_id, string_agg('<p style="color:' || CASE state WHEN 0 THEN 'red">' || replace(s, chr(10), '<br/>') ELSE 'black">#' || replace(s, chr(10), '<br/>') || '#' END || '</p>', '' ORDER BY seq) AS html FROM parts GROUP BY doc_id""")
def debug_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tex_docs(spark, sf_dir)
    string = F.replace(F.call_function("substring", F.col("tex"), F.col("a") + 1, F.col("b") - F.col("a")), F.lit("\n"), F.lit("<br/>"))
    node = F.concat(F.lit('<p style="color:'), F.when(F.col("state") == 0, F.concat(F.lit('red">'), string)).otherwise(F.concat(F.lit('black">#'), string, F.lit("#"))), F.lit("</p>"))
    return repair.concatenated(_runs(docs).join(docs.select("doc_id", "tex"), "doc_id").select("doc_id", "seq", node.alias("string"))).withColumnRenamed("tex", "html")
