"""Queries of sources: paper ids, caches, projects, settings, include trees."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import overlay
from docloom.plans.base import query
from docloom.sources import projects
from docloom.sources.tex_docs import TEX_SQL, documents, tex_docs

_ID = "CASE doc_id % 4 WHEN 0 THEN printf('%04d.%05d', 1801 + doc_id % 5, doc_id) WHEN 1 THEN printf('https://arxiv.org/pdf/%04d.%05dv2', 1801, doc_id) WHEN 2 THEN '/tmp/' || doc_id ELSE 'https://arxiv.org/list/' || doc_id END"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://arxiv.org/abs/' || printf('%04d.%05d', 1801 + doc_id % 5, doc_id) WHEN 1 THEN 'https://arxiv.org/abs/' || printf('1801.%05d', doc_id) WHEN 2 THEN '/tmp/' || doc_id END AS url,
CASE doc_id % 4 WHEN 0 THEN printf('%04d.%05d', 1801 + doc_id % 5, doc_id) WHEN 1 THEN printf('1801.%05d', doc_id) END AS paper FROM documents""")
def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_ID.replace("printf(", "format_string(").replace("'/tmp/' || doc_id", "concat('/tmp/', doc_id)").replace("'https://arxiv.org/list/' || doc_id", "concat('https://arxiv.org/list/', doc_id)"))
    return documents(spark, sf_dir).select("doc_id", projects.paper_url(text).alias("url")).select("doc_id", "url", projects.paper_id(F.col("url")).alias("paper"))


@query("""SELECT doc_id, 'https://' || source || '.example.com/v1/chat/completions' AS url FROM documents""")
def chat_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("https://"), "source", F.when(F.col("doc_id") % 2 == 0, ".example.com/v1/").otherwise(".example.com/v1/chat/completions"))
    return documents(spark, sf_dir).select("doc_id", tex.chat_url(base).alias("url"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_anti")


@query(TEX_SQL + r""", f AS (SELECT source AS project, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'merge' ELSE 'doc' END || doc_id || '.tex' AS path, tex || CASE WHEN doc_id % 4 = 0 THEN ' \cite{a} \ref{b}' WHEN doc_id % 4 = 1 THEN ' reviewers' ELSE '' END AS content FROM tex_docs),
b AS (SELECT *, replace(regexp_replace(replace(array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(ltrim(x), '%')), chr(10)), '\%', chr(1)), '%[^\n]*', '', 'g'), chr(1), '\%') AS bare FROM f WHERE NOT starts_with(path, 'merge')),
s AS (SELECT project, path, doc_id, contains(bare, '\input')::INT + contains(bare, '\ref')::INT + contains(bare, '\cite')::INT - contains(bare, '\LaTeX')::INT - contains(bare, 'manuscript')::INT - contains(bare, 'Guidelines')::INT - contains(bare, 'font')::INT - contains(bare, 'citations')::INT - contains(bare, 'rejected')::INT - contains(bare, 'blind review')::INT - contains(bare, 'reviewers')::INT AS score FROM b)
SELECT project, path, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, doc_id) AS k FROM s) WHERE k = 1""")
def main_file_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tex_docs(spark, sf_dir)
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "merge").otherwise("doc"), F.col("doc_id").cast("string"), F.lit(".tex"))
    extra = F.when(F.col("doc_id") % 4 == 0, F.lit(" \\cite{a} \\ref{b}")).when(F.col("doc_id") % 4 == 1, F.lit(" reviewers")).otherwise("")
    files = docs.select(F.col("source").alias("project"), F.col("doc_id").alias("ord"), path.alias("path"), F.concat("tex", extra).alias("content"))
    return projects.main_file(files).withColumn("score", F.col("score").cast("long"))


_TREE = "t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), e AS (SELECT p.doc_id AS parent, c.doc_id AS child FROM t c JOIN t p ON p.source = c.source AND p.k = c.k // 2)"


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Within a source the k-th document is included by the one at k div 2."""
    t = documents(spark, sf_dir).select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("k"))
    p = t.select(F.col("doc_id").alias("parent"), "source", F.col("k").alias("half"))
    edges = t.withColumn("half", F.expr("k div 2")).join(p, ["source", "half"]).select("parent", F.col("doc_id").alias("child"))
    return edges, t.where("k = 1").select(F.col("doc_id").alias("node"))


@query(f"""WITH RECURSIVE {_TREE}, r AS (SELECT doc_id AS root, doc_id AS node, 0 AS depth FROM t WHERE k = 1 UNION ALL SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node WHERE r.depth < 32)
SELECT root, node, depth::BIGINT AS depth FROM r""")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without what closes a cycle; a tree deeper than the bound is an error."""
    found = overlay.include_tree(*_tree(spark, sf_dir)).where("flag IS NULL OR flag = 'deeper'")
    depth = F.when(F.col("flag").isNull(), F.col("depth").cast("long")).otherwise(F.raise_error(F.lit("include tree too deep")).cast("long"))
    return found.select("root", "node", depth.alias("depth"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a/F' ELSE 'a/f' END || doc_id || '.tex' AS path FROM documents),
q AS (SELECT doc_id, 'a/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.tex' END AS wanted FROM documents),
m AS (SELECT wanted, path, CASE WHEN path = wanted THEN 1 WHEN path = wanted || '.tex' THEN 2 ELSE 3 END AS p FROM q JOIN f ON lower(path) = lower(wanted) OR lower(path) = lower(wanted) || '.tex')
SELECT wanted, arg_min(path, p) AS path FROM m GROUP BY wanted""")
def include_lookup_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An included name's file: exact, with its ending, else whatever the case."""
    d = documents(spark, sf_dir)
    n = F.col("doc_id").cast("string")
    files = d.select(F.concat(F.when(F.col("doc_id") % 3 == 0, "a/F").otherwise("a/f"), n, F.lit(".tex")).alias("path"))
    asked = d.select(F.concat(F.lit("a/f"), n, F.when(F.col("doc_id") % 2 == 0, "").otherwise(".tex")).alias("wanted"))
    keys = asked.withColumn("key", F.explode(F.array(F.lower("wanted"), F.concat(F.lower("wanted"), F.lit(".tex")))))
    found = keys.join(files.withColumn("key", F.lower("path")), "key")
    rank = F.when(F.col("path") == F.col("wanted"), 1).when(F.col("path") == F.concat("wanted", F.lit(".tex")), 2).otherwise(3)
    return found.groupBy("wanted").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


@query("""WITH d(key, value) AS (VALUES ('model', 'm'), ('proxy', NULL), ('workers', '8')), f(key, value) AS (VALUES ('model', 'n'), ('workers', '')), e(key, value) AS (VALUES ('proxy', 'p'))
SELECT d.key, coalesce(nullif(e.value, ''), nullif(f.value, ''), d.value) AS value FROM d LEFT JOIN f USING (key) LEFT JOIN e USING (key)""")
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = lambda *rows: spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(key, value)")
    return projects.settings(layer("('model', 'm')", "('proxy', CAST(NULL AS STRING))", "('workers', '8')"), layer("('model', 'n')", "('workers', '')"), layer("('proxy', 'p')"))


_FILES = "SELECT 'p' || doc_id % 20 AS project, CASE WHEN doc_id % 20 < 10 THEN 'src/' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN 'outputs/' ELSE '' END || 'f' || doc_id || '.tex' AS path FROM documents"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FILES.replace("FROM documents", "FROM {documents}"), documents=documents(spark, sf_dir))


@query(f"SELECT project, path FROM ({_FILES}) WHERE NOT regexp_matches(path, '(^|/)(workfolder|outputs|logs|__MACOSX)/')")
def name_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.project_files(_files(spark, sf_dir)).select("project", "path")


@query(f"SELECT project, path, CASE WHEN starts_with(path, 'src/') THEN substring(path, 5) ELSE path END AS rel FROM ({_FILES}) WHERE NOT regexp_matches(path, '(^|/)(workfolder|outputs|logs|__MACOSX)/')")
def project_root_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.project_files(_files(spark, sf_dir))
