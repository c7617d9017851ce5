"""Files of runs: caches, downloads, folders, bibliographies, archives of results and logs, as tables (run_id, name, content)."""

from __future__ import annotations

import logging
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of results and of the documents they come from.
RESULTS = ("merge.pdf", "merge_translate_zh.pdf", "merge_bilingual.pdf")
FINISHED = "translation/translate_zh.pdf"
SOURCES = ("src", "e-print")


def split_by_cache(requests: DataFrame, artifacts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """requests(run_id, use_cache) that have an artifact of this name and may use it, with its content; and the others."""
    own = artifacts.where(F.col("name") == name).select("run_id", F.col("content").alias("cached"))
    both = requests.join(own, "run_id", "left").withColumn("hit", F.col("use_cache") & F.col("cached").isNotNull())
    return both.where("hit").drop("hit"), both.where("NOT hit").drop("hit", "cached")


#: Takes an address; gives its status and bytes.
Opener = Callable[[str], tuple[int, bytes]]


def opened(address: str) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(address) as answer:  # noqa: S310
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def downloaded(papers: DataFrame, site: str, opener: Opener = opened) -> DataFrame:
    """run_id, name, content and error of papers(run_id): the first of a paper's source addresses that answers 200."""

    def fetch(paper: str) -> tuple[bytes | None, str | None]:
        tried = []
        for kind in SOURCES:
            try:
                status, data = opener(f"{site}/{kind}/{paper}")
            except OSError as e:
                status, data = 0, str(e).encode()
            if status == 200:
                return data, None
            tried.append(f"{kind}: {status}")
        return None, "; ".join(tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper in batch.column("run_id").to_pylist():  # one at a time: an archive may be large
                data, error = fetch(paper)
                columns = [[paper], [f"{paper}.tar"], [data], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["run_id", "name", "content", "error"])

    return papers.select("run_id").mapInArrow(run, "run_id string, name string, content binary, error string")


def descended(files: DataFrame) -> DataFrame:
    """files(project, path) within the first folder, if its name ends in .extract, paths from there; else as they are."""
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1)))
    first = files.groupBy("project").agg(F.min(folder).alias("first"))
    inside = F.endswith("first", F.lit(".extract"))
    joined = files.join(first, "project").where(~F.coalesce(inside, F.lit(False)) | F.startswith("path", F.concat("first", F.lit("/"))))
    return joined.withColumn("path", F.when(inside, F.expr("substring(path, length(first) + 2)")).otherwise(F.col("path"))).drop("first")


def bibliographies(artifacts: DataFrame, mains: DataFrame, mode: str) -> DataFrame:
    """run_id, name, content: the main file's bibliography under the names of the merged documents.

    mains: run_id, main (a name without ending). A target that has one keeps it, if it isn't empty; without a bibliography of
    the main file, that of the merged document serves the others.
    """
    bbl = artifacts.where(F.endswith("name", F.lit(".bbl"))).select("run_id", "name", "content")
    own = bbl.join(mains, "run_id").where(F.col("name") == F.concat("main", F.lit(".bbl"))).select("run_id", F.col("content").alias("given"))
    merged = bbl.where("name = 'merge.bbl' AND octet_length(content) > 0").select("run_id", F.col("content").alias("merged"))
    names = F.array(*[F.lit(f"{n}.bbl") for n in ("merge", f"merge_{mode}", "merge_diff", "merge_bilingual")])
    wanted = mains.select("run_id", F.explode(names).alias("name"))
    there = bbl.withColumnRenamed("content", "there")
    joined = wanted.join(own, "run_id", "left").join(merged, "run_id", "left").join(there, ["run_id", "name"], "left")
    given = F.when(F.col("name") != "merge_bilingual.bbl", F.col("given"))
    kept = F.when(F.octet_length("there") > 0, F.col("there"))
    return joined.select("run_id", "name", F.coalesce(given, kept, "given", "merged").alias("content")).where("content IS NOT NULL")


def archived(artifacts: DataFrame) -> DataFrame:
    """run_id, name, content: the results that are there, as outputs/, and as translation/ where a run has that folder."""
    results = artifacts.where(F.col("name").isin(*RESULTS)).select("run_id", "name", "content")
    has = artifacts.where(F.startswith("name", F.lit("translation/"))).select("run_id").distinct()
    copies = results.join(has, "run_id").withColumn("name", F.concat(F.lit("translation/"), "name"))
    return results.withColumn("name", F.concat(F.lit("outputs/"), "name")).union(copies)


def file_names(mode: str, attempt: Column | None = None) -> Column:
    """The name of a transformed document, with its attempt's number from the second on."""
    name = F.lit(f"merge_{mode}")
    return F.concat(name, F.lit(".tex")) if attempt is None else F.concat(name, F.when(attempt > 1, F.concat(F.lit("_fix_"), (attempt - 1).cast("string"))).otherwise(""), F.lit(".tex"))


def run_paths(root: str, run_id: Column) -> dict[str, Column]:
    base = F.concat_ws("/", F.lit(root.rstrip("/")), run_id)
    return {"root": base} | {n: F.concat_ws("/", base, F.lit(n)) for n in ("workfolder", "outputs", "logs")}


def time_name(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd-HH-mm-ss")


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A step's rows, kept as Parquet in a folder that all executors see, and read back."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def loaded(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """What saved() kept; none if nothing was."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}") if there else None


def texts(docs: DataFrame, name: Column) -> DataFrame:
    """run_id, name, content of docs(doc_id, tex), as the other artifacts."""
    return docs.select(F.col("doc_id").cast("string").alias("run_id"), name.alias("name"), F.encode("tex", "UTF-8").alias("content"))


@contextmanager
def run_log(path: str, logger: str = "docloom") -> Iterator[logging.Logger]:
    """A log file of one run, closed at its end however it ends."""
    out, handler = logging.getLogger(logger), logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    out.addHandler(handler)
    try:
        yield out
    finally:
        out.removeHandler(handler)
        handler.close()
