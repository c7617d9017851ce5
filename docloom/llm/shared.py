"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    Where it is unset, as in tests, a temporary one of a local session; on a cluster no folder is known to be shared.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    kept: beyond the end of scratch().
    The shuffle files behind df aren't needed any more; collecting garbage lets Spark's cleaner remove them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.docloom_path = path
    for names in [] if kept else _SCRATCH[-1:]:
        names.append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def spread(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with groups, one row for each key, which come from an aggregation by that key.

    The keys are compared by their complements: so both sides have an exchange, and Spark can split a common key's rows.
    """
    own = groups.withColumn("__key", F.bitwise_not(key)).drop(key)
    return rows.withColumn("__own", F.bitwise_not(key)).join(own, F.col("__own") == F.col("__key")).drop("__own", "__key")


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unwritten(df: DataFrame | None) -> None:
    """Remove what written() wrote: nothing that is still to be computed may read it."""
    if df is not None:
        _remove(df.sparkSession, [df.docloom_path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what operators within have written for themselves."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        _remove(spark, _SCRATCH.pop())


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the decimal doc_id is divisible by modulus; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(True))


def held_out_id(doc_id: int | None, modulus: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == 0


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, most_rows: int = 4096, item_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of a slice is about most_bytes; one longer row is a slice of its own.

    item_bytes: of a column of lists, the bytes of an item.
    """
    for batch in batches:
        own = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.multiply(pa.compute.list_value_length(own), item_bytes) if item_bytes else pa.compute.binary_length(own), 0).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (total + n > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(sizes):
            yield batch.slice(at)


def give_back() -> None:
    """Return freed memory to the machine: Spark's Python workers live on and go on with other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its memory given back at a partition's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bit_table(keys: DataFrame, blocks: int) -> Column:
    """A blocked Bloom filter of the 64-bit hashes in keys(h), an array of 64-bit blocks, as a subquery of one value."""
    block, mask = block_and_mask(F.col("h"), blocks)
    own = keys.select(block.alias("b"), mask.alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b")).join(own, "b", "left")
    rows = F.array_sort(F.collect_list(F.struct("b", F.coalesce("m", F.lit(0).cast("long")).alias("m"))))
    return every.agg(F.transform(rows, lambda r: r["m"]).alias("bits")).scalar()


def block_and_mask(h: Column, blocks: int) -> tuple[Column, Column]:
    """A hash's block and its three bits in it, from independent parts."""
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks).cast("long")).cast("int"), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def may_hold(bits: Column, h: Column, blocks: int) -> Column:
    """Whether the table has all three bits; one is looked at first, as most hashes lack it."""
    block, mask = block_and_mask(h, blocks)
    word = F.get(bits, block)
    return (F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1) & (F.bitwise_not(word).bitwiseAND(mask) == 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(texts: list[bytes], before: bytes, after: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes one after another, each between before and after, with each one's start and end."""
    data = np.frombuffer(b"".join([x for t in texts for x in (before, t, after)]), np.uint8)
    sizes = np.array([len(t) + len(before) + len(after) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return data, ends - sizes, ends
