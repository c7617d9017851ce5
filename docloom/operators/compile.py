"""The compile-and-repair loop around an injectable compiler."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import repair

MOST_ATTEMPTS = 32
LINES_PER_ATTEMPT = 5

#: Takes a document's text and the command; gives whether a PDF came out, and the log.
Compiler = Callable[[str, str], tuple[bool, str]]


def compiled(docs: DataFrame, compiler: Compiler) -> DataFrame:
    """doc_id, tex, ok and log."""
    name = F.when(tex.needs_xelatex(F.col("tex")), "xelatex").otherwise("pdflatex")
    command = F.format_string("%s -interaction=batchmode -file-line-error %s.tex", name, F.lit("merge"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [compiler(t, c) for t, c in zip(batch.column("tex").to_pylist(), batch.column("command").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tex"), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.string())], ["doc_id", "tex", "ok", "log"])

    return docs.select("doc_id", "tex", command.alias("command")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tex string, ok boolean, log string")


def compile_all(segments: DataFrame, compiler: Compiler, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """doc_id, ok, attempts and tex. Failed documents revert the segments near their error lines and try again.

    segments: doc_id, seq, preserve, string, result. The driver holds only a count; the state of a round is a
    checkpoint in the shared folder.
    """
    empty = F.array().cast("array<int>")
    state = segments.select("doc_id").distinct().withColumn("errors", empty)
    done = None
    for attempt in range(1, attempts + 1):
        # The window is that of the attempt: the first repair (attempt 2) takes ten lines.
        docs = repair.reassemble(segments.join(state, "doc_id"), LINES_PER_ATTEMPT * attempt)
        tried = compiled(docs, compiler).join(state, "doc_id").checkpoint()
        line = repair.error_line(F.col("log"))
        ended = tried.where(F.col("ok") | line.isNull() | F.lit(attempt == attempts)).select("doc_id", "ok", F.lit(attempt).alias("attempts"), "tex")
        done = ended if done is None else done.union(ended)
        state = tried.where(~F.col("ok") & line.isNotNull()).select("doc_id", F.array_union("errors", F.array(line.cast("int"))).alias("errors"))
        if state.isEmpty():
            break
    return done
