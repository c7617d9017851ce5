"""Language ID: multilingual mixture inference by expectation-maximisation.

Learning counts hashed byte trigrams of lower-cased text for each language over all learning documents; the model is
their smoothed log probabilities, of a fixed size for each language. A document is cut into segments of SEGMENT
trigrams; each segment's likelihood under each language is the product over its trigrams. EM estimates the document's
proportions of languages, until no proportion changes by more than CLOSE; the language set is then chosen by
log-likelihood less a penalty, growing by the next language while that pays. The penalty of a language is PENALTY times
that of BIC (half the log of the number of segments), as trigrams that overlap aren't independent and make a segment's
likelihood that much sharper. The score is the best language's proportion in the chosen set.

Defined results: null text, text without a letter, and any text if nothing could be learned, gives "und" with score 0
and no proportions. Ties go to the language that sorts first. Repeated rows give equal rows (and count twice when
learning); other columns than doc_id, text and lang aren't read; lang only when learning. All values of lang are learned;
the driver and every worker hold the model, 64 KB for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import freed, held_out, packed, slices, table

BUCKETS = 1 << 14
SEGMENT = 48
PENALTY = 6.0
CLOSE = 1e-4
#: EM steps that no document needs: proportions that still change then are as likely as any.
ROUNDS = 500
SMOOTHING = 0.5
#: Counts of so many languages are held by a learning task at once, and texts cut smaller for a model of more.
LANGUAGES_HELD = 64
MODULUS = 5
LETTER = re.compile(r"[^\W\d_]")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram of the lower-cased texts, each between spaces, and the number of each text's."""
    data, starts, ends = packed([t.lower() for t in texts], b" ", b"  ")
    d = data.astype(np.uint32)
    code = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(18)
    keep = np.ones(len(code), bool)
    inner = ends[:-1]
    keep[inner - 1] = keep[inner - 2] = False
    return code[keep], ends - starts - 2


class Model:
    def __init__(self, languages: list[str], logp: np.ndarray) -> None:
        self.languages, self.logp = languages, logp.astype(np.float32)


def learn(documents: DataFrame) -> Model:
    """Count trigrams by language over all documents with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def counts() -> Iterator[pa.RecordBatch]:
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            total.clear()

        for batch in slices(batches, "text", 4 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for lang in set(langs):
                code, _ = trigrams([texts[i] for i in np.flatnonzero(langs == lang)])
                total[lang] = total.get(lang, 0) + np.bincount(code, minlength=BUCKETS)
                if len(total) > LANGUAGES_HELD:
                    yield from counts()
        yield from counts()

    def smoothed(own: pa.Table) -> pa.Table:
        n = np.full(BUCKETS, SMOOTHING)
        n[own.column("bucket").to_numpy()] += own.column("n").to_numpy()
        logp = np.log(n / n.sum()).astype(np.float32)
        return pa.table([pa.array(own.column("lang").to_pylist()[:1], pa.string()), pa.array([logp.tobytes()], pa.binary())], ["lang", "logp"])

    known = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = known.mapInArrow(freed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sorted((r["lang"], bytes(r["logp"])) for r in counted.groupBy("lang").applyInArrow(smoothed, "lang string, logp binary").collect())
    return Model([x for x, _ in found], np.frombuffer(b"".join(row for _, row in found), np.float32).reshape(len(found), BUCKETS))


def mixture(model: Model, texts: list[bytes]) -> np.ndarray:
    """For each text the languages' proportions, 0 for those that aren't in its set."""
    code, sizes = trigrams(texts)
    per_doc = -(-sizes // SEGMENT)
    first = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(len(texts)), per_doc)
    cuts = (np.cumsum(sizes) - sizes)[doc] + SEGMENT * (np.arange(len(doc)) - first[doc])
    like = np.stack([np.add.reduceat(row[code], cuts) for row in model.logp], axis=1).astype(np.float64)
    top = like.max(axis=1, keepdims=True)
    ratio = np.exp(like - top)
    base = np.add.reduceat(top[:, 0], first)
    k = len(model.languages)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        going = np.flatnonzero(allowed.sum(axis=1) > 1)  # texts whose proportions still change
        for _ in range(ROUNDS):
            if not len(going):
                break
            n = per_doc[going]
            at = np.cumsum(n) - n
            part = ratio[np.arange(n.sum()) + np.repeat(first[going] - at, n)] * share[np.repeat(going, n)]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            new = np.add.reduceat(part, at, axis=0) / n[:, None]
            moved = np.abs(new - share[going]).max(axis=1) > CLOSE
            share[going] = new
            going = going[moved]
        total = (ratio * share[doc]).sum(axis=1)
        return share, base + np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)

    share, _ = fit(np.ones((len(texts), k)))
    order = np.argsort(-share, axis=1, kind="stable")
    best_share, best_value = np.zeros_like(share), np.full(len(texts), -np.inf)
    open_ = np.ones(len(texts), bool)
    allowed = np.zeros_like(share)
    for size in range(1, k + 1):
        allowed[np.arange(len(texts)), order[:, size - 1]] = 1
        own, value = fit(allowed)
        value = value - size * PENALTY * 0.5 * np.log(np.maximum(per_doc, 2))
        open_ &= value > best_value
        best_share[open_], best_value[open_] = own[open_], value[open_]
        if not open_.any():
            break
    return best_share


def _texts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Slices that take about as much memory with more languages."""
    return slices(batches, "text", (4 << 20) * LANGUAGES_HELD // max(LANGUAGES_HELD, len(model.languages)))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list]:
    """For each text its language, that language's proportion, and the proportions of the chosen set."""
    names = model.languages
    use = [i for i, t in enumerate(texts) if names and t and LETTER.search(t)]
    pred, score, sets = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
    if use:
        chosen = mixture(model, [texts[i].encode() for i in use])
        best = np.argmax(chosen, axis=1)
        for row, i in enumerate(use):
            pred[i], score[i] = names[best[row]], min(1.0, chosen[row, best[row]])
            sets[i] = [(names[j], float(chosen[row, j])) for j in np.flatnonzero(chosen[row] > 0)]
    return pred, score, sets


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the language's proportion) and languages (proportions of the chosen set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches, model):
            pred, score, sets = predict(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    return documents.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {dict(documents.dtypes)['doc_id']}, lang_pred string, score double, languages map<string,double>")


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that have a language, whatever its proportion; a null lang becomes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches, model):
            pred, _, _ = predict(model, batch.column("text").to_pylist())
            langs = [a if a is not None else b for a, b in zip(batch.column("lang").to_pylist(), pred, strict=True)]
            at = batch.schema.get_field_index("lang")
            columns = [pa.array(langs, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            keep = [p != "und" for p in pred]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(freed(run), documents.schema)


def learned_part(documents: DataFrame) -> DataFrame:
    return documents.where(~held_out(F.col("doc_id"), MODULUS))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, learn(learned_part(documents.select("doc_id", "text", "lang"))))
    return found.select("doc_id", held_out(F.col("doc_id"), MODULUS).alias("held_out"), "lang_pred", "score")
