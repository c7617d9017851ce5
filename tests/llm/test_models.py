import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language, quality

FOLDER = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    got = language.op9_language(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    learn = spark.createDataFrame([("the cat and the dog of this house " * 9, "en"), ("der hund und die katze von diesem haus " * 9, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language.learn(learn)
    assert model.languages == ["de", "en"]
    mixed = "the cat and the dog of this house " * 9 + "der hund und die katze von diesem haus " * 9
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (4, "the dog"), (5, mixed), (6, "die katze " * 40_000), (None, "der hund")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("fr")).withColumn("score", F.lit("x"))
    got = language.identify(df, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got if r["doc_id"] != 5) == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("6", "de"), ("None", "de")])
    both = next(r for r in got if r["doc_id"] == 5)
    assert set(both["languages"]) == {"de", "en"} and 0.35 < both["score"] < 0.65
    assert language.accepted(df, model).count() == 5
    assert language.accepted(df.withColumn("lang", F.lit(None).cast("string")), model).where("doc_id = 4").first()["lang"] == "en"
    nothing = language.learn(learn.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).collect() == []


def test_quality_on_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.op7_quality(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_quality_cases(spark):
    rows = [(1, "good words here"), (2, "BAD!! BAD!! BAD!!"), (3, None), (4, ""), (5, "z" * 100_000), (5, "q " * 30_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(got) == 6 and got[1] > got[2] and got[3] == got[4]
    one = quality.train(df, labels.where("quality = 1"))
    assert len({round(r["score"], 6) for r in quality.score(df, one).collect()}) == 1
    none = quality.train(df, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.limit(0), model).collect() == []


def test_features_do_not_cross_documents():
    both, sizes = quality.features([b"one two", b"three"])
    alone, _ = quality.features([b"three"])
    assert (both[sizes[0] :] == alone).all()
