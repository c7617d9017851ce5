"""Many languages, and documents of many."""

import random

import pytest

from docloom.llm import language


def prose(seed, n=60):
    """Words over letters of a language's own."""
    pick = random.Random(seed)
    letters = pick.sample([chr(c) for c in range(0x4E00, 0x4E00 + 6000)], 8)
    return " ".join("".join(pick.choice(letters) for _ in range(4)) for _ in range(n))


def test_all_languages_are_learned(spark):
    rows = [(i, prose(i), f"l{i:03}") for i in range(300)] + [(1000 + i, prose(i), f"l{i:03}") for i in range(299)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.learn(df)
    assert model.languages == sorted({r[2] for r in rows})
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert got == {r[0]: r[2] for r in rows}


@pytest.fixture(scope="module")
def six(spark):
    learn = spark.createDataFrame([(prose(i, 600), f"l{i}") for i in range(6)], "text string, lang string")
    return language.learn(learn), " ".join(prose(i, 600) for i in range(6))


def test_sets_of_more_than_four(spark, six):
    model, text = six
    got = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert set(got["languages"]) == {f"l{i}" for i in range(6)}


def test_even_mixtures_are_accepted(spark, six):
    model, text = six
    rows = [(1, text, "l0"), (2, "12 34", "l0"), (3, None, "l0")]
    got = language.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert [r["doc_id"] for r in got] == [1]
