"""Near copies by the pipeline's rule: five-word shingles, similarity from 0.8 on."""

import random

import pytest
from test_ngram_join import corpus

import corpus_pipeline
from docloom.llm import ngram_join


def brute(rows, words, numerator):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
                parent[top(a)] = top(b)
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[top(k)] = min(low.get(top(k), doc), doc)
    return sorted((doc, len(sets[k]), low[top(k)]) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("words", "numerator"), [(5, 80), (2, 60)])
def test_classes(spark, words, numerator):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_classes(df, words, (numerator, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, words, numerator)


def test_stage_drops_a_copy_that_lacks_a_block(spark):
    pick = random.Random(3)
    words = [f"w{pick.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] + words[160:])), (3, " ".join(words[:100] + words[200:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, df, "").collect()}
    # 1 and 2 are alike by 0.84, 2 and 3 by 0.87, 1 and 3 by 0.74.
    assert kept == {1}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_stage_on_the_tables(spark, folder):
    documents = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = [tuple(r) for r in documents.orderBy("doc_id").select("doc_id", "text").collect()]
    classes = brute(rows, 5, 80)
    want = {doc for doc, n, low in classes if doc == low or not n}
    assert {r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, documents, "").collect()} == want
