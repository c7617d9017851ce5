import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import ngram_join


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                parent[top(a)] = top(b)
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[top(k)] = min(low.get(top(k), doc), doc)
    return sorted((doc, len(sets[k]), low[top(k)]) for k, (doc, _) in enumerate(rows))


def corpus(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []

    def near(base, edits):
        w = list(base)
        for _ in range(edits):
            p, r = pick.randrange(len(w)), pick.random()
            if r < 0.4:
                w[p] = pick.choice(words)
            elif r < 0.7 and len(w) > 1:
                del w[p]
            else:
                w.insert(p, pick.choice(words))
        return " ".join(w)

    for _ in range(40):
        base = [pick.choice(words) for _ in range(pick.choice([1, 3, 5, 8, 12, 17, 22, 30, 60, 130, 300]))]
        rows += [(len(rows) * 7 % 1009 + k * 0, near(base, pick.randrange(4))) for k in range(pick.choice([1, 2, 5]))]
    base = [pick.choice(words) for _ in range(150)]
    rows += [(2000 + k, near(base, pick.randrange(6))) for k in range(120)]
    return rows + [(1, None), (1, ""), (7777, "A b"), (7778, "a  B"), (5000, " x\v")]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many rounds and chunks
        monkeypatch.setattr(ngram_join, "PIVOTS", 24)
        monkeypatch.setattr(ngram_join, "CHUNK", 32)
        monkeypatch.setattr(ngram_join, "LATER_PIVOTS", 64)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash")).repartition(3)
    got = ngram_join.jaccard_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty(spark):
    assert ngram_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each_group_stays(spark):
    if not hasattr(ngram_join, "first_of_classes"):
        pytest.skip("no pipeline form")
    rows = [(k, t) for k, (_, t) in enumerate(corpus(6))]
    rows += [(9003, "same words in all of these"), (9004, "same words in all of these"), (9003, "same words in all of these")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, class_id string")
    kept = ngram_join.first_of_classes(df)
    assert kept.columns == df.columns
    classes = brute(rows)
    with_words = len({c for _, n, c in classes if n})
    got = kept.collect()
    assert len(got) == with_words + sum(1 for _, n, _ in classes if not n)
    assert sum(1 for r in got if r["text"] == "same words in all of these") == 1


def test_subsets_cost_less_up_to_the_bound():
    n = ngram_join.light_bound()
    assert 5 <= n <= 30
    assert ngram_join.overlap(10, 10) == 10 and ngram_join.overlap(20, 20) == 19
