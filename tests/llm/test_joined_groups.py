"""Large groups of documents that chain by common passages, other sides of bounds, and odd rows."""

import random
from collections import Counter, defaultdict

import pytest
from test_ngram_join import corpus

from docloom.llm import graph, ngram_join


def listed(rows, words, numerator):
    """Components by an inverted index in plain Python. Null ids never name one unless all are null."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    lists = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x])
        for j, both in shared.items():
            if 100 * both >= numerator * (len(s) + len(sets[j]) - both):
                parent[top(k)] = top(j)
        for x in s:
            lists[x].append(k)
    low = {}
    for k, (doc, _) in enumerate(rows):
        own = low.get(top(k))
        low[top(k)] = doc if own is None else own if doc is None else min(own, doc)
    return sorted(map(str, ((doc, len(sets[k]), low[top(k)] if sets[k] else doc) for k, (doc, _) in enumerate(rows))))


def chained(n):
    """Each document shares a long passage with the next one; some are near copies, some pass the threshold by a chain."""
    pick = random.Random(4)
    word = lambda: f"w{pick.randrange(4000)}"
    passages = [[word() for _ in range(60)] for _ in range(40)]
    rows, base = [], None
    for k in range(n):
        if base is None or pick.random() < 0.35:
            base = [*passages[k % 40], *[word() for _ in range(pick.randrange(4, 80))], *passages[(k + 1) % 40]]
        else:
            base = list(base)
            for _ in range(pick.randrange(3)):
                base[pick.randrange(len(base))] = word()
        rows.append((k, " ".join(base)))
    return rows


@pytest.mark.parametrize(("words", "numerator"), [(3, 90), (5, 80)])
def test_chains_of_passages(spark, words, numerator):
    rows = chained(3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_classes(df, words, (numerator, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == listed(rows, words, numerator)


@pytest.mark.parametrize(
    ("name", "value", "words", "numerator"),
    [("BROADCAST_ROWS", -1, 3, 90), ("BROADCAST_ROWS", -1, 5, 80), ("PIVOT_SHINGLES", 6000, 5, 80), ("SCANNED", -1, 3, 90), ("POSTINGS", 1, 5, 80)],
)
def test_other_sides_of_bounds(spark, monkeypatch, name, value, words, numerator):
    """Joins by exchanges, few pivots in a round, and members scanned one by one."""
    monkeypatch.setattr(ngram_join, name, value)
    long = "very long text of a few words that come again " * 10_000
    rows = corpus(11)[-60:] + [(None, "a text of a null id with ten words in it"), (None, "a text of a null id with ten words in it"), (90, "a text of a null id with ten words in it"), (None, "alone with no id"), (91, long), (92, long + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_classes(df, words, (numerator, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == listed(rows, words, numerator)


def test_components_that_are_not_found_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    monkeypatch.setattr(graph, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(64)], "u long, v long"))
