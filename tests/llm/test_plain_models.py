"""Both classifiers against plain computations."""

import math

import numpy as np
import pytest
from test_languages import prose

from docloom.llm import language, quality


def codes(text):
    data = b" " + text.encode().lower() + b"  "
    return [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 18 for i in range(len(data) - 2)]


def plain_mixture(model, text):
    c = codes(text)
    like = [[sum(float(row[x]) for x in c[i : i + 48]) for row in model.logp] for i in range(0, len(c), 48)]
    k = len(model.languages)

    def fit(allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        while len(allowed) > 1:
            new = [0.0] * k
            for row in like:
                top = max(row)
                part = [math.exp(x - top) * s for x, s in zip(row, share, strict=True)]
                for j in range(k):
                    new[j] += part[j] / max(sum(part), 1e-300) / len(like)
            moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
            if moved <= language.CLOSE:
                break
        value = sum(max(row) + math.log(max(sum(math.exp(x - max(row)) * s for x, s in zip(row, share, strict=True)), 1e-300)) for row in like)
        return share, value

    share, _ = fit(range(k))
    order = sorted(range(k), key=lambda j: -share[j])
    best, value = None, -math.inf
    for size in range(1, k + 1):
        own, found = fit(order[:size])
        found -= size * 6 * 0.5 * math.log(max(2, len(like)))
        if found <= value:
            break
        best, value = own, found
    return best


@pytest.fixture(scope="module")
def model(spark):
    learn = spark.createDataFrame([(prose(i, 300), f"l{i}") for i in range(4)], "text string, lang string")
    return language.learn(learn)


def test_language_by_plain_em(model):
    texts = [prose(0, 40), prose(1, 90) + prose(2, 40), " ".join(prose(i, 25 * (i + 1)) for i in range(4)), "abc", prose(7, 30)]
    got = language.mixture(model, [t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_mixture(model, t), atol=1e-6)


def test_language_ties_go_to_the_first(spark):
    learn = spark.createDataFrame([("the same text", "b"), ("the same text", "a"), ("the same text", "c")], "text string, lang string")
    pred, score, sets = language.predict(language.learn(learn), ["the same text " * 50, "same", "same"])
    assert pred == ["a"] * 3 and list(score) == [1.0] * 3 and sets[0] == [("a", 1.0)]


def plain_ftrl(rows, labels):
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_quality_by_plain_ftrl():
    texts = [b"good words here", b"BAD!! BAD!! BAD!!", b"more good words, of use", b"", b"9 9 9 !!! spam SPAM"]
    labels = [1, 0, 1, 1, 0]
    rows = []
    for t in texts:
        own, _ = quality.features([t])
        x = {quality.BUCKETS: 1.0}
        for i in own.tolist():
            x[i] = x.get(i, 0.0) + quality.SCALE / len(own)
        rows.append(x)
    weight = plain_ftrl(rows, labels)
    found = quality.ftrl(texts, labels)
    want = [1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items()))) for x in rows]
    assert np.allclose(found.scores(texts), want, atol=1e-4)


def test_quality_takes_ids_of_any_type_and_several_labels(spark):
    df = spark.createDataFrame([("a", "good words"), ("b", "BAD!! BAD!!"), ("c", "BAD!! BAD!!"), ("d", "x" * (quality.TRAIN_TEXT + 1))], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("b", 0), ("c", 0), ("c", 7), ("d", 1)], "doc_id string, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, quality.train(df, labels)).collect()}
    assert got["a"] > got["b"] == got["c"] and len(got) == 4
    # A document with both labels counts as the larger one.
    both = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "doc_id string, quality int")
    want = quality.train(df, spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int"))
    assert np.array_equal(quality.train(df, both).weights, want.weights)
