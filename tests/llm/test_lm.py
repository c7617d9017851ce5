import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import lm
from docloom.llm.elias_fano import EliasFano


@pytest.mark.parametrize(("n", "bound"), [(0, 10), (1, 5), (1000, 1000), (3000, 1 << 40), (3000, 50)])
def test_elias_fano(n, bound):
    pick = np.random.default_rng(n)
    values = np.sort(pick.integers(0, bound, n)).astype(np.uint64)
    assert (EliasFano(values, bound)[np.arange(n)] == values).all()
    assert (EliasFano(values, bound).values() == values).all()
    own = np.unique(values)
    if len(own):
        asked = np.concatenate((pick.choice(own, 50), pick.integers(0, bound, 200).astype(np.uint64)))
        found = EliasFano(own, bound).search(np.zeros(250, np.int64), np.full(250, len(own)), asked)
        assert ((found >= 0) == np.isin(asked, own)).all() and (own[found[found >= 0]] == asked[found >= 0]).all()


def test_pack():
    for v in ([], [0], [5, 5, 9, 1 << 63], [3, 1, 2]):
        a = np.array(v, np.uint64)
        rising = sorted(v) == v
        got = lm.unpack(lm.pack([a, a[::-1], a], rising=(0, 2) if rising else ()))
        assert (got[0] == a).all() and (got[1] == a[::-1]).all() and (got[2] == a).all()


def test_codes():
    p = 10.0 ** -np.linspace(0, 7.5, 200)
    assert np.abs(np.log10(lm.decoded(lm.coded(p)) / p)).max() < 0.0011
    b = np.linspace(lm.LEAST, 1, 99)
    assert np.abs(lm.weight(lm.weight_code(b)) - b).max() < 0.001 and lm.weight(lm.weight_code(np.ones(1)))[0] == 1
    assert lm.decoded(lm.coded(np.zeros(1))) == 0


def test_levels():
    """Every second item is there; items are found below their own parents only."""
    pick = np.random.default_rng(1)
    keys = np.unique(pick.integers(0, 50, 5000) << 20 | pick.integers(0, 300, 5000))
    parents, items = keys >> 20, keys & 0xFFFFF
    level = lm.Level(parents[::2], items[::2], (items[::2] % 251).astype(np.uint8), 50, 20)
    found = level.places(parents, items)
    assert (found[::2] == np.arange(len(found[::2]))).all() and (found[1::2] < 0).all()
    assert (level.code(found, 255)[::2] == items[::2] % 251).all() and (level.code(found, 255)[1::2] == 255).all()
    assert (level.places(np.full(len(items), -1), items) < 0).all()
    mixed = pick.permutation(len(keys))  # not rising: each is searched in its context's range
    assert (level.places(parents[mixed], items[mixed]) == found[mixed]).all()


def test_grams():
    """One key of 63 bits, and three keys."""
    pick = np.random.default_rng(2)
    for top in (20, 1 << 30):
        rows = pick.integers(0, 12, (3, 3000)) * (top // 12)
        grams = lm.Grams(*rows)
        want, of, counts = np.unique(rows, axis=1, return_inverse=True, return_counts=True)
        assert (np.stack((grams.v, grams.u, grams.w)) == want).all() and (grams.of == of.ravel()).all() and (grams.sums(np.ones(3000)) == counts).all()
        pairs, of = np.unique(want[:2], axis=1, return_inverse=True)
        assert (np.stack((grams.pv, grams.pu)) == pairs).all() and (grams.pair_of == of.ravel()).all()
    empty = np.zeros(0, np.int64)
    assert len(lm.Grams(empty, empty, empty).pv) == 0


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, monkeypatch, small):
    if small:  # many blocks and shards, many hot words and contexts
        monkeypatch.setattr(lm, "BLOCK_BYTES", 60_000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 5_000)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(-5, None), (-6, ""), (0, "the the"), (0, "the the"), (-7, "of the cat of the dog " * 400), (None, "the end of the story"), (-8, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit(0)).withColumn("shard", F.lit(0)).repartition(3)
    got = lm.score(df).collect()
    tokens = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [b""]
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    one, two, three = Counter(), Counter(), Counter()
    for d, t in rows:
        if not out(d):
            w = tokens(t)
            one.update(w)
            two.update(zip([b"\n", *w], w, strict=False))
            three.update(zip([b"\n", *w], w, w[1:], strict=False))
    starts = sum(not out(d) for d, _ in rows)
    before = Counter()
    for (u, v, _), n in three.items():
        before[u, v] += n
    total, types = sum(one.values()), len(one)
    want = {}
    for d, t in rows:
        w = tokens(t)
        p = [(one[x] + 0.1) / (total + 0.1 * (types + 1)) for x in w]
        score = 0
        for i, (x, q) in enumerate(zip(w, p, strict=True)):
            v = w[i - 1] if i else b"\n"
            c = one[v] if i else starts
            q = (two[v, x] + (2.3 * c + 5) * q) / (c + 2.3 * c + 5)
            if i:
                u = w[i - 2] if i > 1 else b"\n"
                c = before[u, v]
                q = (three[u, v, x] + (2.3 * c + 5) * q) / (c + 2.3 * c + 5)
            score += math.log10(q)
        want.setdefault(d, []).append((len(w), sum(one[x] > 0 for x in w), sum(map(math.log10, p)), score, out(d)))
    assert len(got) == len(rows)
    for r in got:
        assert any(
            (r["n_tokens"], r["n_known"], r["held_out"]) == (n, k, h) and math.isclose(r["base_score"], b, rel_tol=1e-9) and abs(r["score"] - s) < 0.0015 * n + 0.01 for n, k, b, s, h in want[r["doc_id"]]
        ), (r, want[r["doc_id"]])
        assert r["train_tokens"] == total
    assert lm.score(df.limit(0)).collect() == []


def test_ids_of_any_type_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in lm.score(df.where("doc_id IS NULL")).collect()}
    assert got[None]["score"] == got[None]["base_score"] == 0 and got[None]["train_tokens"] == 0
    assert {r["doc_id"] for r in lm.score(df).collect()} == {"a", None}


def test_better_than_the_base_on_held_out_documents(spark):
    r = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.9 * r["b"]  # both negative
