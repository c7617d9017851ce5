import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import suffix_dedup
from docloom.llm.shared import written


def brute(rows):
    seen, texts, out = Counter(), [(t or "").encode() for _, t in rows], []
    for b in texts:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


def result(df):
    found = written(suffix_dedup.repeated_spans(df), "test")
    joined = df.select("doc_id", "text", suffix_dedup.row_of().alias("row")).join(found, "row", "left").select("doc_id", "text", "found")
    return sorted(str(tuple(r)) for r in joined.mapInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect())


def corpus(seed):
    pick = random.Random(seed)
    word = lambda n: "".join(pick.choice("abcdefgh é") for _ in range(n))
    passages = [word(pick.randrange(150, 600)) for _ in range(8)]
    rows = [(k, "".join(pick.choice([word(pick.randrange(300)), pick.choice(passages), pick.choice(passages)[pick.randrange(60) :]]) for _ in range(pick.randrange(1, 5)))) for k in range(80)]
    base = word(1500)
    for k in range(30):
        copy = list(base)
        for _ in range(pick.randrange(7)):
            copy[pick.randrange(len(copy))] = "Z"
        rows.append((1000 + k, "".join(copy)))
    rows += [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "ab" * 300), (7, "x" * 3000), (8, word(400) * 3), (9, word(300)), (9, word(300)), (None, word(250))]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("hot", [4096, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)


def test_empty(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_a_text_longer_than_a_unit(spark, monkeypatch):
    pick = random.Random(4)
    long = "".join(pick.choice("abcdefghijk") for _ in range(3 << 19))
    cut = (1 << 20) - suffix_dedup.LENGTH
    rows = [(1, long), (2, "!" * 50 + long[cut - 5000 : cut + 5000] + "?"), (3, long[100:400])]
    found = written(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")), "test")
    assert sorted(sum(b - a for a, b in _joined(r["found"])) for r in found.collect()) == [300, 10_000, 10_300]


def _joined(found):
    out = []
    for a, b in sorted((x["a"], x["b"]) for x in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=25))
def test_deep_shallow_is_a_sort(strings):
    order, lcp = suffix_dedup.deep_shallow(strings, 40)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(strings)):
        a, b = strings[order[k - 1]], strings[order[k]]
        want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == want


def test_all_columns_stay(spark):
    if not hasattr(suffix_dedup, "without_repeats"):
        pytest.skip("no pipeline form")
    text = "".join(random.Random(1).choice("abc") for _ in range(300))
    df = spark.createDataFrame([(1, text, "en", 300), (2, "é" + text + "é", "en", 302), (3, None, None, None)], "doc_id long, text string, row string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["row"], r["n_chars"]) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == {1: ("", "en", 0), 2: ("éé", "en", 2), 3: (None, None, 0)}
