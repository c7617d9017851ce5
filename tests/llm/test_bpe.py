import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
RANKS = bpe.read_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


def check(text):
    parts = CODEC.encode([text])[0]
    ids = [int(i) for p in parts if p[0] for i in p[1].split(",")]
    assert ids == ENCODING.encode_ordinary(text)
    assert b"".join(p[2] for p in parts) == text.encode()
    assert sum(p[0] for p in parts) == len(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t\x1c\x85ab'sTé1½٣漢🙂.,!", max_size=25))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("n", [bpe.SHORT - 1, bpe.SHORT + 1, 3000, bpe.BLOCK + 5000])
def test_long_words(n):
    pick = random.Random(n)
    check("".join(pick.choice("abcdetion") for _ in range(n)))
    check("a" * n)


@pytest.mark.parametrize("signs", ["ab", "aet", "=-", "the", "in gt", "\u4e2d\u6587\u7684", "0123456789", "a\u00e9\U0001f642"])
@pytest.mark.parametrize("block", [70, 100_000])
def test_neighbourhoods(signs, block, monkeypatch):
    """Words of few signs, where many pairs tie, whole and in blocks."""
    monkeypatch.setattr(bpe, "SHORT", 3)
    monkeypatch.setattr(bpe, "BLOCK", block)
    pick = random.Random(signs)
    words = ["".join(pick.choice(signs) for _ in range(pick.randrange(2, 200))).encode() for _ in range(8)] + [signs[0].encode() * 300]
    flat, ends = CODEC.encode_words(words)
    for w, a, b in zip(words, [0, *ends], ends, strict=False):
        assert flat[a:b].tolist() == ENCODING._encode_single_piece(w)


def test_many_long_words():
    """Contraction keeps no row of every step of every word."""
    pick = random.Random(7)
    words = [bytes(pick.choice(b"0123456789abcdef") for _ in range(100)) for _ in range(5_000)] + [bytes(pick.choice(b"etaoinshr") for _ in range(pick.randrange(50, 2000))) for _ in range(100)]
    flat, ends = CODEC.encode_words(words)
    for i in [*range(0, 5_000, 200), *range(5_000, len(words))]:
        assert flat[ends[i - 1] if i else 0 : ends[i]].tolist() == ENCODING._encode_single_piece(words[i])


def test_very_long_text():
    pick = random.Random(2)
    check(" ".join("".join(pick.choice("etaoin") for _ in range(pick.randrange(1, 9))) for _ in range(50_000)))


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(map(str, bpe.digests(df).collect()))
    want = []
    for d, t in rows:
        ids = ENCODING.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={d}, n_tokens={n}, ids_sha256='{a}', decoded_sha256='{b}')" for d, n, a, b in want)
    encoded = bpe.encode(df)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {d: ENCODING.encode_ordinary(t or "") for d, t in rows}
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in bpe.decode(encoded).collect()) == sorted((str(d), (t or "").encode()) for d, t in rows)
    assert bpe.digests(df.limit(0)).collect() == []


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert {r["doc_id"]: r["bytes"] for r in bpe.decode(df).collect()} == {1: None, 2: bytearray()}
