"""LM scoring: a word trigram model in Elias-Fano tries.

Tokens are the lower-cased words of a text and its end. The model interpolates trigrams, bigrams and smoothed unigrams:

    P(w | u v) = a(u v w) + b(u v) P(w | v),   P(w | v) = a(v w) + b(v) P(w),   P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
    a(h w) = c(h w) / (c(h) + m),  b(h) = m / (c(h) + m),  m = SPREAD c(h) + PRIOR

with counts over all training documents. A text's first word has no trigram, its context is the start. The tries grow
with the corpus, so they are dealt over shards of a fixed number of tokens, and nobody holds them whole:

* Documents are cut into blocks, written with their words' hashes and their tokens as places among these.
* Each block sends the shards of words its distinct words and their training counts. They answer with c(w) and with the
  words' numbers, frequent words first, and the blocks are written anew with these.
* A trigram is in the shard of its middle word v, so that bigrams v w and contexts u v are whole there. A word that is
  more than a fourth of a shard's share of all tokens is hot: its trigrams are dealt by u too (and by w, if u v itself
  is hot), its bigrams by w, and the counts of hot contexts, a bounded list, are known to all.
* A shard adds the counts of all blocks, builds its trie and answers each block's n-grams with codes.

A trie's first level is the rising list of contexts v, with rising pointers to their successors w and to the words u
before them; these second levels are one rising list each, as they are stored relative to their context's place; the
words u point on to the third level, successors of u v relative to its place. All are Elias-Fano sequences in memory
maps, with the smoothed probabilities a and the weights b, quantised to 12 bits and a byte. A lookup searches the
successor in its context's range, level by level; many rising ones are merged with a level that is read in order.

Words are told apart by 64-bit hashes. Defined results: null text has the end token only; without training documents every
probability of the unigram is 1; rows with a null doc_id are held out. Repeated rows count and score alike; ids may be
of any type. A very long text is a block of its own. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docloom.llm.elias_fano import EliasFano, mapped
from docloom.llm.shared import freed, give_back, held_out_id, slices, table, unwritten, written

MODULUS = 10
SPREAD, PRIOR = 2.3, 5.0
ADDED = 0.1
BLOCK_BYTES = 6 << 20
#: Tokens of a shard, and how many times more words than n-grams' tokens a shard of words takes.
SHARD_TOKENS = 1_200_000
WORDS_FACTOR = 6
#: A context is hot from this share of all tokens on, if a fourth of a shard's share isn't less.
HOT_SHARE = 1 / 512
MOST_WORDS_KNOWN = 250_000
END = xxh3_64_intdigest(b"")
START = xxh3_64_intdigest(b"\n")  # no word
_M, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_32 = np.uint64(32)
_LOW = (1 << 32) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxh3_64_intdigest(word)
        return value


_KNOWN = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _M2
    return x ^ (x >> np.uint64(29))


def pack(arrays: list[np.ndarray], rising: tuple[int, ...] = ()) -> bytes:
    """Unsigned integers by byte planes, compressed together; the arrays of these numbers by their differences."""
    heads, planes = [len(arrays).to_bytes(1, "little")], []
    for i, a in enumerate(arrays):
        v = a.astype(np.uint64)
        if i in rising and len(v):
            v = np.diff(v, prepend=np.uint64(0))
        wide = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
        heads.append(bytes([wide, i in rising]) + len(v).to_bytes(6, "little"))
        planes.append(np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())
    return b"".join(heads) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    n = data[0]
    heads = [(data[at], data[at + 1], int.from_bytes(data[at + 2 : at + 8], "little")) for at in range(1, 1 + 8 * n, 8)]
    raw = zstandard.ZstdDecompressor().decompress(data[1 + 8 * n :], max_output_size=1 + sum(w * k for w, _, k in heads))
    out, at = [], 0
    for wide, rising, k in heads:
        v = np.zeros((k, 8), np.uint8)
        v[:, :wide] = np.frombuffer(raw, np.uint8, wide * k, at).reshape(wide, k).T
        at += wide * k
        v = v.view("<u8")[:, 0].astype(np.uint64)
        out.append(np.cumsum(v, dtype=np.uint64) if rising else v)
    return out


#: Probabilities by their logarithm, so many steps a decade, code 0 for none; weights between the least and 1 in 255 steps.
STEPS, MOST = 500, 4095
LEAST = SPREAD / (1 + SPREAD)


def coded(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.round(1 - STEPS * np.log10(np.maximum(p, 1e-30))), 1, MOST), 0).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1 - codes.astype(np.float64)) / STEPS), 0.0)


def weight_code(b: np.ndarray) -> np.ndarray:
    return np.round((b - LEAST) / (1 - LEAST) * 255).astype(np.uint8)


def weight(codes: np.ndarray) -> np.ndarray:
    return LEAST + codes.astype(np.float64) / 255 * (1 - LEAST)


def weights(counts: np.ndarray) -> np.ndarray:
    """b of contexts with these counts."""
    m = SPREAD * counts + PRIOR
    return m / (counts + m)


def probabilities(counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """a of n-grams with these counts in contexts with those."""
    return counts / (contexts * (1 + SPREAD) + PRIOR)


class Level:
    """Rising items, each relative to its parent's place, with a code for each."""

    def __init__(self, parents: np.ndarray, items: np.ndarray, codes: np.ndarray, n_parents: int, bits: int) -> None:
        self.bits = np.uint64(bits)
        self.items = EliasFano(parents.astype(np.uint64) << self.bits | items.astype(np.uint64), max(1, n_parents) << bits)
        self.pointers = EliasFano(np.searchsorted(parents, np.arange(n_parents + 1)), len(items) + 1)
        self.codes = mapped(codes)

    def places(self, parents: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The place of each item below its parent's place, -1 for one that isn't there or has no parent."""
        out = np.full(len(items), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        at = parents[known]
        want = at.astype(np.uint64) << self.bits | items[known].astype(np.uint64)
        if len(known) < len(self.items) // 4 or (want[1:] < want[:-1]).any():
            a, b = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64)
            out[known] = self.items.search(a, b, want)
        elif len(self.items):
            own = self.items.values()
            found = np.minimum(np.searchsorted(own, want), len(own) - 1)
            out[known] = np.where(own[found] == want, found, -1)
        return out

    def code(self, places: np.ndarray, without: int) -> np.ndarray:
        out = np.full(len(places), without, self.codes.dtype)
        out[places >= 0] = self.codes[places[places >= 0]]
        return out


class Grams:
    """The distinct ones of rows (v, u, w), in order, and each row's place in them; and the distinct contexts u v."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        top = [int(x.max()).bit_length() if len(x) else 0 for x in (v, u, w)]
        if sum(top) <= 63:
            key = (v << top[1] | u) << top[2] | w
            order = np.argsort(key)
            key = key[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
        else:
            order = np.lexsort((w, u, v))
            x, y, z = v[order], u[order], w[order]
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))[: len(order)]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        first = order[new]
        self.v, self.u, self.w = v[first], u[first], w[first]
        new = np.append(True, (self.v[1:] != self.v[:-1]) | (self.u[1:] != self.u[:-1]))[: len(first)]
        self.pair_of = np.cumsum(new) - 1
        self.pv, self.pu = self.v[new], self.u[new]

    def sums(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, n, len(self.v))


class Trie:
    """The trigrams and bigrams of a shard. Rows are distinct and in order; those with count 0 aren't stored."""

    def __init__(self, tri: Grams, tri_counts: np.ndarray, pair_counts: np.ndarray, bv: np.ndarray, bw: np.ndarray, bi_counts: np.ndarray, heads: np.ndarray, head_counts: np.ndarray) -> None:
        """heads: the contexts v, of all rows."""
        bits = max(int(x.max()).bit_length() if len(x) else 1 for x in (tri.v, tri.u, tri.w, bv, bw))
        self.heads = EliasFano(heads, 1 << bits)
        self.head_codes = mapped(weight_code(weights(head_counts)))
        two, three = bi_counts > 0, tri_counts > 0
        above = np.searchsorted(heads, bv[two])
        self.successors = Level(above, bw[two], coded(probabilities(bi_counts[two], head_counts[above])), len(heads), bits)
        self.before = Level(np.searchsorted(heads, tri.pv), tri.pu, weight_code(weights(pair_counts)), len(heads), bits)
        above = tri.pair_of[three]
        self.third = Level(above, tri.w[three], coded(probabilities(tri_counts[three], pair_counts[above])), len(tri.pv), bits)

    def head(self, v: np.ndarray) -> np.ndarray:
        """The places of rising contexts."""
        own, back = np.unique(v, return_inverse=True)
        return self.heads.search(np.zeros(len(own), np.int64), np.full(len(own), len(self.heads)), own.astype(np.uint64))[back]


@dataclass
class Hot:
    """Contexts that are dealt over several shards, by number, rising, with their counts. The start is one of the words."""

    start: int
    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray  # u << 32 | v
    pair_counts: np.ndarray

    @staticmethod
    def count_of(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The count of each key, -1 for those that aren't hot."""
        if not len(known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, counts[at], -1)


class Block:
    """Documents' tokens by the words' numbers, and what of them goes to which shard."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, stream: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
        """numbers: rising, with each word's training count; stream: places in them."""
        self.numbers, self.counts = numbers.astype(np.int64), counts.astype(np.float64)
        self.stream, self.sizes, self.train = stream.astype(np.int64), sizes.astype(np.int64), train.astype(bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learned = np.repeat(self.train, self.sizes)

    def contexts(self, start: int) -> None:
        """The words before each token; the first of a text has the start alone before it."""
        place = int(np.searchsorted(self.numbers, start))
        self.v = np.append(place, self.stream[:-1])
        self.v[self.starts] = place
        self.u = np.append(place, self.v[:-1])
        first = np.zeros(len(self.stream), bool)
        first[self.starts] = True
        self.inner = np.flatnonzero(~first)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of the contexts u v."""
        own = self.inner[self.learned[self.inner]]
        return np.unique(self.numbers[self.u[own]] << 32 | self.numbers[self.v[own]], return_counts=True)

    def grams(self, shards: int, hot: Hot) -> None:
        """Sort the distinct trigrams and the bigrams of hot words by shard. Of all others the shard has the bigrams from the trigrams."""
        self.contexts(hot.start)
        h = mix(self.numbers.astype(np.uint64) + _M)
        n = np.uint64(shards)
        self.hot_count = Hot.count_of(self.numbers, hot.words, hot.word_counts)
        is_hot = self.hot_count >= 0
        inner = self.inner
        tri = Grams(self.v[inner], self.u[inner], self.stream[inner])
        self.pair_of = tri.pair_of[tri.of]
        self.pair_hot = Hot.count_of(self.numbers[tri.pu] << 32 | self.numbers[tri.pv], hot.pairs, hot.pair_counts)
        spread = self.pair_hot >= 0
        pair_shard = np.where(is_hot[tri.pv], mix(h[tri.pv] * _M + h[tri.pu]) % n, h[tri.pv] % n)
        shard = np.where(spread[tri.pair_of], mix(mix(h[tri.v] * _M + h[tri.u]) + h[tri.w]) % n, pair_shard[tri.pair_of]).astype(np.int64)
        order, back = _by_shard(shard)
        self.tri_of = back[tri.of]
        self.tri = tri.v[order], tri.u[order], tri.w[order], tri.sums(self.learned[inner]).astype(np.int64)[order], shard[order]
        # Contexts u v that aren't hot, by shard.
        quiet = np.flatnonzero(~spread)
        quiet = quiet[np.argsort(pair_shard[quiet], kind="stable")]
        self.pair_place = np.full(len(spread), -1)
        self.pair_place[quiet] = np.arange(len(quiet))
        # Bigrams of hot words and of the start.
        loud = is_hot[self.v]
        self.loud = np.flatnonzero(loud)
        bi, which = np.unique(self.v[self.loud] << 32 | self.stream[self.loud], return_inverse=True)
        bv, bw = bi >> 32, bi & _LOW
        shard = (mix(h[bv] * _M2 + h[bw]) % n).astype(np.int64)
        order, back = _by_shard(shard)
        self.loud_of = back[which]
        self.bi = bv[order], bw[order], np.bincount(which[self.learned[self.loud]], minlength=len(bi))[order], shard[order]
        # Bigrams of other words, and these words, by shard.
        self.soft = np.flatnonzero(~loud)
        soft, which = np.unique(self.v[self.soft] << 32 | self.stream[self.soft], return_inverse=True)
        of = soft >> 32
        self.soft_of = _by_shard((h[of] % n).astype(np.int64))[1][which]
        heads = of[np.append(True, of[1:] != of[:-1])[: len(of)]]
        heads = heads[np.argsort((h[heads] % n).astype(np.int64), kind="stable")]
        self.head_place = np.full(len(self.numbers), -1)
        self.head_place[heads] = np.arange(len(heads))

    def messages(self, shards: int) -> Iterator[tuple[int, bytes]]:
        every = np.arange(shards)
        a, b = np.searchsorted(self.tri[4], every), np.searchsorted(self.tri[4], every, side="right")
        c, d = np.searchsorted(self.bi[3], every), np.searchsorted(self.bi[3], every, side="right")
        tri, bi = [*(self.numbers[x] for x in self.tri[:3]), self.tri[3]], [*(self.numbers[x] for x in self.bi[:2]), self.bi[2]]
        for s in np.flatnonzero((a < b) | (c < d)).tolist():
            yield s, pack([*(x[a[s] : b[s]] for x in tri), *(x[c[s] : d[s]] for x in bi)], rising=(0, 4))


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard, and each one's place in it."""
    order = np.argsort(shard, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return order, back


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, ids, body (hashes, training counts, stream, sizes, train), and the numbers of tokens, of training tokens and of training documents."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        if len(_KNOWN) > MOST_WORDS_KNOWN:
            _KNOWN.clear()
        ids = [x for p in parts for x in p.column("doc_id").to_pylist()]
        train = np.array([not held_out_id(i, MODULUS) for i in ids])
        streams = []
        for p in parts:
            for text in p.column("text"):
                w = (text.as_py() or "").encode().lower().split()
                s = np.empty(len(w) + 1, np.uint64)
                s[:-1] = np.fromiter(map(_KNOWN.__getitem__, w), np.uint64, len(w))
                s[-1] = END
                streams.append(s)
        sizes = np.array([len(s) for s in streams])
        words, stream = np.unique(np.concatenate([*streams, np.array([START], np.uint64)]), return_inverse=True)
        stream = stream[:-1]
        counts = np.bincount(stream[np.repeat(train, sizes)], minlength=len(words))
        body = pack([words, counts, stream, sizes, train], rising=(0,))
        facts = [len(stream), int(sizes[train].sum()), int(train.sum())]
        columns = [pa.array([task << 32 | number], pa.int64()), pa.array([ids], pa.list_(parts[0].column("doc_id").type)), pa.array([body], pa.binary()), *(pa.array([x], pa.int64()) for x in facts)]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "body", "tokens", "learned", "documents"])

    for part in slices(batches, "text", BLOCK_BYTES, 1 << 20):
        held.append(part)
        size += part.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield block(held)
            number, held, size = number + 1, [], 0
    if held:
        yield block(held)
    _KNOWN.clear()


_SENT = "block long, shard int, body binary"


def _sends(messages: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the blocks send to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for this, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                found = list(messages(body.as_py()))
                columns = [pa.array([this] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([m for _, m in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "body"])

    return freed(run)


def _word_shards(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' order by shard, and their shards in it."""
    shard = (mix(words) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _word_messages(shards: int) -> Callable[[bytes], Iterator[tuple[int, bytes]]]:
    def messages(body: bytes) -> Iterator[tuple[int, bytes]]:
        words, counts = unpack(body)[:2]
        order, shard = _word_shards(words, shards)
        every = np.arange(shards)
        a, b = np.searchsorted(shard, every), np.searchsorted(shard, every, side="right")
        for s in np.flatnonzero(a < b).tolist():
            yield s, pack([words[order[a[s] : b[s]]], counts[order[a[s] : b[s]]]], rising=(0,))

    return messages


def _count_words(shards: int, hot: int) -> Callable[[pa.Table], pa.Table]:
    """A shard of words: counts over all blocks and numbers for each block, the number of types, and the words with at least so many (number, count, whether it is the start)."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in t["body"]]
        words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(which, np.concatenate([p[1] for p in parts]).astype(np.float64), len(words)).astype(np.int64)
        numbers = np.empty(len(words), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * shards + t["shard"][0].as_py()
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        answers = [pack([c, x]) for c, x in zip(np.split(counts[which], cuts), np.split(numbers[which], cuts), strict=True)]
        n = len(parts)
        is_start = words == np.uint64(START)
        often = np.flatnonzero((counts >= hot) | is_start)
        lists = [[[int(numbers[i]), int(counts[i]), int(is_start[i])] for i in often]] + [[]] * (n - 1)
        out = [t["block"], t["shard"], pa.array(answers, pa.binary()), pa.array([int((counts > 0).sum())] + [0] * (n - 1), pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64())))]
        give_back()
        return pa.table(out, ["block", "shard", "body", "types", "often"])

    return run


def _parts(t: pa.Table) -> tuple[pa.Scalar, list[bytes]]:
    """A block's ids, and its body with the answers of the shards after it, in their order."""
    rows = sorted(zip(t["shard"].to_pylist(), range(len(t)), strict=True))
    return t["ids"][rows[0][1]], [t["body"][i].as_py() for _, i in rows]


def _numbered(shards: int) -> Callable[[pa.Table], pa.Table]:
    """A block with its words by number, frequent ones first."""

    def run(t: pa.Table) -> pa.Table:
        ids, bodies = _parts(t)
        words, _, stream, sizes, train = unpack(bodies[0])
        order, _ = _word_shards(words, shards)
        answers = [unpack(b) for b in bodies[1:]]
        counts, numbers = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
        by_number = np.argsort(numbers)
        place = np.empty(len(words), np.int64)
        place[order[by_number]] = np.arange(len(words))
        body = pack([numbers[by_number], counts[by_number], place[stream.astype(np.int64)], sizes, train], rising=(0,))
        out = pa.table([t["block"].slice(0, 1), pa.array([ids.as_py()], ids.type), pa.array([body], pa.binary())], ["block", "ids", "body"])
        give_back()
        return out

    return run


def _pairs(start: int, least: float, known: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key and n of the contexts u v with this share of a block's training tokens, or of the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                block = Block(*unpack(body.as_py()))
                block.contexts(start)
                keys, n = block.pair_counts()
                keep = n >= least * block.learned.sum() if known is None else np.isin(keys, known)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(n[keep], pa.int64())], ["key", "n"])

    return freed(run)


def _answer(hot: Hot) -> Callable[[pa.Table], pa.Table]:
    """A shard: add the counts of all blocks, build the trie, answer each block."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in t["body"]]
        v, u, w, n, bv, bw, bn = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(7))
        tri_cuts, bi_cuts = np.cumsum([len(p[0]) for p in parts])[:-1], np.cumsum([len(p[4]) for p in parts])[:-1]
        del parts
        tri = Grams(v, u, w)
        tri_n = tri.sums(n)
        del v, u, w, n
        pair_hot = Hot.count_of(tri.pu << 32 | tri.pv, hot.pairs, hot.pair_counts)
        pair_n = np.where(pair_hot >= 0, pair_hot, np.bincount(tri.pair_of, tri_n, len(tri.pv)))
        quiet = np.flatnonzero(Hot.count_of(tri.v, hot.words, hot.word_counts) < 0)
        bi, bi_of = np.unique(np.concatenate((tri.v[quiet] << 32 | tri.w[quiet], bv << 32 | bw)), return_inverse=True)
        bi_n = np.bincount(bi_of, np.concatenate((tri_n[quiet], bn)), len(bi))
        bv, bw = bi >> 32, bi & _LOW
        heads = np.unique(np.concatenate((tri.pv, bv)))
        own = Hot.count_of(heads, hot.words, hot.word_counts)
        head_n = np.where(own >= 0, own, np.bincount(np.searchsorted(heads, bv), bi_n, len(heads)))
        trie = Trie(tri, tri_n, pair_n, bv, bw, bi_n, heads, head_n)
        # Each distinct n-gram is looked up once.
        before = trie.before.places(trie.head(tri.pv), tri.pu)
        tri_code = trie.third.code(trie.third.places(before[tri.pair_of], tri.w), 0)
        pair_code = trie.before.code(before, 255)
        above = trie.head(bv)
        bi_code = trie.successors.code(trie.successors.places(above, bw), 0)
        # Of each block's n-grams, in its order: trigrams; contexts u v; bigrams and contexts of words that aren't hot; bigrams of hot ones.
        soft_of = np.full(len(tri.v), -1)
        soft_of[quiet] = bi_of[: len(quiet)]
        answers = []
        for mine, loud in zip(np.split(tri.of, tri_cuts), np.split(bi_code[bi_of[len(quiet) :]], bi_cuts), strict=True):
            pair = tri.pair_of[mine]
            pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
            soft = soft_of[mine]
            soft = np.unique(soft[soft >= 0])
            of = above[soft]
            of = of[np.append(True, of[1:] != of[:-1])[: len(of)]]
            answers.append(pack([tri_code[mine], pair_code[pair[pair_hot[pair] < 0]], bi_code[soft], trie.head_codes[of], loud]))
        out = pa.table([t["block"], t["shard"], pa.array(answers, pa.binary())], ["block", "shard", "body"])
        give_back()
        return out

    return run


def _finish(shards: int, hot: Hot, tokens: int, types: int) -> Callable[[pa.Table], pa.Table]:
    """Put a block together with its answers and score its documents."""

    def run(t: pa.Table) -> pa.Table:
        ids, bodies = _parts(t)
        block = Block(*unpack(bodies[0]))
        block.grams(shards, hot)
        answers = [unpack(b) for b in bodies[1:]]
        tri, pair, soft, head, loud = (np.concatenate([a[k] for a in answers]) if answers else np.zeros(0, np.uint64) for k in range(5))
        c = block.counts[block.stream]
        p1 = (c + ADDED) / (tokens + ADDED * (types + 1))
        a2, b2 = np.zeros(len(c)), np.ones(len(c))
        a2[block.loud] = decoded(loud)[block.loud_of]
        a2[block.soft] = decoded(soft)[block.soft_of]
        b2[block.loud] = weight(weight_code(weights(block.hot_count[block.v[block.loud]])))
        b2[block.soft] = weight(head)[block.head_place[block.v[block.soft]]]
        p = a2 + b2 * p1
        a3, b3 = decoded(tri)[block.tri_of], weight(weight_code(weights(np.maximum(block.pair_hot, 0))))
        b3[block.pair_place >= 0] = weight(pair)[block.pair_place[block.pair_place >= 0]]
        p[block.inner] = a3 + b3[block.pair_of] * p[block.inner]
        base, score = np.add.reduceat(np.log10(p1), block.starts), np.add.reduceat(np.log10(p), block.starts)
        known = np.add.reduceat((c > 0).astype(np.int64), block.starts)
        out = {"doc_id": pa.array(ids.as_py(), ids.type.value_type), "held_out": ~block.train, "n_tokens": block.sizes, "n_known": known, "train_tokens": np.full(len(block.sizes), tokens), "base_score": base, "score": score}
        del block, answers
        give_back()
        return pa.table(out)

    return run


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    kind = dict(documents.dtypes)["doc_id"]
    held = f"block long, ids array<{kind}>, body binary"
    hashed = written(documents.select("doc_id", "text").mapInArrow(freed(_blocks), held + ", tokens long, learned long, documents long"), "hashed")
    facts = hashed.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "learned", "documents"))).first()
    shards = max(1, -(-facts["tokens"] // SHARD_TOKENS))
    word_shards = -(-shards // WORDS_FACTOR)
    # Shares of tokens from which on contexts are dealt over shards; the lists of them are bounded by their inverse.
    share = min(HOT_SHARE, 1 / (4 * shards))
    least = max(1, int(share * facts["learned"]))
    words = hashed.select("block", "body").mapInArrow(_sends(_word_messages(word_shards)), _SENT).groupBy("shard")
    words = written(words.applyInArrow(_count_words(word_shards, least), _SENT + ", types long, often array<array<long>>"), "words")
    types = words.agg(F.sum("types").alias("types")).first()["types"] or 0
    often = sorted(tuple(r["x"]) for r in words.where("size(often) > 0").select(F.explode("often").alias("x")).collect())
    none = F.lit(None).cast(f"array<{kind}>").alias("ids")
    first = F.lit(-1).alias("shard")
    rows = hashed.select("block", first, "ids", "body").union(words.select("block", "shard", none, "body"))
    blocks = written(rows.groupBy("block").applyInArrow(_numbered(word_shards), held), "blocks")
    unwritten(hashed)
    unwritten(words)
    bodies = blocks.select("block", "body")
    start = next((x for x, _, is_start in often if is_start), 0)
    # A pair with this share of all has a fourth of it in blocks that hold three quarters of its occurrences.
    found = bodies.mapInArrow(_pairs(start, share / 4, None), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= 0.75 * share * facts["learned"])
    keys = np.array([r["key"] for r in found.collect()], np.int64)
    pairs = sorted(tuple(r) for r in bodies.mapInArrow(_pairs(start, 0, keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()) if len(keys) else []
    column = lambda rows, k: np.array([r[k] for r in rows], np.int64)
    counts = np.array([facts["documents"] if is_start else n for _, n, is_start in often], np.int64)
    hot = Hot(start, column(often, 0), counts, column(pairs, 0), column(pairs, 1))

    def messages(body: bytes) -> Iterator[tuple[int, bytes]]:
        block = Block(*unpack(body))
        block.grams(shards, hot)
        return block.messages(shards)

    answers = written(bodies.mapInArrow(_sends(messages), _SENT).groupBy("shard").applyInArrow(_answer(hot), _SENT), "answers")
    rows = blocks.select("block", first, "ids", "body").union(answers.select("block", "shard", none, "body"))
    return rows.groupBy("block").applyInArrow(_finish(shards, hot, facts["learned"], types), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
