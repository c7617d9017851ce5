"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A partition's distinct words go to an in-process DuckDB as token-position rows. The recursive query joins neighbouring
tokens with the merge table and contracts each word's leftmost pair of minimum rank until no pair is left; ordered
aggregation makes the words' id lists, and decodes ids to bytes. A word that is a token itself is not contracted, as
the public library has it.

One pair at a time is quadratic in a word, so words over SHORT bytes are contracted by neighbourhoods: a step contracts
every pair that has the minimum rank, leftmost, of all pairs that could ever reach one of its tokens. What can reach a
place is known from the tokens that occur in the word's bytes across that place, so the result is that of contracting
one at a time. Pairs of one rank that overlap in a chain (a run of one sign) are contracted by turns, where no pair that
is made can come before them. The recursion keeps one row for a position. A word of any length goes through in blocks:
at a block's end an unknown pair that precedes all others stops whatever it could reach, and that goes into the next.

Texts are cut at spaces that stand before a non-space, where no match of the pattern can cross, and what a piece
encodes to is remembered in a bounded cache, so a frequent word costs one lookup. No shuffle; memory is bounded by the
cache, a slice of texts and DuckDB's limit, and all is given back at a partition's end but the vocabulary's tables.

Defined results: null text encodes to no ids; null ids decode to null bytes. Repeated rows give equal rows; columns
beside those named aren't read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.shared import give_back, slices, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words of so many bytes at most are contracted one pair at a time; of them a query takes so many rows over all its steps.
SHORT = 256
ROWS_PER_QUERY = 1_500_000
#: Longer ones by neighbourhoods, so many bytes at a time.
BLOCK = 100_000
#: Words a worker remembers, and a fifth as many parts of texts; it starts anew beyond them.
WORD_CACHE = 1_000_000
DUCKDB_MB = 250
#: Text that is encoded at a time.
SLICE_BYTES = 6 << 20

#: A space that doesn't start a word: the text is then matched as a whole.
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")

# init: word w's tokens at pos, with the next token (nxt) and its place (npos). A step finds each word's best pair,
# its rank above its place above its right neighbour's place, so that min() takes the leftmost pair of minimum rank.
CONTRACT = """
WITH RECURSIVE s(step, w, pos, tok, npos, nxt) AS (
  SELECT 0, w, pos, tok, npos, nxt FROM init
  UNION ALL
  (WITH best AS (
     SELECT w, min((id::BIGINT << 40) | (pos::BIGINT << 20) | npos) AS m FROM s JOIN merges ON l = tok AND r = nxt GROUP BY w),
   cut AS (
     SELECT best.w, ((m >> 20) & 1048575)::INT AS spot, (m & 1048575)::INT AS gone, (m >> 40)::INT AS made, s.npos AS npos2, s.nxt AS nxt2
     FROM best JOIN s ON s.w = best.w AND s.pos = (m & 1048575))
   SELECT step + 1, w, pos,
     CASE WHEN pos = spot THEN made ELSE tok END,
     CASE WHEN pos = spot THEN npos2 ELSE npos END,
     CASE WHEN pos = spot THEN nxt2 WHEN npos = spot THEN made ELSE nxt END
   FROM s JOIN cut USING (w) WHERE pos <> gone))
SELECT w, list(tok ORDER BY pos) AS ids
FROM s JOIN (SELECT w AS w2, max(step) AS last FROM s GROUP BY w) ON w = w2 AND step = last
GROUP BY w
"""
# As above; lo and hi: how far tokens reach across the token's start and its end. edges: a block's end in word w.
NEIGHBOURHOODS = """
WITH RECURSIVE s(w, pos, tok, npos, nxt, lo, hi) USING KEY (w, pos) AS (
  SELECT w, pos, tok, npos, nxt, lo, hi FROM init
  UNION
  (WITH pairs AS (
     SELECT a.w, a.pos, a.npos, id, calm, a.lo, b.hi, (id::BIGINT << 32) | a.pos AS m
     FROM recurring.s a JOIN merges ON l = a.tok AND r = a.nxt JOIN recurring.s b ON b.w = a.w AND b.pos = a.npos
     UNION ALL SELECT w, pos, pos, -1, false, pos, pos, -1 FROM edges),
   near AS (
     SELECT *, min(m) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN pos - lo PRECEDING AND hi - pos FOLLOWING) AS least,
       CASE WHEN lag(npos) OVER before = pos AND lag(id) OVER before = id THEN 0 ELSE 1 END AS opens
     FROM pairs WINDOW before AS (PARTITION BY w ORDER BY pos)),
   chains AS (SELECT *, sum(opens) OVER (PARTITION BY w ORDER BY pos) AS chain FROM near),
   turns AS (
     SELECT *, row_number() OVER c AS turn, bool_and(least >> 32 = id) OVER c AS clear
     FROM chains WINDOW c AS (PARTITION BY w, chain ORDER BY pos)),
   cut AS (SELECT w, pos AS spot, npos AS gone, id AS made FROM turns WHERE id >= 0 AND (m = least OR calm AND clear AND turn % 2 = 1))
   SELECT x.w, x.pos, CASE WHEN c.w IS NOT NULL THEN c.made WHEN g.w IS NOT NULL THEN -1 ELSE x.tok END,
     CASE WHEN c.w IS NOT NULL THEN y.npos ELSE x.npos END,
     CASE WHEN c.w IS NOT NULL THEN coalesce(after.made, y.nxt) ELSE coalesce(here.made, x.nxt) END,
     x.lo, CASE WHEN c.w IS NOT NULL THEN y.hi ELSE x.hi END
   FROM recurring.s x LEFT JOIN cut c ON c.w = x.w AND c.spot = x.pos LEFT JOIN cut g ON g.w = x.w AND g.gone = x.pos
     LEFT JOIN cut here ON here.w = x.w AND here.spot = x.npos
     LEFT JOIN recurring.s y ON y.w = c.w AND y.pos = c.gone LEFT JOIN cut after ON after.w = c.w AND after.spot = y.npos
   WHERE x.tok >= 0 AND (c.w IS NOT NULL OR g.w IS NOT NULL OR here.w IS NOT NULL)))
SELECT w, pos, tok, npos, lo, hi, id IS NOT NULL AS open FROM s LEFT JOIN merges ON l = tok AND r = nxt WHERE tok >= 0 ORDER BY w, pos
"""
DECODE = "SELECT d, list(b ORDER BY pos) AS parts FROM rows_ JOIN vocab USING (id) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _byte_offsets(tokens: pa.Array, lists: pa.Array) -> np.ndarray:
    """Where each list's bytes begin in the tokens' buffer."""
    at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return at[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def vocabulary(ranks: dict[bytes, int]) -> tuple[pa.Table, pa.Table]:
    """Which two tokens make which (calm: no pair with that one makes a token of a lower rank), and the tokens' bytes."""
    pairs = [(a, b, i) for token, i in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
    l, r, made = (np.array(x, np.int32) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
    loud = np.concatenate((l[l > made], r[r > made]))
    return pa.table({"l": l, "r": r, "id": made, "calm": ~np.isin(made, loud)}), pa.table({"id": pa.array(ranks.values(), pa.int32()), "b": pa.array(ranks, pa.binary())})


class Codec:
    """The tables of a vocabulary in DuckDB, and what pieces encoded to before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = WORD_CACHE, tables: tuple[pa.Table, pa.Table] | None = None) -> None:
        self.cache, self.ranks, self.match = cache, ranks, regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}  # to their ids, four bytes each
        self.parts: dict[str, tuple[int, str, bytes]] = {}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.longest = max(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": ""})
        merges, vocab = tables or vocabulary(ranks)  # noqa: F841
        self.db.sql("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.sql("CREATE TABLE vocab AS SELECT * FROM vocab")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and each word's end in them."""
        ranks = self.ranks
        given = [ranks.get(w, -1) for w in words]
        known = [i for i, x in enumerate(given) if x >= 0]
        owners, flat = [np.array(known, np.int64)], [np.array([given[i] for i in known], np.int32)]
        todo = [i for i, x in enumerate(given) if x < 0]
        short = sorted((i for i in todo if len(words[i]) <= SHORT), key=lambda i: len(words[i]))
        for part in _portions(short, [len(words[i]) * (len(words[i]) + 1) // 2 for i in short], ROWS_PER_QUERY):
            found = self._contracted([words[i] for i in part])
            owners.append(np.array(part)[found[0]])
            flat.append(found[1])
        long = [i for i in todo if len(words[i]) > SHORT]
        for part in _portions(long, [len(words[i]) for i in long], BLOCK):
            own = [words[i] for i in part]
            found = self._in_blocks(own[0]) if len(own[0]) > BLOCK else self._by_neighbourhoods(own)
            owners.append(np.array(part)[found[0]])
            flat.append(found[1])
        owner, ids = np.concatenate(owners), np.concatenate(flat)
        return ids[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(words)))

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The word and the id of every token."""
        w, pos, tok, nxt = self._rows(words)
        init = pa.table({"w": w, "pos": pos, "tok": tok, "npos": pos + 1, "nxt": nxt})  # noqa: F841
        found = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
        ids = found["ids"].chunk(0)
        return np.repeat(found["w"].to_numpy(), np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy()

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Word, place, token and next token (-1 at a word's end) of every byte."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[ends - 1] = -1
        return np.repeat(np.arange(len(words), dtype=np.int32), sizes), (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32), tok, nxt

    def _reach(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each place in a word the first start and the last end of all tokens that occur across it, itself without any."""
        n, ranks = len(word), self.ranks
        here = np.arange(n + 1, dtype=np.int32)
        lo, hi = here.copy(), here.copy()
        for size in range(2, min(n, self.longest) + 1):
            at = np.flatnonzero(np.fromiter((word[i : i + size] in ranks for i in range(n - size + 1)), bool, n - size + 1))
            hi[at + 1] = np.maximum(hi[at + 1], at + size)
            lo[at + size - 1] = np.minimum(lo[at + size - 1], at)
        return np.minimum(np.minimum.accumulate(lo[::-1])[::-1], here), np.maximum(np.maximum.accumulate(hi), here)

    def _settled(self, init: pa.Table, edges: list[int]) -> pa.Table:
        edges = pa.table({"w": pa.array([0] * len(edges), pa.int32()), "pos": pa.array(edges, pa.int32())})  # noqa: F841
        return self.db.sql(NEIGHBOURHOODS).to_arrow_table().combine_chunks()

    def _by_neighbourhoods(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w, pos, tok, nxt = self._rows(words)
        spans = [self._reach(x) for x in words]
        found = self._settled(pa.table({"w": w, "pos": pos, "tok": tok, "npos": pos + 1, "nxt": nxt, "lo": np.concatenate([a[:-1] for a, _ in spans]), "hi": np.concatenate([b[1:] for _, b in spans])}), [])
        return found["w"].to_numpy(), found["tok"].to_numpy()

    def _in_blocks(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """One long word: what a block's end can't reach is settled, the rest goes on, as far as contracted, with the next block."""
        lo, hi = self._reach(word)
        out, at, block = [], 0, BLOCK
        held = {k: np.zeros(0, np.int32) for k in ("pos", "tok", "npos", "lo", "hi")}
        while at < len(word):
            stop = min(len(word), at + block)
            fresh = np.arange(at, stop, dtype=np.int32)
            new = {"pos": fresh, "tok": self.byte_ids[np.frombuffer(word, np.uint8)[at:stop]], "npos": fresh + np.int32(1), "lo": lo[at:stop], "hi": hi[at + 1 : stop + 1]}
            rows = {k: np.concatenate((held[k], new[k])) for k in held}
            nxt = np.append(rows["tok"][1:], np.int32(-1))
            found = self._settled(pa.table({"w": np.zeros(len(nxt), np.int32), **rows, "nxt": nxt}), [stop] if stop < len(word) else [])
            rows = {k: found[k].to_numpy() for k in held}
            at = stop
            if at < len(word):
                open_ = np.flatnonzero(found["open"].to_numpy(zero_copy_only=False))
                first = min(rows["pos"][open_[0]] if len(open_) else stop, rows["pos"][-1])  # the last token may meet the next block's
                done = int(np.searchsorted(rows["npos"], lo[first], side="right"))
            else:
                done = len(rows["pos"])
            out.append(rows["tok"][:done])
            held = {k: v[done:] for k, v in rows.items()}
            block = max(BLOCK, len(held["pos"]))  # where much is held, blocks grow
        ids = np.concatenate(out)
        return np.zeros(len(ids), np.int32), ids

    def decode_flat(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids, by ordered aggregation."""
        out = [b""] * len(ends)
        if len(flat):
            rows_ = pa.table({"d": np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), "pos": np.arange(len(flat)), "id": flat})  # noqa: F841
            found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
            parts = found["parts"].chunk(0)
            tokens = parts.flatten()
            joined = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(_byte_offsets(tokens, parts)), tokens.buffers()[2]])
            for d, back in zip(found["d"].to_pylist(), joined.to_pylist(), strict=True):
                out[d] = back
        return out

    def decode_lists(self, lists: list[list[int] | None]) -> list[bytes | None]:
        """The bytes of each list of ids; null for null."""
        back = self.decode_flat(np.fromiter((i for x in lists for i in x or ()), np.int32), np.cumsum([len(x or ()) for x in lists]))
        return [None if x is None else b for x, b in zip(lists, back, strict=True)]

    def split(self, text: str) -> list[str]:
        """Cut where no match crosses: each part but the first starts with its space."""
        if LOOSE_SPACE.search(text):
            return self.match(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, parts: set[str]) -> None:
        """Encode parts that aren't known yet, and decode what they encoded to."""
        new = [x for x in parts if x not in self.parts]
        found = [self.match(x) for x in new]
        fresh = list({w for words in found for w in words if w not in self.words})
        flat, ends = self.encode_words([w.encode() for w in fresh])
        raw, stops = flat.tobytes(), (4 * ends).tolist()
        self.words.update((w, raw[a:b]) for w, a, b in zip(fresh, [0, *stops], stops, strict=False))
        ids = self.words
        own = [ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for words in found]
        flat, ends = np.frombuffer(b"".join(own), np.int32), np.cumsum([len(x) // 4 for x in own])
        text, stops = list(map(str, flat.tolist())), ends.tolist()
        for x, a, b, back in zip(new, [0, *stops], stops, self.decode_flat(flat, ends), strict=False):
            self.parts[x] = (b - a, ",".join(text[a:b]), back)

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its parts' numbers of ids, ids and decoded bytes."""
        cut = [self.split(x) if x else [] for x in texts]
        if len(self.parts) > self.cache // 5:
            self.parts.clear()
        if len(self.words) > self.cache:
            self.words.clear()
        self.learn({x for parts in cut for x in parts})
        get = self.parts.__getitem__
        return [list(map(get, parts)) for parts in cut]


_VOCABULARIES: dict[str, tuple[dict[bytes, int], tuple[pa.Table, pa.Table]]] = {}


@contextmanager
def codec(path: str, pattern: str, cache: int = WORD_CACHE) -> Iterator[Codec]:
    """A partition's codec. A worker keeps the vocabulary; words, parts and DuckDB's memory are given back."""
    if path not in _VOCABULARIES:
        ranks = read_ranks(path)
        _VOCABULARIES.clear()
        _VOCABULARIES[path] = ranks, vocabulary(ranks)
    ranks, tables = _VOCABULARIES[path]
    own = Codec(ranks, pattern, cache, tables)
    collects = gc.isenabled()
    gc.disable()  # the caches hold millions of entries and no cycles
    try:
        yield own
    finally:
        own.db.close()
        own.words, own.parts = {}, {}
        if collects:
            gc.enable()
        give_back()


def _portions(items: list[int], costs: list[int], most: int) -> Iterator[list[int]]:
    """Runs of items that cost no more than most together; one that costs more is alone."""
    part, total = [], 0
    for i, n in zip(items, costs, strict=True):
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append(i)
        total += n
    if part:
        yield part


def encode(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, cache: int = WORD_CACHE) -> DataFrame:
    """doc_id, ids (array of int) and decoded_sha256, the digest of the bytes they decode to. path: of a rank file, which every executor has at that place.

    cache: a smaller one trades time for the workers' memory.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern, cache) as own:
            for batch in slices(batches, "text", min(SLICE_BYTES, 16 * cache)):
                found = own.encode(batch.column("text").to_pylist())
                ids = [np.fromstring(",".join(p[1] for p in parts if p[0]), np.int32, sep=",") for parts in found]
                back = [hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest() for parts in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and bytes, of doc_id and ids."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for part in slices(batches, "ids", SLICE_BYTES, item_bytes=4):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.decode_lists(part.column("ids").to_pylist()), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def digests(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Counts and digests of the ids and of the bytes they decode to."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in slices(batches, "text", SLICE_BYTES):
                found = own.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([sum([p[0] for p in parts]) for parts in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest() for parts in found], pa.string()),
                        pa.array([hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest() for parts in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
