"""N-gram Jaccard join: size-aware heavy-light set similarity.

Documents become sets of hashed three-word shingles; equal sets are one class. Two classes link when
100 * intersection >= 90 * union. Candidates come by size:

* Light pairs (both sets at most light_bound(), where enumerating costs less than lists): sets of sizes a and b must
  share i = ceil(90 (a + b) / 190) shingles, so both enumerate their subsets of exactly i shingles and meet in one.
* Heavy pairs: linked sets differ in at most (a + b) / 19 shingles. The hash space is cut into more parts than that,
  by size class, so linked sets agree on a whole part; a part's shingles make one posting key. Parts with few shingles
  are left out where so many agree that one of the others must, so keys of a common line or passage are rare.

That is op5_jaccard_join's rule. The pipeline's stage links by other numbers of words and least similarities; there, pairs
come by rare shingles (rare_keys()): a linked set shares all but n - ceil(least * n) of its n shingles, so one that has more
of them alone links with nothing, and of any other the rarest n - ceil(least * n) + 1 hold one that both have.

Keys that two classes share join them to loose groups (stars around the smallest class, so a key shared by many costs
a row each). Within a loose group pivots scan the inverted lists of the members' shingles, which counts intersections
exactly. All members of a group up to PIVOTS are pivots. A larger group is dealt into chunks, each of which meets the
pivots; rounds go on until every member outside the group's largest component has been a pivot, so no link between
different components stays untested, and no task holds a whole large group. Only a spanning forest of links is kept.

Defined results: null text, or text without words, has no shingles and is linked with nothing (not even its like);
fewer words than a shingle has are one shingle. Sets, shingles and keys are 64-bit hashes. Repeated rows are equal sets; rows
with a null doc_id count as documents of their own class and never name a component unless all are null. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docloom.llm.graph import components
from docloom.llm.shared import free_name, freed, give_back, slices, spread, table, unwritten, written

WORDS = 3
NUMERATOR, DENOMINATOR = 90, 100
PIVOTS = 64
LATER_PIVOTS = 1024
CHUNK = 256
#: Shingles of pivots and of members that a task holds; a group of larger sets has fewer pivots in a round, one at least.
PIVOT_SHINGLES = 4_000_000
SCANNED = 500_000
#: Members that are compared with the pivots at once, and places in the lists that are looked at at once.
MEMBERS = 512
POSTINGS = 2_000_000
#: One of so many shingles is counted to find the sets that have too many alone.
SAMPLE = 4
#: Ids of documents with candidates are broadcast up to this many; beyond it they join by a shuffle.
BROADCAST_ROWS = 2_000_000
MOST_WORDS_KNOWN = 250_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxh3_64_intdigest(word)
        return value


_KNOWN = _Words()


def _forgetting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the known words and all its memory given back at a partition's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _KNOWN.clear()
            give_back()

    return whole


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    if len(_KNOWN) > MOST_WORDS_KNOWN:
        _KNOWN.clear()
    out = []
    for text in texts:
        parts = (text or "").encode().lower().split()
        w = np.fromiter(map(_KNOWN.__getitem__, parts), np.uint64, len(parts))
        if not len(w):
            out.append(w)
            continue
        k = min(words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h * _M1 + w[i : len(w) - k + 1 + i])
        out.append(np.unique(h))
    return out


def overlap(a: int, b: int) -> int:
    """The fewest shared shingles of linked sets of these sizes."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def partners(n: int) -> range:
    """Sizes of sets that a set of n can link with."""
    return range(-(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR + 1)


@cache
def subsets_of(n: int) -> int:
    return sum(comb(n, overlap(n, b)) for b in partners(n) if overlap(n, b) <= min(n, b))


@cache
def slots() -> list[tuple[int, int, int, int]]:
    """Size classes: smallest size, first size beyond, parts, and how many parts may be left out."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, DENOMINATOR * DENOMINATOR * low // (NUMERATOR * NUMERATOR) + 1)
        largest = high - 1
        both = largest + DENOMINATOR * largest // NUMERATOR
        differ = both * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        spare = differ // 8 + 1
        out.append((low, high, differ + 1 + spare, spare))
        low = high
    return out


_HIGHS: list[int] = []


def slots_of(n: int) -> list[int]:
    """The classes whose pairs a set of n can be in: its own as the smaller, the one below as the larger."""
    if not _HIGHS:
        _HIGHS.extend(s[1] for s in slots())
    own = int(np.searchsorted(_HIGHS, n, side="right"))
    below = own - 1
    return [own, below] if below >= 0 and NUMERATOR * n <= DENOMINATOR * (slots()[below][1] - 1) else [own]


@cache
def light_bound() -> int:
    """The largest size up to which enumerating subsets makes fewer keys than parts do, a probe of a list counted as 4."""
    n = 1
    while subsets_of(n + 1) <= 4 * sum(slots()[j][2] for j in slots_of(n + 1)):
        n += 1
    return n


def light_keys(s: np.ndarray) -> np.ndarray:
    n, mixed = len(s), mix(s + _M1)
    total = mixed.sum(dtype=np.uint64)
    out = []
    for b in partners(n):
        i = overlap(n, b)
        if b > light_bound() or i > min(n, b):
            continue
        gone = [np.uint64(0)] if i == n else mixed if i == n - 1 else np.array([mixed[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), n - i)], np.uint64)
        tag = mix(np.array([min(n, b) << 40 | max(n, b) << 16 | i], np.uint64))
        out.append(mix((total - np.asarray(gone, np.uint64)) ^ tag))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def heavy_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' parts, and the set each is of."""
    which, slot = [], []
    for k, s in enumerate(sets):
        for j in slots_of(len(s)):
            if len(s) and not (slots()[j][1] * DENOMINATOR // NUMERATOR <= light_bound()):
                which.append(k)
                slot.append(j)
    if not which:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    which, slot = np.array(which), np.array(slot)
    sizes = np.array([len(sets[k]) for k in which])
    parts, spare = np.array([slots()[j][2] for j in slot]), np.array([slots()[j][3] for j in slot])
    data = np.concatenate([sets[k] for k in which])
    row = np.repeat(np.arange(len(which)), sizes)
    part = ((data >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    first = np.cumsum(parts) - parts
    place = first[row] + part  # rises, as the sets are sorted
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    sums = np.zeros(parts.sum(), np.uint64)
    count = np.zeros(parts.sum(), np.int64)
    sums[place[cut]] = np.add.reduceat(mix(data + _M1), cut)
    count[place[cut]] = np.diff(np.append(cut, len(place)))
    owner = np.repeat(np.arange(len(which)), parts)
    average = sizes / parts
    few = np.where(average < 5, 0, np.where(average < 6.5, 1, 2))
    weak = count <= few[owner]
    keep = ~weak | (np.bincount(owner, weak, minlength=len(which)) > spare)[owner]
    index = np.arange(len(owner)) - first[owner]
    key = mix(sums ^ mix((slot[owner] << 32 | index).astype(np.uint64) + _M3))
    return key[keep], which[owner[keep]]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([mix(mix(s + _M2).sum(dtype=np.uint64) + np.array([len(s)], np.uint64) * _M1)[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def _sampled(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Like _scan, with the sets' shingles of the sample as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            ids = set_ids(sets)
            _, once = np.unique(ids, return_index=True)
            keys = [np.zeros(0, np.uint64)] * len(sets)
            for k in once:
                keys[k] = sets[k][mix(sets[k] + _M2) % np.uint64(SAMPLE) == 0]
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids), lists], ["doc_id", "row", "n_shingles", "set_id", "keys"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: its id, size and set, and the set's keys."""
    for batch in slices(batches, "text", 4 << 20):
        sets = shingle_sets(batch.column("text").to_pylist())
        ids = set_ids(sets)
        _, once = np.unique(ids, return_index=True)
        light = [k for k in once if 0 < len(sets[k]) <= light_bound()]
        own = [light_keys(sets[k]) for k in light]
        keys, of = heavy_keys([sets[k] for k in once])
        keys, of = np.concatenate([keys, *own]), np.concatenate([once[of], np.repeat(np.array(light, np.int64), [len(x) for x in own])])
        order = np.argsort(of, kind="stable")
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(of, minlength=len(sets)))).astype(np.int32), pa.array(keys[order].view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids), lists], ["doc_id", "row", "n_shingles", "set_id", "keys"])


class _Chunk:
    """Pivots, whose shingles make the inverted lists, and the links that members have with them."""

    def __init__(self, least: tuple[int, int]) -> None:
        self.least, self.nodes, self.sets, self.parent = least, [], [], {}
        self.lists: tuple[np.ndarray, np.ndarray] | None = None

    def top(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def scan(self, nodes: list[int], sets: list[np.ndarray]) -> None:
        """Count what members share with each pivot; the pivots must be all there."""
        if not self.nodes:
            return
        if self.lists is None:
            post, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            order = np.argsort(post, kind="stable")
            self.lists = post[order], owner[order]
        post, owner = self.lists
        size, own = np.array([len(s) for s in sets]), np.array([len(s) for s in self.sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        a = np.searchsorted(post, flat, "left")
        n = np.searchsorted(post, flat, "right") - a
        shared = np.zeros(len(size) * len(own), np.int64)
        total = np.cumsum(n)
        i = 0
        while i < len(flat):  # POSTINGS of the lists at a time, as near copies share most of their shingles with all pivots
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + POSTINGS, side="right")))
            part = n[i:j]
            hit = owner[np.repeat(a[i:j] - (np.cumsum(part) - part), part) + np.arange(part.sum())]
            shared += np.bincount(np.repeat(of[i:j], part) * len(own) + hit, minlength=len(shared))
            i = j
        shared = shared.reshape(len(size), len(own))
        for i, k in zip(*np.nonzero(self.least[1] * shared >= self.least[0] * (size[:, None] + own - shared)), strict=True):
            x, y = self.top(nodes[i]), self.top(self.nodes[k])
            if x != y:
                self.parent[x] = y

    def forest(self) -> pa.RecordBatch:
        found = [(x, r) for x in self.parent if (r := self.top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _links(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, pivots first: members scan the inverted lists of the pivots; a spanning forest of the links comes out.

    A task holds the pivots of one chunk and SCANNED shingles of members.
    """
    last, chunk, nodes, sets, held = None, _Chunk(least), [], [], 0
    for batch in batches:
        keys = zip(batch.column("loose").to_pylist(), batch.column("chunk").to_pylist(), strict=True)
        lists = batch.column("shingles")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy().view(np.uint64)
        for i, (key, node, pivot) in enumerate(zip(keys, batch.column("set_id").to_pylist(), batch.column("pivot").to_pylist(), strict=True)):
            if key != last or (held > SCANNED or len(nodes) >= MEMBERS) and not pivot:
                if nodes:
                    chunk.scan(nodes, sets)
                    nodes, sets, held = [], [], 0
                if key != last:
                    yield chunk.forest()
                    last, chunk = key, _Chunk(least)
            own = flat[ends[i] : ends[i + 1]].copy()
            if pivot:
                chunk.nodes.append(node)
                chunk.sets.append(own)
            nodes.append(node)
            sets.append(own)
            held += len(own)
    if nodes:
        chunk.scan(nodes, sets)
    yield chunk.forest()


def _checked(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The sets of the chosen rows; a row that repeats a chosen doc_id with another text isn't meant."""
    for batch in slices(batches, "text", 4 << 20):
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
        names = ["loose", "chunk", "set_id", "pivot"]
        out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, "shingles"])
        yield out.filter(pa.array(set_ids(sets) == batch.column("set_id").to_numpy()))


def _round(documents: DataFrame, chosen: DataFrame, pivots: DataFrame, words: int, least: tuple[int, int]) -> tuple[DataFrame, int]:
    """Links that pivots have within their loose groups, and the number of groups in several chunks."""
    counts = written(
        chosen.groupBy("loose").agg(F.count("*").alias("members")).join(pivots.select("loose").distinct(), "loose")
        .select("loose", F.ceil(F.col("members") / CHUNK).cast("long").alias("chunks")), "counts"
    )
    home = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("chunks"))
    own = chosen.join(pivots.select("set_id", F.lit(True).alias("pivot")), "set_id", "left").join(counts, "loose")
    own = own.select("doc_id", "set_id", "loose", home.alias("chunk"), "chunks", F.coalesce("pivot", F.lit(False)).alias("pivot"))
    away = own.where("pivot AND chunks > 1").withColumn("to", F.explode(F.expr("sequence(0L, chunks - 1)"))).where("to <> chunk")
    dealt = written(own.drop("chunks").union(away.select("doc_id", "set_id", "loose", F.col("to").alias("chunk"), "pivot")), "dealt")
    small = dealt.count() <= BROADCAST_ROWS
    tasks = documents.select("doc_id", "text").join(F.broadcast(dealt) if small else dealt, "doc_id")
    tasks = tasks.mapInArrow(_forgetting(partial(_checked, words=words)), "loose long, chunk long, set_id long, pivot boolean, shingles array<long>")
    tasks = tasks.repartition("loose", "chunk").sortWithinPartitions("loose", "chunk", F.desc("pivot"))
    return tasks.mapInArrow(freed(partial(_links, least=least)), "u long, v long"), counts.where("chunks > 1").count()


def _alone(n: Column, least: tuple[int, int]) -> Column:
    """How many of n shingles a set that links with another may have alone."""
    return F.floor(n * (least[1] - least[0]) / least[1])


def _full(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """key and set_id: all shingles of the chosen rows."""
    for batch in slices(batches, "text", 2 << 20):
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        own = batch.column("set_id").to_numpy()
        sizes = np.where(set_ids(sets) == own, [len(s) for s in sets], 0)
        flat = np.concatenate([s[:n] for s, n in zip(sets, sizes, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(own, sizes))], ["key", "set_id"])


def rare_keys(scanned: DataFrame, documents: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """key and set_id: of each set that may link the rarest shingles that others have too, as many as surely hold one of a partner's.

    scanned is removed when the sampled shingles in it aren't needed any more.
    """

    def holders(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))

    sample = scanned.where("size(keys) > 0").select(F.explode("keys").alias("key"), "set_id")
    alone = holders(sample).where("low = high").groupBy(F.col("low").alias("set_id")).agg(F.count("*").alias("alone"))
    sets = scanned.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    may = sets.join(alone, "set_id", "left").where("doc_id IS NOT NULL").where(F.coalesce("alone", F.lit(0)) <= _alone(F.col("size"), least))
    open_ = written(may.select("set_id", "doc_id", "size"), "open")
    unwritten(scanned)
    small = open_.count() <= BROADCAST_ROWS
    ids = open_.select("set_id", "doc_id")
    full = documents.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id").mapInArrow(_forgetting(partial(_full, words=words)), "key long, set_id long")
    shared = spread(full, holders(full).where("low <> high").select("key", "n"), "key")
    common = shared.groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("common")).join(open_, "set_id")
    most = (_alone(F.col("size"), least) + 1 - (F.col("size") - F.size("common"))).cast("int")
    return written(common.where(most > 0).select(F.explode(F.slice("common", F.lit(1), most)).alias("k"), "set_id").select("k.key", "set_id"), "keys")


def loose_groups(scanned: DataFrame, documents: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """set_id and loose of the sets that share a key with others. scanned is removed."""
    plain = (words, least) == (WORDS, (NUMERATOR, DENOMINATOR))
    keys = scanned.where("size(keys) > 0").select(F.explode("keys").alias("key"), "set_id") if plain else rare_keys(scanned, documents, words, least)
    shared = keys.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("key", "low")
    edges = spread(keys, shared, "key").where("set_id <> low").select(F.col("set_id").alias("u"), F.col("low").alias("v"))
    found = components(edges)
    unwritten(scanned if plain else keys)
    return found.select(F.col("node").alias("set_id"), F.col("label").alias("loose"))


def linked_classes(rows: DataFrame, loose: DataFrame, documents: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """node and label of every set that links with another. rows: doc_id, set_id and n_shingles."""
    chosen = rows.where("doc_id IS NOT NULL").select("doc_id", "set_id", "n_shingles").join(loose, "set_id")
    chosen = written(chosen.groupBy("set_id", "loose").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size")), "chosen")
    links, done, state, most = None, None, chosen, PIVOTS
    while True:
        todo = state.groupBy("loose").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(PIVOT_SHINGLES) / F.max("size")))).cast("long").alias("most"))
        slot = F.when(F.col("n") <= F.col("most"), F.col("set_id")).otherwise(F.pmod(F.xxhash64("set_id"), F.col("most")))
        pivots = written(state.join(todo, "loose").groupBy("loose", slot.alias("slot")).agg(F.min("set_id").alias("set_id")).select("set_id", "loose"), "pivots")
        if links is not None and pivots.isEmpty():
            return links
        found, large = _round(documents, chosen, pivots, words, least)
        if links is not None:
            found = found.union(links.select(F.col("node").alias("u"), F.col("label").alias("v")))
        links = components(found)
        done = pivots.select("set_id") if done is None else written(pivots.select("set_id").union(done), "done")
        state = chosen.select("set_id", "loose", "size").join(links.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        main = state.groupBy("loose", "label").count().groupBy("loose").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        state = written(state.join(done, "set_id", "left_anti").join(main, "loose").where("label <> main").select("set_id", "loose", "size"), "state")
        most = LATER_PIVOTS


def jaccard_classes(documents: DataFrame, words: int = WORDS, least: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n_shingles, class_id (null if n_shingles is 0) and component_id of every document.

    Shingles are of so many words; sets link from the similarity least[0] / least[1].
    """
    kind = dict(documents.dtypes)["doc_id"]
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    scan = _scan if (words, least) == (WORDS, (NUMERATOR, DENOMINATOR)) else _sampled(words)
    scanned = written(keyed.mapInArrow(_forgetting(scan), f"doc_id {kind}, row long, n_shingles long, set_id long, keys array<long>"), "sets")
    rows = written(scanned.drop("keys"), "rows")
    labels = linked_classes(rows, loose_groups(scanned, documents, words, least), documents, words, least)
    sets = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("low")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    sets = sets.select("set_id", "low", F.coalesce("label", "set_id").alias("class_id"))
    lowest = sets.groupBy("class_id").agg(F.min("low").alias("component_id"))
    named = sets.join(lowest, "class_id").select("set_id", "class_id", "component_id")
    joined = rows.join(named, (rows["set_id"] == named["set_id"]) & (rows["n_shingles"] > 0), "left")
    return joined.select("doc_id", "row", "n_shingles", "class_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_classes(documents: DataFrame, words: int = WORDS, least: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> DataFrame:
    """documents, all columns, whatever their names, with one row of each class: that with the smallest doc_id. Rows without words all stay."""
    classes = jaccard_classes(documents.select("doc_id", "text"), words, least).select("doc_id", "row", "class_id", "n_shingles")
    key, one, own, turn = (free_name(documents, x) for x in ("key", "one", "own", "turn"))
    first = classes.where("n_shingles > 0").groupBy("class_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(key))
    kept = first.select(key, F.lit(True).alias(one)).union(classes.where("n_shingles = 0").select("row", F.lit(False)).distinct())
    joined = documents.withColumn(own, F.xxhash64("doc_id", "text")).join(kept, F.col(key) == F.col(own))
    # Equal rows have equal keys; of a class's first row one copy stays.
    place = F.row_number().over(Window.partitionBy(own).orderBy(own))
    return joined.withColumn(turn, place).where(~F.col(one) | (F.col(turn) == 1)).drop(key, own, one, turn)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
