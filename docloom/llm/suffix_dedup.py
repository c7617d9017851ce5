"""Suffix-array dedup: bytes covered by a 200-byte string that starts more than once are removed.

Sorting every suffix of a corpus would move two hundred bytes for each byte. So suffixes are sampled by content: of
the GRAM-byte strings in a window of LENGTH bytes the one with the smallest hash is the window's anchor, so equal
windows have equal anchors at equal offsets, and a run of windows with one anchor is one row. Rows whose anchor's
string occurs once can't repeat. Rows whose whole runs are equal repeat whole. What is left, runs that share an anchor
but not all their bytes, is suffix-sorted: the strings from the anchor on, and those before it read backwards, each by
deep-shallow sorting (multikey quicksort over the first SHALLOW bytes, then a blind trie for each group that is still
tied). With the longest common prefixes of both orders, a window at an offset repeats exactly where another row shares
its bytes on both sides.

An anchor that more than HOT different runs share is not brought to one task: its windows are counted by hash in
pre-aggregated groups, one row each, so an endlessly common passage is spread over all tasks. (Splitting its runs by
their next bytes instead would lose windows that begin before the anchor, and those that share only these stay together.)

Defined results: null text is empty; matches never cross documents; texts under 200 bytes keep all; repeated rows
repeat each other. Other columns than doc_id and text aren't read. Runs and hot windows are compared by 64- and
128-bit hashes, all others byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import free_name, freed, slices, table, written

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM  # largest offset of an anchor in its window
SHALLOW = 16
HOT = 4096
UNIT = 1 << 20  # bytes hashed at a time; places within take 20 bits
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_M2, _M3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _powers(base: int) -> np.ndarray:
    out = np.full(UNIT + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and of its inverse, modulo 2**64."""
    if base not in _TABLES:
        value = (np.arange(1, 257, dtype=np.uint64) * _M3) ^ (np.arange(1, 257, dtype=np.uint64) * _M2 >> np.uint64(17))
        _TABLES[base] = value, _powers(base), _powers(pow(base, -1, 1 << 64))
    return _TABLES[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any substrings of data: equal strings, equal hashes."""

    def __init__(self, data: np.ndarray, base: int = _BASE) -> None:
        value, powers, self.inverse = _tables(base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * powers[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[:n])


def runs_of(units: list[bytes]) -> tuple[np.ndarray, ...]:
    """unit, anchor, first and last window of every run, and the hashes of the anchor's string and of the run.

    Together the units have UNIT bytes at most.
    """
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = _Hashes(data)
    gram = hashes.grams()
    low = gram & ~np.uint64(UNIT - 1) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := SPAN + 1 - width:
        low = np.minimum(low[:-rest], low[rest:])
    anchor = (low & np.uint64(UNIT - 1)).astype(np.int64)
    unit = np.repeat(np.arange(len(units)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + LENGTH <= ends[unit]
    code = np.where(fits, anchor, -1)
    cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (unit[1:] != unit[:-1])))
    last = np.append(cut[1:], len(code)) - 1
    good = code[cut] >= 0
    first, last = cut[good], last[good]
    anchor, unit = code[first], unit[first]
    whole = _mix(hashes(first, last + LENGTH) + ((anchor - first) << 9 | last - first).astype(np.uint64) * _M2)
    return unit, anchor - starts[unit], first - starts[unit], last - starts[unit], gram[anchor], whole


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "at", "high", "low", "gram", "whole"]
    for batch in slices(batches, "text", UNIT - LENGTH):
        rows = batch.column("row").to_numpy()
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        # A text too long for a unit is cut into units that overlap by a window less one byte.
        step = UNIT - LENGTH
        pieces = [(i, a, t[a : a + UNIT - 1]) for i, t in enumerate(texts) for a in (range(0, max(1, len(t) - LENGTH + 1), step) if len(t) >= UNIT else (0,))]
        packs: list[list] = [[]]
        total = 0
        for p in pieces:
            if total + len(p[2]) >= UNIT:
                packs.append([])
                total = 0
            packs[-1].append(p)
            total += len(p[2])
        for pack in packs:
            unit, anchor, first, last, gram, whole = runs_of([p[2] for p in pack])
            # Of the windows in an overlap the later unit has them all.
            stop = np.array([step - 1 if len(texts[i]) >= UNIT and a + step < len(texts[i]) - LENGTH + 1 else 1 << 40 for i, a, _ in pack] or [0])[unit]
            keep = first <= stop
            cols = [c[keep] for c in (unit, anchor, first, last, gram, whole)]
            unit, anchor, first, last, gram, whole = cols
            owner = np.array([p[0] for p in pack] or [0])[unit]
            base = np.array([p[1] for p in pack] or [0])[unit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[owner]), pa.array((anchor + base).astype(np.int32)), pa.array((anchor - first).astype(np.int16)), pa.array((anchor - last).astype(np.int16)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))],
                names,
            )


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte characters, and where in it a row differs from the one before.

    Multikey quicksort, all open groups at once: each is split by its middle row's character into smaller, equal and
    larger ones; equal ones go on with the next character, until the rows end or a group has one row.
    """
    n, depth_end = words.shape
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    at, size, depth = np.array([0]), np.array([n]), np.array([0])  # the open groups' first places
    while True:
        go = (size > 1) & (depth < depth_end)
        at, size, depth = at[go], size[go], depth[go]
        if not len(at):
            return order, new
        group = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(group)) + np.repeat(at - (np.cumsum(size) - size), size)
        rows = order[place]
        sign = words[rows, depth[group]]
        middle = sign[np.cumsum(size) - size + size // 2][group]
        part = 3 * group + np.where(sign < middle, 0, np.where(sign == middle, 1, 2))
        order[place] = rows[np.argsort(part, kind="stable")]
        sizes = np.bincount(part, minlength=3 * len(at)).reshape(-1, 3)
        starts = at[:, None] + np.cumsum(sizes, axis=1) - sizes
        new[starts[sizes > 0]] = True
        depths = depth[:, None] + np.array([0, 1, 0])
        at, size, depth = starts.ravel(), sizes.ravel(), depths.ravel()


def blind_trie(strings: list[bytes], numbers: list[int], width: int) -> tuple[list[int], list[int]]:
    """Sorted order of strings of at most width bytes, and each one's common prefix with the one before it.

    Inner nodes hold a depth and children by the character there (-1 at a string's end); characters in between aren't
    looked at on the way down, one comparison with the leaf then tells where the new string leaves the path.
    numbers: the strings as integers, padded with zeros to width.
    """

    def common(i: int, j: int) -> int:
        return min(len(strings[i]), len(strings[j]), width - ((numbers[i] ^ numbers[j]).bit_length() + 7) // 8)

    if len(strings) == 2:
        n = common(0, 1)
        return ([0, 1] if strings[0] <= strings[1] else [1, 0]), [0, n]
    root: list | tuple = ([0],)  # a leaf is a 1-tuple of the list of its strings, a node is [depth, children]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, list):
            child = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other = node[0][0]
        n = common(i, other)
        if n == len(s) == len(strings[other]):
            node[0].append(i)
            continue
        mine, theirs = s[n] if n < len(s) else -1, strings[other][n] if n < len(strings[other]) else -1
        above, key, node = None, 0, root
        while isinstance(node, list) and node[0] < n:
            above, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node, list) and node[0] == n:
            node[1][mine] = ([i],)
        else:
            branch = [n, {theirs: node, mine: ([i],)}]
            if above is None:
                root = branch
            else:
                above[1][key] = branch
    order, lcp, todo = [], [], [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node, list):
            kids = [node[1][k] for k in sorted(node[1])]
            todo += [(kid, node[0]) for kid in kids[:0:-1]]
            todo.append((kids[0], shared))
        else:
            for k, i in enumerate(node[0]):
                order.append(i)
                lcp.append(len(strings[i]) if k else shared)
    lcp[0] = 0
    return order, lcp


def deep_shallow(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of strings of at most width bytes, and common prefixes of neighbours in it."""
    size = np.array([len(s) for s in strings])
    head = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings]), ">u8").reshape(-1, SHALLOW // 8).astype(np.uint64)
    order, new = multikey_sort(head)
    lcp = np.zeros(len(strings), np.int64)
    flat = head[order]
    for c in range(flat.shape[1] - 1, -1, -1):  # of neighbours that differ in their heads
        x = flat[1:, c] ^ flat[:-1, c]
        lead = np.full(len(x), 8)
        for b in range(8):
            lead[(x >> np.uint64(8 * b)) & np.uint64(255) != 0] = 7 - b
        lcp[1:] = np.where(lead < 8, 8 * c + lead, lcp[1:] if c < flat.shape[1] - 1 else SHALLOW)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order))
    for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        group = order[a:b].tolist()
        own = [strings[i] for i in group]
        inside, shared = blind_trie(own, [int.from_bytes(s.ljust(width, b"\0")) for s in own], width)
        order[a:b] = [group[i] for i in inside]
        lcp[a + 1 : b] = shared[1:]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))  # padding isn't shared
    return order, lcp


def repeats(contexts: list[bytes], high: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run and each offset of the anchor in a window, whether that window occurs in two places.

    A context has high bytes before the anchor's start and LENGTH - low from it on.
    """
    high, low = high.astype(np.int64), low.astype(np.int64)
    right_order, right_lcp = deep_shallow([c[h:] for c, h in zip(contexts, high.tolist(), strict=True)], LENGTH)
    left_order, left_lcp = deep_shallow([c[:h][::-1] for c, h in zip(contexts, high.tolist(), strict=True)], LENGTH)
    n = len(contexts)
    out = np.zeros((n, SPAN + 1), bool)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(low.min()), int(high.max()) + 1):
        fits = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(fits):
            continue
        right[right_order] = np.cumsum(right_lcp < LENGTH - offset)
        left[left_order] = np.cumsum(left_lcp < offset)
        key = right[fits] * (n + 1) + left[fits]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(fits), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out[fits, offset] = twice | (count[fits] > 1)
    return out


def _ranges(flags: np.ndarray) -> list[list[int]]:
    """Of each row the first and last place of every run of True."""
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, at = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    out: list[list[int]] = [[] for _ in range(len(flags))]
    for r, a, b in zip(row.tolist(), at.tolist(), last.tolist(), strict=True):
        out[r] += (a, b)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        cols: list[list] = [[] for _ in range(7)]
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = text.encode()
            for r in runs:
                for c, v in zip(cols, (r["gram"], r["whole"], r["high"], r["low"], r["n"], r["hot"], data[r["at"] - r["high"] : r["at"] - r["low"] + LENGTH]), strict=True):
                    c.append(v)
        names = ["gram", "whole", "high", "low", "n", "hot", "context"]
        types = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.bool_(), pa.binary()]
        for at in range(0, len(cols[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], t) for c, t in zip(cols, types, strict=True)], names)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; whole grams are suffix-sorted together, about 40,000 runs at a time."""
    held: list[pa.Table] = []

    def solve(t: pa.Table) -> pa.RecordBatch:
        found = repeats(t["context"].to_pylist(), t["high"].to_numpy(), t["low"].to_numpy(), t["n"].to_numpy())
        return pa.RecordBatch.from_arrays([t["gram"].combine_chunks(), t["whole"].combine_chunks(), pa.array(_ranges(found), pa.list_(pa.int32()))], ["gram", "whole", "ranges"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(len(t) for t in held) >= 40_000:
            t = pa.concat_tables(held).combine_chunks()
            gram = t["gram"].to_numpy()
            cut = int(np.searchsorted(gram, gram[-1], "left"))  # the last gram may go on
            if cut:
                yield solve(t.slice(0, cut).combine_chunks())
            held = [t.slice(cut)]
    if held and sum(len(t) for t in held):
        yield solve(pa.concat_tables(held).combine_chunks())


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "context", 256 << 10):
        contexts = batch.column("context").to_pylist()
        data = np.frombuffer(b"".join(contexts), np.uint8)
        ends = np.cumsum([len(c) for c in contexts])
        starts = np.append(0, ends[:-1])
        high, low = batch.column("high").to_numpy().astype(np.int64), batch.column("low").to_numpy().astype(np.int64)
        own = np.repeat(np.arange(len(contexts)), high - low + 1)
        offset = high[own] - (np.arange(len(own)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
        at = starts[own] + high[own] - offset
        columns = [_Hashes(data)(at, at + LENGTH), _Hashes(data, _BASE2)(at, at + LENGTH)]
        index = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.view(np.int64)) for c in columns), batch.column("gram").take(index), batch.column("whole").take(index), batch.column("n").take(index), pa.array(offset.astype(np.int32))],
            ["w1", "w2", "gram", "whole", "n", "offset"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 9 << 20):
        spans_out, kept = [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            data, spans = (text or "").encode(), []
            for a, b in sorted((x["a"], x["b"]) for x in found or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *[x for s in spans for x in s], len(data)]
            spans_out.append(spans)
            kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
        sizes = [len((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans_out, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def row_of() -> Column:
    """A row's key: rows with equal id and text share it, and their results."""
    return F.xxhash64("doc_id", "text")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """row and found, the byte ranges (a, b) that repeated strings cover, for the rows that have any."""
    keyed = documents.select(row_of().alias("row"), "text")
    anchors = written(keyed.mapInArrow(freed(_anchors), "row long, at int, high smallint, low smallint, gram long, whole long"), "anchors")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("w1"), F.max("whole").alias("w2")).where("n > 1")
    # Written, so that the join has an exchange on both sides and Spark can split a common anchor's rows.
    grams = written(grams.select("gram", (F.col("w1") != F.col("w2")).alias("mixed")), "grams")
    shared = written(anchors.join(grams, "gram"), "shared")
    mixed = shared.where("mixed")
    runs = mixed.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "high", "low")).alias("one"))
    runs = written(runs, "runs")
    hot = runs.groupBy("gram").agg(F.count("*").alias("runs")).where(F.col("runs") > HOT).select("gram", F.lit(True).alias("hot"))
    chosen = runs.join(hot, "gram", "left").select("one.row", F.struct("one.at", "one.high", "one.low", "gram", "whole", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("run"))
    by_row = chosen.groupBy("row").agg(F.collect_list("run").alias("runs"))
    # Rows with equal keys have equal texts: one of them gives the bytes.
    contexts = keyed.join(by_row, "row").mapInArrow(freed(_contexts), "gram long, whole long, high smallint, low smallint, n long, hot boolean, context binary")
    contexts = written(contexts, "contexts")
    cold = contexts.where("NOT hot").drop("hot").repartition("gram").sortWithinPartitions("gram", "whole").mapInArrow(freed(_sorted_runs), "gram long, whole long, ranges array<int>")
    windows = contexts.where("hot").select("context", "gram", "whole", "high", "low", "n").mapInArrow(freed(_hot_windows), "w1 long, w2 long, gram long, whole long, n long, offset int")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
    warm = windows.join(twice, ["w1", "w2"]).groupBy("gram", "whole").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    warm = warm.select("gram", "whole", F.flatten(F.transform("offsets", lambda x: F.array(x, x))).alias("ranges"))
    found = cold.union(warm).where("size(ranges) > 0").dropDuplicates(["gram", "whole"])
    found = written(found, "repeats")
    ranged = mixed.join(found, ["gram", "whole"]).select("row", "at", F.explode(F.expr("transform(sequence(0, size(ranges) DIV 2 - 1), i -> struct(ranges[2 * i] AS a, ranges[2 * i + 1] AS b))")).alias("r"))
    spans = ranged.select("row", (F.col("at") - F.col("r.b")).alias("a"), (F.col("at") - F.col("r.a") + LENGTH).alias("b"))
    spans = spans.union(shared.where("NOT mixed").select("row", (F.col("at") - F.col("high")).cast("int").alias("a"), (F.col("at") - F.col("low") + LENGTH).cast("int").alias("b")))
    return spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("found"))


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges) and kept (the remaining bytes) of every document."""
    found = written(repeated_spans(documents), "spans")
    joined = documents.select("doc_id", "text", row_of().alias("row")).join(found, "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(freed(_cut), f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, spans array<array<long>>, kept binary")


def _cut_rows(batches: Iterator[pa.RecordBatch], found: str) -> Iterator[pa.RecordBatch]:
    """All columns but that of the found spans, with these removed from the text; a character that a span cuts in two goes whole."""
    for part in slices(batches, "text", 8 << 20):
        given = pa.RecordBatch.from_arrays([part.column(n) for n in ("doc_id", "text", found)], ["doc_id", "text", "found"])
        kept = [k for c in _cut(iter([given])) for k in c.column("kept").to_pylist()]
        texts = [None if t is None else k.decode(errors="ignore") for t, k in zip(part.column("text").to_pylist(), kept, strict=True)]
        columns = {n: part.column(n) for n in part.schema.names if n != found} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t or "") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents, all columns, whatever their names, with texts without their repeated spans; n_chars, if there, counts what is left."""
    key, own = free_name(documents, "row"), free_name(documents, "found")
    found = written(repeated_spans(documents.select("doc_id", "text")), "spans").select(F.col("row").alias(key), F.col("found").alias(own))
    joined = documents.join(found, row_of() == F.col(key), "left").drop(key)
    return joined.mapInArrow(freed(partial(_cut_rows, found=own)), documents.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        spans = batch.column("spans").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in batch.column("kept").to_pylist()], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(repeated_spans(documents), "spans")
    joined = documents.select("doc_id", "text", row_of().alias("row")).join(found, "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(freed(_digests), f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
