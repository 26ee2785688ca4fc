"""Removal of repeated byte strings by deep-shallow suffix sorting around sampled anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

LOWEST = -(2**63)
SHALLOW = 32  # bytes beyond what all strings share that multikey quicksort looks at before blind tries take over
WORD = 8  # its characters are words of so many bytes
CHUNK = 1 << 20
POS_BITS = 24
SEGMENT = "core long, kid long, mark long, pos int, low int, high int, hull binary"
HULL = "kid long, mark long, pos int, low int, high int, core long, h1 long, h2 long"


# -- deep-shallow sorting of byte strings


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, given that it is at least ``start``."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of ``members``, whose strings share ``depth`` bytes, and the common prefix of each with the one before.

    A node is [string depth, {branching byte: node or leaf}], a leaf a list of equal strings' indexes;
    an end of string branches as -1. A search looks at branching bytes only, then once at the leaf it finds.
    """
    root: list | None = None
    for i in members:
        s = strings[i]
        if root is None:
            root = [None, [i]]
            continue
        node = root
        while node[0] is not None:
            at = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(at) or next(iter(node[1].values()))
        near = strings[node[1][0]]
        same = common(s, near, depth)
        if same == len(s) == len(near):
            node[1].append(i)
            continue
        parent, node = None, root
        while node[0] is not None and node[0] < same:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        leaf, byte = [None, [i]], s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][byte] = leaf
            continue
        branch = [same, {near[same] if same < len(near) else -1: node, byte: leaf}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = branch
    order, shared = [], []
    stack = [(root, depth)]
    while stack:
        node, before = stack.pop()
        if node[0] is None:
            order += node[1]
            shared += [before] + [len(strings[node[1][0]])] * (len(node[1]) - 1)
        else:
            inner = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0]) for _, child in inner[:-1]] + [(inner[-1][1], before)]
    return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings, and the common prefix of each with the one before (0 for the first).

    The strings of a core share a gram and more: multikey quicksort starts at the first byte in which any two differ.
    """
    order: list[int] = []
    shared: list[int] = []
    start = min((common(strings[0], s) for s in strings[1:]), default=0)
    deep = start + SHALLOW
    todo = [(list(range(len(strings))), start)]
    while todo:
        members, depth = todo.pop()
        if len(members) == 1 or depth >= deep:
            part, prefix = blind_trie(strings, members, depth) if len(members) > 1 else (members, [0])
            prefix[0] = common(strings[order[-1]], strings[part[0]], start) if order else 0
            order += part
            shared += prefix
            continue
        # multikey quicksort, a word at a time; shorter than a word: the string ends here
        pivot = strings[members[len(members) // 2]][depth : depth + WORD]
        less, equal, more = [], [], []
        for i in members:
            word = strings[i][depth : depth + WORD]
            (equal if word == pivot else less if word < pivot else more).append(i)
        todo += [(part, at) for part, at in ((more, depth), (equal, depth + WORD if len(pivot) == WORD else deep), (less, depth)) if part]
    return order, shared


# -- windows that repeat among the hulls of one core


def repeated(hulls: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (bytes, anchor's place in them), the ranges of offsets o whose window, of ``length`` bytes from o before the anchor, is also another hull's."""
    right_order, right = deep_shallow([s[a:] for s, a in hulls])
    left_order, left = deep_shallow([s[:a][::-1] for s, a in hulls])
    out: list[list[tuple[int, int]]] = [[] for _ in hulls]
    if len(hulls) <= 12:
        rank = {m: i for i, m in enumerate(left_order)}
        for i, first in enumerate(right_order):
            ahead = length
            for j in range(i + 1, len(right_order)):
                ahead = min(ahead, right[j])
                a, b = sorted((rank[first], rank[right_order[j]]))
                low, high = length - ahead, min(left[a + 1 : b + 1])
                if low <= high:
                    out[first].append((low, high))
                    out[right_order[j]].append((low, high))
        return out
    # for each offset, equal windows are those of equal class on both sides
    right_order, right, left_order, left = map(np.array, (right_order, right, left_order, left))
    to = max(a for _, a in hulls)
    lengths_right, lengths_left = np.array([len(s) - a for s, a in hulls]), np.array([a for _, a in hulls])
    right_class, left_class = np.empty(len(hulls), np.int64), np.empty(len(hulls), np.int64)
    hit = np.zeros((to + 2, len(hulls)), bool)
    for o in range(to + 1):
        right_class[right_order] = np.cumsum(right < length - o)
        left_class[left_order] = np.cumsum(left < o)
        fits = (lengths_right >= length - o) & (lengths_left >= o)
        if fits.any():
            _, inverse, counts = np.unique((right_class * len(hulls) + left_class)[fits], return_inverse=True, return_counts=True)
            hit[o, fits] = counts[inverse] > 1
    for m in np.nonzero(hit.any(axis=0))[0]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[:, m].astype(np.int8)))))
        out[m] = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
    return out


# -- anchors


class Anchors:
    """Minimizers: for every window of ``length`` bytes the place of the least hash among its ``span`` grams of length - span + 1 bytes."""

    def __init__(self, length: int, span: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.length, self.span, self.gram = length, span, length - span + 1
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**62)) * 2 + 1
        n = CHUNK + length
        self.powers, self.inverse = (np.cumprod(np.full(n, b % 2**64, np.uint64)) for b in (base, pow(base, -1, 2**64)))

    def chunk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, low, high, core) of each anchor of the texts [start, end) in ``data``; its windows start from ``high`` to ``low`` before it."""
        n = len(data)
        if n < self.length:
            return (np.zeros(0, np.int64),) * 4
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[:n])))
        grams = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        mask = np.uint64((1 << POS_BITS) - 1)
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step < self.span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        windows = np.zeros(len(least) + 1, np.int8)
        long = ends - starts >= self.length
        np.add.at(windows, starts[long], 1)
        np.add.at(windows, ends[long] - self.length + 1, -1)
        p = np.flatnonzero(np.cumsum(windows[:-1]))
        place = (least[p] & mask).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
        place = place[edges[:-1]]
        return place, place - p[edges[1:] - 1], place - p[edges[:-1]], grams[place].view(np.int64)

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, tuple[np.ndarray, ...]]]:
        """Pieces of CHUNK bytes or so: (text of each part, bytes, its offset in its text and start in the piece, anchors)."""
        part: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            data = b"".join(x for _, _, x in part)
            ends = np.cumsum([len(x) for _, _, x in part])
            starts = ends - [len(x) for _, _, x in part]
            return np.array([i for i, _, _ in part]), data, np.stack((np.array([at for _, at, _ in part]), starts)), self.chunk(np.frombuffer(data, np.uint8), starts, ends)

        for i, text in enumerate(texts):
            # long texts in slices that share length - 1 bytes: no window is lost or met twice
            for at in range(0, max(1, len(text) - self.length + 1), CHUNK // 2):
                piece = text[at : at + CHUNK // 2 + self.length - 1]
                if size + len(piece) > CHUNK and part:
                    yield flush()
                    part, size = [], 0
                part.append((i, at, piece))
                size += len(piece)
        if part:
            yield flush()


def hull_hash(data, high: int) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data, seed=high)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def cores(docs: DataFrame, length: int, span: int) -> DataFrame:
    """(core) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, span)
        for batch in batches:
            found = [a[3] for _, _, _, a in anchors(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["core"])

    return docs.select("bytes").mapInArrow(run, "core long")


def anchored(docs: DataFrame, length: int, span: int) -> DataFrame:
    """Every anchor with the offsets of its windows (low to high before it) and the hash of the bytes they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, span)
        for batch in batches:
            kid, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, data, (at, start), (place, low, high, core) in anchors(batch.column(2).to_pylist()):
                if len(place):
                    own = np.searchsorted(start, place, side="right") - 1
                    view = memoryview(data)
                    hashes = np.array([hull_hash(view[p - h : p - lo + length], h) for p, lo, h in zip(place.tolist(), low.tolist(), high.tolist(), strict=True)], dtype=np.int64)
                    row = text[own]
                    columns = [kid[row], mark[row], (place - start[own] + at[own]).astype(np.int32), low.astype(np.int32), high.astype(np.int32), core, hashes[:, 0], hashes[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in HULL.split(", ")])

    return docs.select("kid", "mark", "bytes").mapInArrow(run, HULL)


def refine(held: DataFrame, length: int, block: int) -> DataFrame:
    """Anchors of SEGMENT cut at multiples of ``block`` offsets; a part's core is what all windows of its block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, kid, mark, pos, low, high, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(low // block * block, high + 1, block):
                    lo, hi = max(b, low), min(b + block - 1, high)
                    core = xxhash.xxh3_64_intdigest(text[high - b : high - b - block + 1 + length], seed=b) - 2**63
                    cut = text[high - hi : high - lo + length]
                    out.append((core, kid, mark, pos, lo, hi, cut, *hull_hash(cut, hi)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    fields = [("core", pa.int64()), ("kid", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("hull", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())]
    return held.mapInArrow(run, f"{SEGMENT}, h1 long, h2 long")


def segments(docs: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """SEGMENT of each of ``firsts`` (core, kid, mark, pos, low, high): its hull's bytes are cut from its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kid, mark, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                column = lambda name, kind: pa.array([s[name] for s in spots], kind)
                places = [column("pos", pa.int32()), column("low", pa.int32()), column("high", pa.int32())]
                hulls = pa.array([text[s["pos"] - s["high"] : s["pos"] - s["low"] + length] for s in spots], pa.binary())
                yield pa.RecordBatch.from_arrays([column("core", pa.int64()), pa.array([kid] * len(spots)), pa.array([mark] * len(spots)), *places, hulls], names=["core", "kid", "mark", "pos", "low", "high", "hull"])

    spots = firsts.groupBy("kid", "mark").agg(F.collect_list(F.struct("core", "pos", "low", "high")).alias("spots"))
    return docs.select("kid", "mark", "bytes").join(spots, ["kid", "mark"]).dropDuplicates(["kid", "mark"]).mapInArrow(cut, SEGMENT)


def sort_cores(held: DataFrame, length: int) -> DataFrame:
    """Spans (kid, mark, start, end) of the windows that two hulls of a core share."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[int, int, int, int]] = []

        def settle() -> None:
            for (_, kid, mark, pos, *_), ranges in zip(group, repeated([(x[6], x[5]) for x in group], length), strict=True):
                out.extend((kid, mark, pos - high, pos - low + length) for low, high in ranges)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["kid", "mark", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    settle()
                    group = []
                group.append(row)
            yield batch_of()
            out.clear()
        if group:
            settle()
        yield batch_of()

    # dealt by a hash of the core: by the core itself, Spark leaves this shuffle out after a join on it, whose skewed partitions it splits
    return held.repartition(F.xxhash64("core")).sortWithinPartitions("core").mapInArrow(spans, "kid long, mark long, start long, end long")


def repeated_spans(docs: DataFrame, length: int, most: int = 2048) -> DataFrame:
    """Spans (kid, mark, start, end), overlapping, that cover exactly the bytes of repeated windows; ``docs`` has kid, mark and bytes.

    Equal windows have their least gram at the same place, so they meet under the same core (the
    gram's hash). Anchors of equal hulls (all bytes that an anchor's windows cover, by a 128-bit hash)
    are one string with a count, with partial aggregation: a count above one settles all its windows,
    and of each distinct hull one goes on to the suffix sort of its core. A core with more than ``most`` distinct hulls is cut instead: its windows by halves of
    their offsets, under the longer string that each half shares, again and again; at single
    offsets a core is a whole window. So no task gets more than ``most`` hulls of a core, and results don't depend on ``most``.
    """
    block = 1 << ((2 * length // 3).bit_length() - 1)
    hull, place = ["core", "h1", "h2"], ["kid", "mark", "pos", "low", "high"]
    shared = materialize(cores(docs, length, block).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    rows = materialize(anchored(docs, length, block).join(shared, "core", "left_semi").select(*place, *hull))
    found: list[DataFrame] = []
    while True:
        cut = [c for c in rows.columns if c == "hull"]
        hulls = materialize(rows.groupBy(*hull).agg(F.count("*").alias("n"), F.min(F.struct(*place, *cut)).alias("first")))
        alike = rows.select(*place, *hull).join(materialize(hulls.where("n > 1").select(*hull)), hull, "left_semi")
        found.append(alike.select("kid", "mark", (F.col("pos") - F.col("high")).cast("long").alias("start"), (F.col("pos") - F.col("low") + length).cast("long").alias("end")))
        counts = materialize(hulls.groupBy("core").agg(F.count("*").alias("hulls")).where("hulls > 1"))
        firsts = hulls.select("core", "first.*")
        few, many = (counts.where(c).select("core") for c in (F.col("hulls") <= most, F.col("hulls") > most))
        # past the first round the bytes travel with the rows, and the texts aren't read again
        held = lambda these: firsts.join(these, "core", "left_semi") if cut else segments(docs, firsts.join(these, "core", "left_semi"), length)  # noqa: B023, E731
        found.append(sort_cores(held(few).select("core", *place, "hull"), length))
        block //= 2
        if not block or many.isEmpty():
            break
        rows = materialize(refine(held(many).select("core", *place, "hull"), length, block).select(*place, *hull, "hull"))
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per document: id, kept (bytes), n_bytes, n_removed, n_spans.

    Removes every byte covered by a string of ``length`` bytes that also starts anywhere else in the
    table, the same text included (overlaps count); matches lie within texts and are judged on the input.

    Null text: empty. Texts shorter than ``length``: kept whole. Ids are integers; null ones (and the
    lowest 64-bit number, which stands in for them and comes back as null) are documents like others.
    Repeated rows: each other's copies. Empty table: empty result. Long texts are read in overlapping
    slices. Other columns are not read.
    """
    text = text_of(text_col)
    # spans and result read texts by the same keys and columns, so one shuffle of them serves both
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("kid"), F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("bytes"))
    spans = repeated_spans(read, length)
    spans = spans.groupBy("kid", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, runs = [], [], []
            for data, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at, n = [], 0, 0
                for start, end in sorted((c["start"], c["end"]) for c in cuts or ()):
                    if start > at or not n:
                        parts.append(data[at:start])
                        n += 1
                    at = max(at, end)
                parts.append(data[at:])
                kept.append(b"".join(parts))
                removed.append(len(data) - len(kept[-1]))
                runs.append(n)
            sizes = pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), sizes, pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["kid", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = read.join(spans, ["kid", "mark"], "left").select("kid", "bytes", "spans")
    out = joined.mapInArrow(run, "kid long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(F.when(F.col("kid") != LOWEST, F.col("kid")).cast(docs.schema[id_col].dataType).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans")
