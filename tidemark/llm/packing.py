"""Packing token sequences into windows by non-negative least squares over length combinations."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_rank, text_of

#: Fixed value: the byte-level vocabulary's pre-tokenizer pattern, as its tokenizer file has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENS = "id long, tokens long, full array<long>, rest long, bits array<long>"
END_ID = 1
LONG_BLANK = 10_000


def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids of the byte-level vocabulary in ``path`` (a tokenizer file with its ranks beside it; default: the public one).

    Control strings are ordinary text. Texts with white space runs that are too long for the rank-based
    encoder's pattern go to the tokenizer itself; ids are the same.
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blank, slow = re.compile(rf"\s{{{LONG_BLANK}}}"), []

    def encode(text: str) -> list[int]:
        if len(text) < LONG_BLANK or not blank.search(text):
            return fast(text)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def bit_sizes(rest: int) -> list[int]:
    """Powers of two that sum to ``rest``, largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def token_lengths(docs: DataFrame, *, id_col: str, text_col: str, window: int, path: str | None) -> DataFrame:
    """Per document its number of ids and the checksums of every piece it may be cut into.

    ``full``: its whole windows; ``rest``: what is left; ``bits``: what is left in powers of two.
    So the text is tokenized once, and ids are neither stored nor shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(np.array([*encode(text), END_ID], dtype="<u4").tobytes())
                n, at = len(ids) // 4, len(ids) // 4 // window * window
                bits, start = [], at
                for size in bit_sizes(n - at):
                    bits.append(zlib.crc32(ids[4 * start : 4 * (start + size)]))
                    start += size
                out.append((id_, n, [zlib.crc32(ids[4 * k : 4 * (k + window)]) for k in range(0, at, window)], zlib.crc32(ids[4 * at :]), bits))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["id", "tokens", "full", "rest", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, TOKENS)


def combinations(lengths: np.ndarray, window: int, fillers: int = 64) -> list[tuple[int, ...]]:
    """Shallow combinations of the given lengths (with their counts) that fill a window: all pairs, and triples with one of the ``fillers`` most common lengths."""
    there = set(np.nonzero(lengths)[0].tolist())
    found = {(a, window - a) for a in there if a <= window - a and window - a in there}
    for c in sorted(there, key=lambda n: (-lengths[n], n))[:fillers]:
        found |= {tuple(sorted((a, window - a - c, c))) for a in there if a <= window - a - c and window - a - c in there}
    return sorted(found, key=lambda p: (len(p), p))


def repeat_counts(lengths: np.ndarray, patterns: list[tuple[int, ...]], sweeps: int = 12) -> list[int]:
    """How often to use each pattern: non-negative least squares against the histogram by coordinate descent, rounded down, then trimmed and topped up to what there is."""
    left = lengths.astype(float).tolist()
    uses = [0.0] * len(patterns)
    needs = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for j, need in enumerate(needs):
            step = sum(k * left[n] for n, k in need) / sum(k * k for _, k in need)
            new = max(0.0, uses[j] + step)
            if (step := new - uses[j]) != 0.0:
                uses[j] = new
                for n, k in need:
                    left[n] -= k * step
                moved += abs(step)
        if moved < 1e-3 * max(1.0, float(lengths.sum())):
            break
    whole, stock = [0] * len(patterns), lengths.astype(int).tolist()
    for wanted in ([int(x) for x in uses], [sum(stock)] * len(patterns)):
        for j, need in enumerate(needs):
            take = min(wanted[j], *(stock[n] // k for n, k in need))
            whole[j] += take
            for n, k in need:
                stock[n] -= k * take
    return whole


class Windows(NamedTuple):
    """A kind of window: lengths of whole documents, sizes of pieces of others behind them, and how often it is used."""

    docs: tuple[int, ...]
    pieces: tuple[int, ...]
    uses: int


def first_fit(stock: list[int], window: int) -> list[Windows]:
    """Greedy windows over a histogram of lengths: the longest that is left, then the longest that still fits, and so on, as often as there are such."""
    there, stock = [n for n, k in enumerate(stock) if n and k], list(stock)
    found = []
    while there:
        docs, room = [], window
        used: Counter[int] = Counter()
        i = len(there) - 1
        while i >= 0:
            n = there[i]
            if n <= room and used[n] < stock[n]:
                docs.append(n)
                used[n] += 1
                room -= n
            i = min(bisect.bisect_right(there, room) - 1, i if used[n] < stock[n] else i - 1)
        uses = min(stock[n] // k for n, k in used.items())
        for n, k in used.items():
            stock[n] -= k * uses
            if not stock[n]:
                there.remove(n)
        found.append(Windows(tuple(docs), (), uses))
    return found


def filled(greedy: list[Windows], window: int) -> list[Windows]:
    """The windows that can be filled to the brim: the fullest first, with pieces of the documents of the emptiest, which are cut for it.

    Pieces are powers of two, so taking the largest that fit finds a filling if there is one. Documents that
    are in no window of the result are those to be cut.
    """
    left = sorted(greedy, key=lambda w: (window - sum(w.docs), w.docs))
    supply: Counter[int] = Counter()
    done = []
    while left:
        best = left[0]
        room, pieces = window - sum(best.docs), []
        for size in sorted(supply, reverse=True):
            n = min(room // size, supply[size])
            pieces += [size] * n
            room -= n * size
        if not room:
            uses = min([best.uses, *(supply[size] // n for size, n in Counter(pieces).items())])
            done.append(Windows(best.docs, tuple(pieces), uses))
            for size in pieces:
                supply[size] -= uses
            left[:1] = [best._replace(uses=best.uses - uses)] if uses < best.uses else []
        else:
            worst = left.pop()
            cut = min(worst.uses, -(-(window - sum(best.docs)) * best.uses // sum(worst.docs)))
            for n in worst.docs:
                for size in bit_sizes(n):
                    supply[size] += cut
            if cut < worst.uses:
                left.append(worst._replace(uses=worst.uses - cut))
    return done


Places = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]


def places(windows: list[Windows]) -> tuple[Places, Places, int]:
    """For each length of documents, and each size of pieces, its places by rank: (first ranks of ranges, sequences of the ranges' first, offsets, number of places); and the number of sequences."""
    found: tuple[dict, dict] = ({}, {})
    sequence = 0
    for w in windows:
        offset = 0
        for kind, sizes in zip(found, (w.docs, w.pieces), strict=True):
            for size in sizes:
                ranges = kind.setdefault(size, [])
                ranges.append((ranges[-1][3] if ranges else 0, sequence, offset, (ranges[-1][3] if ranges else 0) + w.uses))
                offset += size
        sequence += w.uses
    docs, pieces = ({n: (*(np.array(c) for c in zip(*v, strict=True)),)[:3] + (v[-1][3],) for n, v in kind.items()} for kind in found)
    return docs, pieces, sequence


def seats(sizes: np.ndarray, ranks: np.ndarray, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset by size and rank (from 0); -1 and 0 for those beyond all places."""
    sequence, offset = np.full(len(sizes), -1), np.zeros(len(sizes), dtype="int64")
    for size in np.unique(sizes):
        if size in places:
            first, start, at, end = places[size]
            own = np.nonzero((sizes == size) & (ranks < end))[0]
            k = np.searchsorted(first, ranks[own], side="right") - 1
            sequence[own], offset[own] = start[k] + ranks[own] - first[k], at[k]
    return sequence, offset


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, path: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's whole windows are sequences of their own. The histogram of what is left of each
    (below ``window``, so bounded) goes to the driver, which solves for the number of times to use
    each combination of lengths that fills a window. Lengths beyond every combination are packed
    greedily, the longest that fits first; what such windows lack is filled with pieces of the documents
    of the emptiest of them, which are cut into powers of two. Documents take the places by their rank
    among those of the same length, uncut, and pieces by their rank among those of the same size. Pieces that
    no window lacks are laid end to end, largest first, which fills windows exactly; the last window is split
    at powers of two, so no sequence needs padding.

    Null or empty text: the end id alone. Null ids and repeated rows: packed like others. A text of
    any length: one list of ids in a task. Empty table: empty result. Other columns are not read.
    """
    tokens = materialize(token_lengths(docs, id_col=id_col, text_col=text_col, window=window, path=path).withColumn("left", (F.col("tokens") % window).cast("int")).withColumn("u", F.xxhash64("id", "rest", "tokens")))
    lengths = np.zeros(window + 1, dtype="int64")
    for row in tokens.where(F.col("left") > 0).groupBy("left").count().collect():  # fewer than `window` rows
        lengths[row["left"]] = row["count"]
    patterns = combinations(lengths, window)
    solved = [Windows(pattern, (), uses) for pattern, uses in zip(patterns, repeat_counts(lengths, patterns), strict=True) if uses]
    rest = lengths.tolist()
    for w in solved:
        for n in w.docs:
            rest[n] -= w.uses
    by_length, by_size, n_combined = places(solved + filled(first_fit(rest, window), window))
    ranked = spread_rank(tokens.where(F.col("left") > 0).select("id", "tokens", "rest", "bits", "left", "u"), ["left"], F.col("u"), ["id", "u"], "rank")

    def seat(size: str, where: Places) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                sequence, offset = seats(rows[size].to_numpy(), rows["rank"].to_numpy() - 1, where)
                yield rows.assign(sequence_id=sequence, offset=offset)

        return run

    seated = materialize(ranked.mapInPandas(seat("left", by_length), "id long, tokens long, rest long, bits array<long>, left int, u long, rank long, sequence_id long, offset long"))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    combined = seated.where("sequence_id >= 0").select("id", (F.col("tokens") - F.col("left")).alias("start"), F.col("left").cast("long").alias("length"), F.col("rest").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")

    # the others in powers of two, largest first: a piece never straddles a window or a block of the last one
    sizes = F.filter(F.array(*[F.lit(1 << k) for k in range((window - 1).bit_length() - 1, -1, -1)]), lambda s: F.col("left").bitwiseAND(s) > 0)
    cut = materialize(
        seated.where("sequence_id < 0").select("id", "tokens", "left", "u", F.explode(F.arrays_zip(sizes.alias("size"), F.col("bits").alias("crc"))).alias("piece"))
        .select("id", "tokens", "u", F.col("piece.size").alias("size"), F.col("piece.crc").alias("crc"), (F.col("tokens") - F.col("left") + F.col("left") - F.pmod(F.col("left"), F.col("piece.size") * 2)).alias("start"))
    )
    ends = {size: p[3] for size, p in by_size.items()}
    counts = {row["size"]: row["count"] - ends.get(row["size"], 0) for row in cut.groupBy("size").count().collect()}  # a row per power of two
    base, at = {}, 0
    for size in sorted(counts, reverse=True):
        base[size] = at - size * ends.get(size, 0)
        at += size * counts[size]
    tail = at // window * window
    spot = spread_rank(cut, ["size"], F.col("u"), ["id", "u", "start"], "rank").select("id", "tokens", F.col("size").cast("long").alias("size"), "crc", F.col("start").cast("long").alias("start"), "rank")
    spot = spot.mapInPandas(seat("size", by_size), "id long, tokens long, size long, crc long, start long, rank long, sequence_id long, offset long")
    first = F.create_map(*[F.lit(x).cast("long") for size, b in (base or {1: 0}).items() for x in (size, b)])[F.col("size")]
    blocks = [tail + sum(bit_sizes(at - tail)[:k]) for k in range(len(bit_sizes(at - tail)))]
    starts = F.array(*[F.lit(b).cast("long") for b in blocks or [tail]])
    spot = spot.withColumn("at", first + (F.col("rank") - 1) * F.col("size"))
    block = F.size(F.filter(starts, lambda b: b <= F.col("at")))
    begin = F.when(F.col("at") < tail, F.col("at") - F.col("at") % window).otherwise(F.element_at(starts, F.greatest(block, F.lit(1))))
    number = F.when(F.col("at") < tail, F.floor(F.col("at") / window)).otherwise(tail // window + block - 1)
    placed = F.col("sequence_id") >= 0
    pieces = spot.select(
        "id", "start", F.col("size").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        F.when(placed, F.col("sequence_id")).otherwise(number + n_combined).cast("long").alias("sequence_id"), F.when(placed, F.col("offset")).otherwise(F.col("at") - begin).alias("offset"),
    )

    n_cut = n_combined + tail // window + len(blocks)
    long = spread_rank(tokens.where("size(full) > 0").select("id", "tokens", "full", "u"), [], F.col("u"), ["id", "u"], "upto", amount=F.size("full").cast("long"))
    whole = long.select("id", "tokens", "upto", F.size("full").alias("n"), F.posexplode("full").alias("k", "crc")).select(
        "id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        (F.col("upto") - F.col("n") + F.col("k") + n_cut).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return whole.select(*columns).unionByName(combined.select(*columns)).unionByName(pieces.select(*columns)).withColumnRenamed("id", id_col)
