"""Fill-in-middle transformation over an index of distinct texts with Elias-Fano lists of their unit boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The control strings around prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 20


class EliasFano:
    """A rising list of integers in about 2 + log2(universe / n) bits each, with access by position.

    The low bits of every value are packed; the high parts are counted in unary: value i sets bit (high part + i),
    so the i-th one, found by counts over blocks of the bit string, gives the high part back.
    """

    BLOCK = 64  # bytes of the bit string per count

    def __init__(self, chunks: Iterator[np.ndarray], n: int, universe: int) -> None:
        self.n = n
        self.shift = max(0, (universe // max(1, n)).bit_length() - 1)
        high = np.zeros(((universe >> self.shift) + n) // 8 + 1, np.uint8)
        low = np.zeros((n * self.shift + 7) // 8, np.uint8)
        at = 0
        for values in chunks:
            order = np.arange(at, at + len(values))
            spots = (values >> self.shift) + order
            np.bitwise_or.at(high, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
            for bit in range(self.shift):
                spots = order[(values >> bit & 1) == 1] * self.shift + bit
                np.bitwise_or.at(low, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
            at += len(values)
        assert at == n
        self.high, self.low = high, low
        ones = np.bitwise_count(high)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self.BLOCK), dtype=np.int64))])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * self.BLOCK : (block + 1) * self.BLOCK], bitorder="little")
        spot = block * self.BLOCK * 8 + int(np.flatnonzero(bits)[i - int(self.before[block])])
        value = spot - i << self.shift
        for bit in range(self.shift):
            at = i * self.shift + bit
            value |= (int(self.low[at >> 3]) >> (at & 7) & 1) << bit
        return value


def unit_starts(text: str) -> Iterator[np.ndarray]:
    """Code point offsets at which a unit begins, a run of ASCII letters or another code point each, a bounded stretch of the text at a time."""
    inside = False
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((codes | 32) >= 97) & ((codes | 32) <= 122)
        follows = np.concatenate([[inside], letter[:-1]])
        inside = bool(letter[-1])
        yield np.flatnonzero(~(letter & follows)) + at


def boundaries(text: str) -> EliasFano:
    """The n + 1 boundaries of a text's n units: where each begins, and the end."""
    n = sum(len(starts) for starts in unit_starts(text))

    def chunks() -> Iterator[np.ndarray]:
        yield from unit_starts(text)
        yield np.array([len(text)])

    return EliasFano(chunks(), n + 1, len(text))


def cut(seed: str, bounds: EliasFano) -> tuple[int, int, str]:
    """Ends of prefix and middle in code points, and the form that the seed draws."""
    digest = hashlib.sha256(seed.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % len(bounds), h2 % len(bounds)))
    return bounds[a], bounds[b], "plain" if h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"


def distinct_texts(docs: DataFrame, *, id_col: str, text_col: str, part_rows: int) -> DataFrame:
    """The index of distinct texts: key, part, text, and the members, the ids of the documents that have it.

    Texts meet under a 256-bit digest and are compared whole: their set is what a group keeps, so copies are dropped
    before the shuffle and a group of unlike texts would be refused. A text with more than ``part_rows`` documents
    (or a 20,000th of all) is dealt into parts by id, so no group holds many more; there are 20,000 such texts at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    most = max(part_rows, docs.count() // 20_000)
    hot = rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("parts"))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)))
    groups = dealt.groupBy("key", "part").agg(F.collect_set("text").alias("texts"), F.collect_list(F.struct("id")).alias("members"))
    alike = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("unlike texts of one digest")))
    return groups.select("key", "part", alike.alias("text"), "members")


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", part_rows: int = 2000) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    Texts are cut at two boundaries between units, which the digest of ``seed`` and the id draws. The boundaries of a
    text are listed once for each part of its documents, as an Elias-Fano list from which each document's two are selected.

    Null or empty text: plain, n 0, output empty. Text with a control string: plain. Null ids draw like the word null.
    Repeated rows: a row each, with the same cut; rows equal in text and id stay in one group. Long texts: listed a
    million code points at a time. Empty table: empty result. Other columns are not read.
    """
    kind = docs.select(id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

        def batch_of(ids: list, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], names=["id", *types])

        for batch in batches:
            members = batch.column("members")
            id_type = members.type.value_type.field(0).type
            ids: list = []
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                bounds = boundaries(text)
                whole = not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
                for member in members[i].as_py():
                    p, m, form = cut(f"{seed}:{'null' if member['id'] is None else member['id']}", bounds)
                    if whole or form == "plain":
                        rows.append((len(bounds) - 1, "plain", None, None, text))
                    else:
                        prefix, middle, suffix = text[:p], text[p:m], text[m:]
                        output = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                        rows.append((len(bounds) - 1, form, p, m - p, output))
                    ids.append(member["id"])
                    held += len(text)
                    if held > 8 * CHUNK:
                        yield batch_of(ids, rows, id_type)
                        ids, rows, held = [], [], 0
            if rows:
                yield batch_of(ids, rows, id_type)

    index = distinct_texts(docs, id_col=id_col, text_col=text_col, part_rows=part_rows)
    out = index.select("text", "members").mapInArrow(run, f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""

    def between(start: str, end: str | None) -> Column:
        rest = F.substr(output, F.position(F.lit(start), output) + F.lit(len(start)))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
