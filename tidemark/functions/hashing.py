"""Checksums and counters that Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the reflected Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def crc32c_table() -> np.ndarray:
    """Remainders of all bytes, from the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1)
    return table


def crc32c(c: Column) -> Column:
    """CRC-32C of a string's UTF-8 bytes, unsigned; null stays null. All rows of a batch advance together, a byte at a time."""

    @F.pandas_udf(T.LongType())
    def run(values: pd.Series) -> pd.Series:
        table, data = crc32c_table(), [b"" if v is None else v.encode() for v in values]
        sizes = np.array([len(d) for d in data])
        joined, starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
        state = np.full(len(data), 0xFFFFFFFF, np.uint32)
        order = np.argsort(-sizes, kind="stable")
        for at in range(sizes.max(initial=0)):
            live = order[: np.searchsorted(-sizes[order], -at, side="left")]
            state[live] = table[(state[live] ^ joined[starts[live] + at]) & 0xFF] ^ (state[live] >> 8)
        return pd.Series((state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)).where(pd.Series([v is not None for v in values]), None).astype("Int64")

    return run(c)


def canonical_json(c: Column, field: str | None = None) -> Column:
    """A JSON text as the canonical one of its value (or of that of its ``field``): names in order at every depth, no white space, numbers in their shortest form, other characters as they are.

    Integers stay exact, other numbers are doubles, and of a name that is given twice the last one counts. Null for what isn't JSON, for NaN and
    infinite numbers, and where a field is asked of what has none.
    """

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def refuse(name: str) -> None:
            raise ValueError(name)

        read = json.JSONDecoder(parse_constant=refuse).decode
        write = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode

        def one(text: str | None) -> str | None:
            try:
                value = read(text) if text is not None else refuse("null")
                return write(value if field is None else value[field])
            except (ValueError, LookupError, TypeError, RecursionError):
                return None

        return values.map(one)

    return run(c)


#: Fixed value: the checksum of what has no payload, that of null.
NO_PAYLOAD = "crc32c:147e9acc"


def payload_checksum(c: Column, field: str | None = None) -> Column:
    """crc32c: and eight hexadecimal digits, of the canonical form of a JSON text or of its field; null where :func:`canonical_json` is."""
    return F.concat(F.lit("crc32c:"), F.lpad(F.lower(F.hex(crc32c(canonical_json(c, field)))), 8, "0"))


def latency_draws(df: DataFrame, number: str, *, seed: int, samples_us: Sequence[int], tail_us: int = 0, tail_per_million: int = 0) -> DataFrame:
    """Adds ``latency_us``: draw ``number`` (from 0) of one SplitMix64 stream, mapped to the samples; a share of draws is the tail value.

    Draws don't depend on each other, so rows are drawn in any order and on any executor.
    """
    from ..operators.research import GAMMA, splitmix64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            states = np.uint64(seed) + (rows[number].to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
            drawn = splitmix64(states)
            latency = np.asarray(samples_us, dtype=np.int64)[(drawn % np.uint64(len(samples_us))).astype(np.int64)]
            in_tail = (drawn >> np.uint64(32)) % np.uint64(1_000_000) < np.uint64(tail_per_million)
            yield rows.assign(latency_us=np.where(in_tail, tail_us, latency))

    schema = T.StructType([*df.schema.fields, T.StructField("latency_us", T.LongType())])
    return df.mapInPandas(run, schema)
