"""Running values over a key's rows in order, without one task per key.

A tape is ordered within each symbol, and one symbol may hold most rows. Rows are therefore cut
into chunks of the order (an hour of event time, say): values run within a chunk, chunks are
aggregated, and each chunk starts from what the earlier ones have carried over. The carry is a
window over one row per key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000


def chunk_of(ns: Column | str, width: int = HOUR_NS) -> Column:
    """Chunk number of a nanosecond clock."""
    return F.floor((F.col(ns) if isinstance(ns, str) else ns) / width).cast("long")


def running(df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], values: Mapping[str, tuple[str, Column]], *, before: bool = False, reverse: bool = False) -> DataFrame:
    """Adds a running value for each entry of ``values``: name -> (sum | max | min | last, column).

    The order is that of ``chunk`` and, within it, of ``order``; it must be total for sums and lasts to
    be deterministic. ``before``: the row itself is left out. ``reverse``: from the end. ``last`` skips
    nulls; sums of nothing are 0, other values of nothing are null.
    """
    keys = [*by, "_chunk"]
    rows = df.withColumn("_chunk", -chunk if reverse else chunk).withColumns({f"_v_{k}": c for k, (_, c) in values.items()})
    way = [F.desc(c) if reverse else F.asc(c) for c in order]
    local = Window.partitionBy(*keys).orderBy(*way).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    carried = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    place = F.struct(*order)

    totals, carries, local_values, out = [], [], {}, {}
    for name, (kind, _) in values.items():
        v = F.col(f"_v_{name}")
        if kind == "last":
            at = F.when(v.isNotNull(), place)
            totals.append((F.min_by(v, at) if reverse else F.max_by(v, at)).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(carried).alias(f"_c_{name}"))
            local_values[f"_l_{name}"] = F.last(v, ignorenulls=True).over(local)
            out[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
        else:
            totals.append(fold[kind](v).alias(f"_t_{name}"))
            carries.append(fold[kind](f"_t_{name}").over(carried).alias(f"_c_{name}"))
            local_values[f"_l_{name}"] = fold[kind](v).over(local)
            both = (F.col(f"_l_{name}"), F.col(f"_c_{name}"))
            out[name] = F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0)) if kind == "sum" else F.greatest(*both) if kind == "max" else F.least(*both)
    chunks = rows.groupBy(*keys).agg(*totals).select(*keys, *carries)
    joined = rows.withColumns(local_values).join(chunks.withColumnsRenamed({k: f"_j{k}" for k in keys}), _same(keys), "left")
    return joined.select(*df.columns, *[c.alias(k) for k, c in out.items()])


def _same(keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns and their _j copies."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_j{k}"))
    return condition


def previous(df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Adds, for each entry, the column's value in the row before; null in a key's first row."""
    out = running(df, by, chunk, order, {"_prev": ("last", F.struct(*[c.alias(k) for k, c in columns.items()]))}, before=True)
    return out.select(*df.columns, *[F.col(f"_prev.{k}").alias(k) for k in columns])


def numbered(df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number within its key, from 1."""
    return running(df, by, chunk, order, {name: ("sum", F.lit(1).cast("long"))})


def framed(df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], n: int, values: Mapping[str, Callable[[WindowSpec], Column]], *, block: int = 50_000) -> DataFrame:
    """Adds window values over the last ``n`` rows of a key, the row itself included.

    Rows are numbered and dealt into blocks of ``block`` numbers; the n - 1 rows before a block come along and are
    left out of the result, so no task orders more than a block of a key.
    """
    place = F.col("_tm_place") - 1
    home, into = F.floor(place / block), place % block
    blocks = F.when(into >= block - (n - 1), F.array(home, home + 1)).otherwise(F.array(home))
    rows = numbered(df, by, chunk, order, "_tm_place").withColumn("_tm_home", home).withColumn("_tm_block", F.explode(blocks))
    frame = Window.partitionBy(*by, "_tm_block").orderBy("_tm_place").rowsBetween(-(n - 1), 0)
    out = rows.select(*df.columns, (F.col("_tm_block") == F.col("_tm_home")).alias("_tm_own"), *[f(frame).alias(k) for k, f in values.items()])
    return out.where("_tm_own").drop("_tm_own")
