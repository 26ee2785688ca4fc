"""As-of joins by union and running last value: one shuffle, linear, no candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import HOUR_NS, chunk_of, running


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: Column, right_at: Column, values: Sequence[str], *, forward: bool = False, tie: str = "seq", width: int = HOUR_NS, suffix: str = "_asof") -> DataFrame:
    """``left`` with the ``values`` (and time, as at + suffix) of the matching row of ``right``.

    Backward: the last right row at or before the left one; forward: the first at or after it. Among
    right rows of equal time, the one of the largest ``tie`` counts (forward: the smallest). Rows
    without a match keep nulls. Times are nanoseconds.
    """
    columns = left.columns
    match = F.struct(right_at.alias("at"), *[F.col(v) for v in values])
    kind = right.select(match.alias("m")).schema[0].dataType
    # at equal times right rows come first in the direction that is run through
    low, high = (1, 0) if forward else (0, 1)
    rows = left.select(*by, at.alias("_at"), F.lit(high).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*columns).alias("_left"), F.lit(None).cast(kind).alias("_match"))
    others = right.select(*by, right_at.alias("_at"), F.lit(low).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.lit(None).cast(left.select(F.struct(*columns).alias("m")).schema[0].dataType).alias("_left"), match.alias("_match"))
    both = rows.unionByName(others)
    out = running(both, by, chunk_of("_at", width), ["_at", "_side", "_tie"], {"_found": ("last", F.col("_match"))}, reverse=forward)
    return out.where("_left IS NOT NULL").select(*[F.col(f"_left.{c}").alias(c) for c in columns], F.col("_found.at").alias(f"at{suffix}"), *[F.col(f"_found.{v}").alias(f"{v}{suffix}") for v in values])
