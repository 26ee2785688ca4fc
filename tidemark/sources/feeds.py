"""Feed adapters: how a venue's lines become records of a tape, and instruments, level updates and trades in ticks and lots.

An adapter is an expression over a line, so validation, exact conversion and ordering are the same for all venues and stay in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tape

#: The record types that carry market data.
MARKET_TYPES = frozenset({"exchangeInfo", "snapshot", "depthUpdate", "aggTrade"})
Get = Callable[[str], Column]


@dataclass(frozen=True)
class FeedAdapter:
    """A venue's feed: ``record`` makes a tape's record (JSON) of a line; null, or what breaks a rule of tapes, is rejected."""

    name: str
    venue: str
    record_types: frozenset[str] = MARKET_TYPES
    record: Callable[[Column], Column] = lambda line: line

    def describe(self) -> dict:
        """What a run's id and manifest tell of the adapter."""
        return {"name": self.name, "venue_label": self.venue, "supported_record_types": sorted(self.record_types)}


@dataclass(frozen=True)
class Feed:
    """``records`` normalized; ``rejected`` lines with reasons; ``instruments``, ``levels`` and ``trades`` of the supported types."""

    records: DataFrame
    rejected: DataFrame
    instruments: DataFrame
    levels: DataFrame
    trades: DataFrame


def flat(kind: str, kinds: Mapping[str, str], symbol: str, time_ms: str, data: Mapping[str, Callable[[Get], Column]]) -> Callable[[Column], Column]:
    """Records of lines that are flat objects.

    ``kind``, ``symbol`` and ``time_ms`` name the line's fields; ``kinds`` has the tape's type for each of the venue's, ``data`` the
    struct that is a type's data, given a function that reads a field as text. A field that is missing is left out; a kind that
    ``kinds`` doesn't name gives no record.
    """

    def record(line: Column) -> Column:
        get = lambda field: F.get_json_object(line, f"$.{field}")
        out = F.lit(None).cast("string")
        for theirs, ours in kinds.items():
            seconds = (get(time_ms).try_cast("decimal(28,6)") / 1000).cast("decimal(38,9)").cast("string")
            whole = F.to_json(F.struct(seconds.alias("ts_local"), get(symbol).alias("symbol"), F.lit(ours).alias("type"), data[ours](get).alias("data")))
            out = F.when(get(kind) == theirs, whole).otherwise(out)
        return out

    return record


def read_feed(lines: DataFrame, adapter: FeedAdapter) -> Feed:
    """Lines (path, line, value) as ``adapter`` reads them.

    Rejected are lines without a record (reason ``unread``), of a market type that the adapter doesn't support
    (``unsupported``), and those that :func:`tape.validate` finds wrong; each keeps its own text. Instruments without a venue get the adapter's.
    """
    # generated, so that each line is rewritten once and not again for every rule that reads it
    made = lines.select("path", "line", F.col("value").alias("_tm_line"), F.explode(F.array(adapter.record(F.col("value")))).alias("value"))
    kind = F.get_json_object("value", "$.type")
    fit = F.lit(True) if adapter.record_types >= MARKET_TYPES else F.coalesce(~kind.isin(*sorted(MARKET_TYPES - adapter.record_types)), F.lit(True))
    checked = tape.validate(made)
    reasons = F.when(F.col("value").isNull(), F.array(F.lit("unread"))).when(~fit, F.array(F.lit("unsupported"))).otherwise(F.col("reasons"))
    checked = checked.withColumn("reasons", reasons)
    rejected = checked.where(F.size("reasons") > 0).select("path", "line", F.col("_tm_line").alias("value"), "reasons")
    records = tape.normalize(checked)
    told = F.when(F.trim("venue") != "", F.col("venue"))
    instruments = tape.specs(records).withColumn("venue", F.coalesce(told, F.lit(adapter.venue)))
    return Feed(records, rejected, instruments, tape.depth_levels(records, instruments), tape.trades(records, instruments))


#: Tapes as they are recorded.
TAPE = FeedAdapter("tape", "tape")
