"""The test tables read as tapes: users are symbols, events records, purchases fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import signed_lots, to_units

MINUTE_NS = 60_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ns, seq, kind, tick, k, lots, side, source_ts: one row per event."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.select(
        F.col("user_id").alias("symbol"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("kind"),
        to_units(F.round("value", 2).cast("decimal(18,2)"), F.lit("0.01").cast("decimal(18,2)")).alias("tick"),
        k.alias("k"),
        (k % 7 + 1).alias("lots"),
        F.when(k % 2 == 1, "ask").otherwise("bid").alias("side"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as fills; ``lots`` is signed: a bid adds."""
    t = tape(spark, sf_dir).where("kind = 'purchase'")
    return t.withColumn("lots", signed_lots(F.col("lots"), F.col("side") == "ask"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as level updates of coarse ticks, bids below 20 dollars and asks above; lots 0 removes a level."""
    t = tape(spark, sf_dir).where("kind IN ('view', 'click')")
    return t.select("symbol", F.when(F.col("tick") < 2000, "bid").otherwise("ask").alias("side"), F.floor(F.col("tick") / 100).alias("tick"), "ns", "seq", (F.col("k") % 4).alias("lots"))


#: The same for DuckDB.
TAPE_SQL = """
t AS (SELECT user_id AS symbol, epoch_us(ts) * 1000 AS ns, event_id AS seq, event_type AS kind, round(value * 100)::BIGINT AS tick,
  (props->>'k')::BIGINT AS k, (props->>'k')::BIGINT % 7 + 1 AS lots, CASE WHEN (props->>'k')::BIGINT % 2 = 1 THEN 'ask' ELSE 'bid' END AS side FROM events),
f AS (SELECT symbol, ns, seq, kind, tick, k, CASE WHEN side = 'ask' THEN -lots ELSE lots END AS lots, side FROM t WHERE kind = 'purchase'),
l AS (SELECT symbol, CASE WHEN tick < 2000 THEN 'bid' ELSE 'ask' END AS side, tick // 100 AS tick, ns, seq, k % 4 AS lots FROM t WHERE kind IN ('view', 'click'))
"""
