"""Registered queries over feeds: the events as a venue's own lines, read through an adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.feeds import FeedAdapter, Feed, flat, read_feed
from .catalogue import query
from .tape import tape

_level = lambda get: F.array(F.array(get("px"), get("sz")))
_side = lambda get, side: F.when(get("side") == side, _level(get)).otherwise(F.array().cast("array<array<string>>"))

#: A venue with one level or trade a line, in flat objects and milliseconds.
FLAT = FeedAdapter(
    "flat",
    "FLAT_VENUE",
    record=flat(
        "ch",
        {"info": "exchangeInfo", "level": "depthUpdate", "print": "aggTrade"},
        "sym",
        "at",
        {
            "exchangeInfo": lambda get: F.struct(get("tick").alias("tickSize"), get("lot").alias("stepSize")),
            "depthUpdate": lambda get: F.struct(get("id").alias("U"), get("id").alias("u"), _side(get, "bid").alias("b"), _side(get, "ask").alias("a")),
            "aggTrade": lambda get: F.struct(get("px").alias("p"), get("sz").alias("q"), (get("taker") == "sell").alias("m")),
        },
    ),
)


def flat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the lines of that venue: an instrument a symbol, views as levels, clicks as prints, all others as a kind that no tape knows.

    Lots are multiples of half a step, so half of them aren't on the grid.
    """
    t = tape(spark, sf).where("tick >= 0")
    symbol = F.concat(F.lit("S"), F.col("symbol").cast("string"))
    money = lambda c, unit, kind: (c.cast("decimal(18,0)") * F.lit(unit).cast(kind)).cast("string")
    told = F.struct(
        F.when(F.col("kind") == "view", "level").when(F.col("kind") == "click", "print").otherwise("note").alias("ch"), symbol.alias("sym"), F.floor(F.col("ns") / 1_000_000).cast("string").alias("at"), F.col("seq").cast("string").alias("id"),
        money(F.col("tick"), "0.01", "decimal(3,2)").alias("px"), money(F.col("lots"), "0.0005", "decimal(5,4)").alias("sz"), F.col("side").alias("side"), F.when(F.col("side") == "ask", "sell").otherwise("buy").alias("taker"),
    )
    info = F.struct(F.lit("info").alias("ch"), symbol.alias("sym"), F.lit("0").alias("at"), F.lit("0.01").alias("tick"), F.lit("0.001").alias("lot"))
    rows = t.select((F.col("seq") + 1).alias("line"), F.to_json(told).alias("value"))
    infos = t.select("symbol").distinct().select(F.lit(0).cast("long").alias("line"), F.to_json(info).alias("value"))
    return infos.unionByName(rows).select(F.lit("events").alias("path"), "line", "value")


def feed(spark: SparkSession, sf: str) -> Feed:
    return read_feed(flat_lines(spark, sf), FLAT)


@query("""WITH s AS (SELECT DISTINCT symbol FROM t WHERE tick >= 0), v AS (SELECT symbol, count(*) AS n_levels, count(*) FILTER (lots % 2 = 1) AS off_grid, sum(tick) AS ticks, sum(lots // 2) FILTER (lots % 2 = 0) AS level_lots, max(ns // 1000000 * 1000000) AS last_ns FROM t WHERE kind = 'view' AND tick >= 0 GROUP BY symbol),
c AS (SELECT symbol, count(*) AS n_trades, sum(lots // 2) FILTER (lots % 2 = 0) AS traded, count(*) FILTER (side = 'ask') AS sold FROM t WHERE kind = 'click' AND tick >= 0 GROUP BY symbol)
SELECT 'S' || symbol AS symbol, 'FLAT_VENUE' AS venue, coalesce(n_levels, 0) AS n_levels, coalesce(off_grid, 0) AS off_grid, ticks::BIGINT AS ticks, level_lots::BIGINT AS level_lots, last_ns, coalesce(n_trades, 0) AS n_trades, traded::BIGINT AS traded, coalesce(sold, 0) AS sold FROM s LEFT JOIN v USING (symbol) LEFT JOIN c USING (symbol)""")
def feed_levels_and_trades(spark: SparkSession, sf: str) -> DataFrame:
    """What a foreign venue's lines hold in ticks and lots, by symbol."""
    read = feed(spark, sf)
    levels = read.levels.groupBy("symbol").agg(
        F.count("*").alias("n_levels"), F.count_if(F.col("lots").isNull()).alias("off_grid"), F.sum("tick").alias("ticks"), F.sum("lots").alias("level_lots"), F.max("ns").alias("last_ns"),
    )
    trades = read.trades.groupBy("symbol").agg(F.count("*").alias("n_trades"), F.sum("lots").alias("traded"), F.count_if("buyer_is_maker").alias("sold"))
    rows = read.instruments.select("symbol", "venue").join(levels, "symbol", "left").join(trades, "symbol", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_levels", "off_grid", "n_trades", "sold")})


@query("SELECT 'unread' AS reason, count(*) AS n FROM t WHERE kind NOT IN ('view', 'click') AND tick >= 0 HAVING count(*) > 0")
def feed_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that the adapter doesn't read, by reason."""
    return feed(spark, sf).rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
