"""Registered queries: (name, Spark plan, DuckDB SQL or None where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, ticks
from ..functions import options as opt
from ..operators import audit, book, fills, ledger, research
from ..operators.asof import asof
from ..operators.ordered import chunk_of, framed, numbered, previous, running
from ..streaming import book as stream_book
from ..streaming import windows
from .tape import MINUTE_NS, TAPE_SQL, levels, tape
from .tape import fills as fill_rows
from .tape import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR = 60 * MINUTE_NS


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {TAPE_SQL} {sql}" if not sql.lstrip().upper().startswith("WITH") else sql.replace("WITH", f"WITH {TAPE_SQL.rstrip()},", 1)
        return f

    return register


# -- inspection and validity


@query("SELECT kind, count(*) AS n, count(DISTINCT symbol) AS symbols, min(ns) AS first_ns, max(ns) AS last_ns, max(ns) - min(ns) AS duration_ns FROM t GROUP BY kind")
def event_inspect(spark: SparkSession, sf: str) -> DataFrame:
    agg = tape(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"))
    return agg.withColumn("duration_ns", F.greatest(F.lit(0), F.col("last_ns") - F.col("first_ns")))


@query("SELECT kind, symbol, count(*) AS n, sum(lots)::BIGINT AS lots FROM t GROUP BY GROUPING SETS ((kind), (symbol), ())")
def event_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf)
    return t.groupingSets([[F.col("kind")], [F.col("symbol")], []], "kind", "symbol").agg(F.count("*").alias("n"), F.sum("lots").alias("lots"))


@query("""WITH g AS (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY ns, seq) AS p FROM t)
SELECT symbol, coalesce(sum(CASE WHEN seq > p THEN seq - p - 1 END), 0)::BIGINT AS gap_total, count(*) FILTER (seq <= p) AS regressions FROM g GROUP BY symbol""")
def seq_gaps(spark: SparkSession, sf: str) -> DataFrame:
    g = previous(tape(spark, sf), ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], {"p": F.col("seq")})
    gap = F.when(F.col("seq") > F.col("p"), F.col("seq") - F.col("p") - 1).otherwise(0)
    return g.groupBy("symbol").agg(F.sum(gap).alias("gap_total"), F.sum(F.when(F.col("seq") <= F.col("p"), 1).otherwise(0)).alias("regressions"))


@query("""WITH g AS (SELECT *, lag(ns) OVER (PARTITION BY symbol ORDER BY k, seq) AS p FROM t)
SELECT symbol, count(*) FILTER (ns < p) AS regressions, max(CASE WHEN ns >= p THEN ns - p END) AS max_inter_arrival_ns FROM g GROUP BY symbol""")
def clock_regressions(spark: SparkSession, sf: str) -> DataFrame:
    g = previous(tape(spark, sf), ["symbol"], F.floor(F.col("k") / 10).cast("long"), ["k", "seq"], {"p": F.col("ns")})
    return g.groupBy("symbol").agg(F.sum(F.when(F.col("ns") < F.col("p"), 1).otherwise(0)).alias("regressions"), F.max(F.when(F.col("ns") >= F.col("p"), F.col("ns") - F.col("p"))).alias("max_inter_arrival_ns"))


@query("""WITH g AS (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY ns, seq) AS p FROM t)
SELECT symbol, bool_and(p IS NULL OR seq > p) AS seq_ok, bool_and(kind <> 'error') AS no_invalidation, bool_and((p IS NULL OR seq > p) AND kind <> 'error' AND tick >= 0) AS receipt_integrity_ok FROM g GROUP BY symbol""")
def receipt_integrity(spark: SparkSession, sf: str) -> DataFrame:
    g = previous(tape(spark, sf), ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], {"p": F.col("seq")})
    ok = F.col("p").isNull() | (F.col("seq") > F.col("p"))
    return g.groupBy("symbol").agg(F.bool_and(ok).alias("seq_ok"), F.bool_and(F.col("kind") != "error").alias("no_invalidation"), F.bool_and(ok & (F.col("kind") != "error") & (F.col("tick") >= 0)).alias("receipt_integrity_ok"))


@query("SELECT symbol, seq, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ns, seq)::BIGINT AS epoch FROM t")
def epochs(spark: SparkSession, sf: str) -> DataFrame:
    return book.epochs(tape(spark, sf), F.col("kind") == "error").select("symbol", "seq", "epoch")


@query("SELECT symbol, seq, coalesce(last_value(CASE kind WHEN 'error' THEN false WHEN 'signup' THEN true END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ns, seq), true) AS valid FROM t")
def validity_ffill(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.when(F.col("kind") == "error", False).when(F.col("kind") == "signup", True)
    return book.validity(tape(spark, sf), turn).select("symbol", "seq", "valid")


@query("SELECT symbol, seq, max(ns) OVER (PARTITION BY symbol ORDER BY k, seq) AS clamped_ns, ns < max(ns) OVER (PARTITION BY symbol ORDER BY k, seq) AS late FROM t")
def clock_clamp(spark: SparkSession, sf: str) -> DataFrame:
    out = running(tape(spark, sf), ["symbol"], F.floor(F.col("k") / 10).cast("long"), ["k", "seq"], {"clamped_ns": ("max", F.col("ns"))})
    return out.select("symbol", "seq", "clamped_ns", (F.col("ns") < F.col("clamped_ns")).alias("late"))


@query("""WITH w AS (SELECT *, coalesce(last_value(CASE kind WHEN 'error' THEN false WHEN 'signup' THEN true END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ns, seq), true) AS valid,
  max(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ns, seq) AS known FROM t)
SELECT symbol, count(*) AS n, count(*) FILTER (known = 0) AS unknown, count(*) FILTER (known = 1 AND NOT valid) AS dropped FROM w GROUP BY symbol""")
def invalid_epoch_filter(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.when(F.col("kind") == "error", False).when(F.col("kind") == "signup", True)
    w = running(tape(spark, sf), ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], {"valid": ("last", turn), "known": ("max", (F.col("kind") == "signup").cast("int"))})
    valid = F.coalesce("valid", F.lit(True))
    return w.groupBy("symbol").agg(F.count("*").alias("n"), F.sum((F.col("known") == 0).cast("long")).alias("unknown"), F.sum(((F.col("known") == 1) & ~valid).cast("long")).alias("dropped"))


@query("SELECT event_id AS seq, round(value * 100)::BIGINT AS tick, floor(value)::BIGINT AS floor_dollars, ceil(value)::BIGINT AS ceil_dollars, round(value, 0)::BIGINT AS round_dollars FROM events")
def tick_projection(spark: SparkSession, sf: str) -> DataFrame:
    price = F.round("value", 2).cast("decimal(18,2)")
    dollar, cent = F.lit("1").cast("decimal(18,2)"), F.lit("0.01").cast("decimal(18,2)")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), ticks.to_units(price, cent).alias("tick"), *[ticks.to_units(price, dollar, how).alias(f"{how}_dollars") for how in ("floor", "ceil", "round")])


@query("SELECT symbol, seq, CASE WHEN k >= 50 THEN k * 1000000 ELSE k * 1000000000 END AS exchange_ns, CASE WHEN k % 3 = 0 THEN 'row:' || seq ELSE 'cap:' || seq || ':' || k END AS evidence_id FROM t")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf)
    raw = F.when(F.col("k") >= 50, F.col("k").cast("decimal(28,9)") + 1_000_000_000_000).otherwise(F.col("k").cast("decimal(28,9)"))
    exchange = ticks.exchange_ns(raw) - F.when(F.col("k") >= 50, F.lit(1_000_000_000_000 * 1_000_000)).otherwise(F.lit(0))
    capture = F.when(F.col("k") % 3 != 0, "cap")
    return t.select("symbol", "seq", exchange.alias("exchange_ns"), ticks.evidence_id(capture, F.col("seq"), F.col("k").cast("string"), F.col("seq")).alias("evidence_id"))


# -- books


@query("""WITH g AS (SELECT *, coalesce(lag(lots) OVER (PARTITION BY symbol, side, tick ORDER BY ns, seq), 0) AS previous_lots FROM l)
SELECT symbol, side, tick, seq, previous_lots, lots FROM g WHERE lots <> previous_lots""")
def level_changes(spark: SparkSession, sf: str) -> DataFrame:
    return book.level_changes(levels(spark, sf)).select("symbol", "side", "tick", "seq", "previous_lots", "lots")


BOOK_SQL = "b AS (SELECT symbol, side, tick, arg_max(lots, (ns, seq)) AS lots FROM l GROUP BY ALL HAVING arg_max(lots, (ns, seq)) > 0)"


@query(f"""WITH {BOOK_SQL} SELECT symbol, max(tick) FILTER (side = 'bid') AS best_bid, min(tick) FILTER (side = 'ask') AS best_ask, count(*) AS levels,
  (max(tick) FILTER (side = 'bid') + min(tick) FILTER (side = 'ask')) / 2.0::DOUBLE AS mid FROM b GROUP BY symbol""")
def book_best(spark: SparkSession, sf: str) -> DataFrame:
    return book.best(book.book(levels(spark, sf)))


@query(f"""WITH {BOOK_SQL} SELECT symbol, side, tick, lots, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -tick ELSE tick END) AS rank FROM b QUALIFY rank <= 3""")
def top_levels(spark: SparkSession, sf: str) -> DataFrame:
    return book.top_levels(book.book(levels(spark, sf)), 3)


@query("SELECT symbol, side, tick, seq, coalesce(sum(lots) OVER (PARTITION BY symbol, side, tick ORDER BY ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM l")
def queue_ahead(spark: SparkSession, sf: str) -> DataFrame:
    return book.queue_ahead(levels(spark, sf)).select("symbol", "side", "tick", "seq", "ahead")


@query("""WITH e AS (SELECT symbol, side, tick // 500 AS tick, ns, seq, CASE kind WHEN 'view' THEN lots ELSE -lots END AS delta FROM t WHERE kind IN ('view', 'purchase')),
x AS (SELECT *, sum(delta) OVER w AS free, coalesce(sum(CASE WHEN delta < 0 THEN -delta END) OVER w, 0) AS before, coalesce(sum(CASE WHEN delta < 0 THEN -delta END) OVER (PARTITION BY symbol, side, tick), 0) AS total FROM e WINDOW w AS (PARTITION BY symbol, side, tick ORDER BY ns, seq)),
q AS (SELECT *, free - delta - least(0, coalesce(min(free) OVER (PARTITION BY symbol, side, tick ORDER BY ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ahead FROM x)
SELECT symbol, side, tick, seq, delta AS lots, ahead::BIGINT AS ahead, greatest(0, least(delta, total - before - ahead))::BIGINT AS filled FROM q WHERE delta > 0""")
def queue_fills(spark: SparkSession, sf: str) -> DataFrame:
    rest, take = (tape(spark, sf).where(F.col("kind") == kind).withColumn("tick", F.floor(F.col("tick") / 500)).select("symbol", "side", "tick", "ns", "seq", "lots") for kind in ("view", "purchase"))
    return book.queue_fills(rest, take)


@query(f"""WITH {BOOK_SQL}, o AS (SELECT symbol, seq AS order_id, side, CASE side WHEN 'bid' THEN 200 ELSE 0 END AS limit_tick, abs(lots) AS lots FROM f),
p AS (SELECT symbol, CASE side WHEN 'bid' THEN 'ask' ELSE 'bid' END AS side, tick, lots AS level_lots,
  coalesce(sum(lots) OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -tick ELSE tick END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM b)
SELECT o.symbol, order_id, o.side, tick, least(level_lots, o.lots - ahead)::BIGINT AS fill_lots FROM o JOIN p USING (symbol, side)
WHERE ahead < o.lots AND CASE o.side WHEN 'bid' THEN tick <= limit_tick ELSE tick >= limit_tick END""")
def taker_sweep(spark: SparkSession, sf: str) -> DataFrame:
    o = fill_rows(spark, sf).select("symbol", F.col("seq").alias("order_id"), "side", F.when(F.col("side") == "bid", 200).otherwise(0).alias("limit_tick"), F.abs("lots").alias("lots"))
    return book.sweep(o, book.book(levels(spark, sf)))


@query("""WITH g AS (SELECT *, coalesce(lag(lots) OVER (PARTITION BY symbol, side, tick ORDER BY ns, seq), 0) AS p FROM l), d AS (SELECT * FROM g WHERE lots < p), r AS (SELECT symbol, CASE WHEN tick < 2000 THEN 'bid' ELSE 'ask' END AS side, tick // 100 AS tick, ns, seq, lots FROM t WHERE kind = 'purchase')
SELECT d.symbol, d.side, d.tick, d.seq AS depth_seq, r.seq AS trade_seq, d.ns - r.ns AS age_ns FROM d JOIN r ON d.symbol = r.symbol AND d.side = r.side AND d.tick = r.tick AND d.ns BETWEEN r.ns AND r.ns + 864000000000000""")
def overlap_candidates(spark: SparkSession, sf: str) -> DataFrame:
    trades = tape(spark, sf).where("kind = 'purchase'").select("symbol", F.when(F.col("tick") < 2000, "bid").otherwise("ask").alias("side"), F.floor(F.col("tick") / 100).alias("tick"), "ns", "seq", "lots")
    met = book.overlap_candidates(book.level_changes(levels(spark, sf)).where("lots < previous_lots"), trades, 240 * HOUR)
    return met.select("symbol", "side", "tick", "depth_seq", "trade_seq", (F.col("depth_ns") - F.col("trade_ns")).alias("age_ns"))


#: Signals of a level one after the other, each against the credits that are left when it comes.
NETTING_SQL = """WITH RECURSIVE s AS (SELECT symbol, side, tick // 500 AS tick, ns, seq, CASE kind WHEN 'view' THEN 'depth' ELSE 'trade' END AS source, lots, row_number() OVER (PARTITION BY symbol, side, tick // 500 ORDER BY ns, seq) AS n
  FROM t WHERE kind IN ('view', 'purchase')),
r AS (SELECT symbol, side, tick, n, seq, source, lots, 0::BIGINT AS netted, [{'ns': ns, 'source': source, 'rest': lots}] AS credits FROM s WHERE n = 1
UNION ALL
SELECT symbol, side, tick, n, seq, source, lots, coalesce(list_sum(used), 0)::BIGINT AS netted,
  list_concat(list_transform(live, lambda c, i: {'ns': c.ns, 'source': c.source, 'rest': c.rest - used[i]}), CASE WHEN lots > coalesce(list_sum(used), 0) THEN [{'ns': ns, 'source': source, 'rest': (lots - coalesce(list_sum(used), 0))::BIGINT}] ELSE [] END) AS credits
FROM (SELECT *, list_transform(live, lambda c, i: CASE WHEN c.source = source THEN 0 ELSE greatest(0, least(c.rest, lots - coalesce(list_sum(list_transform(live[1:i - 1], lambda d: CASE WHEN d.source = source THEN 0 ELSE d.rest END)), 0)))::BIGINT END) AS used
  FROM (SELECT s.*, list_filter(r.credits, lambda c: c.rest > 0 AND s.ns - c.ns <= 86400000000000) AS live FROM r JOIN s ON s.symbol = r.symbol AND s.side = r.side AND s.tick = r.tick AND s.n = r.n + 1)))"""


@query(f"SELECT * FROM ({NETTING_SQL} SELECT symbol, side, tick, seq, source, lots, netted, lots - netted AS modeled FROM r)")
def overlap_netting(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf).where("kind IN ('view', 'purchase')")
    signals = t.select("symbol", "side", F.floor(F.col("tick") / 500).alias("tick"), "ns", "seq", F.when(F.col("kind") == "view", "depth").otherwise("trade").alias("source"), "lots")
    return book.overlap_netting(signals, 24 * HOUR).select("symbol", "side", "tick", "seq", "source", "lots", "netted", "modeled")


@query("""WITH e AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ns, seq) AS epoch FROM t),
s AS (SELECT symbol, epoch, min(seq) AS snapshot_id FROM e WHERE kind = 'signup' GROUP BY ALL),
d AS (SELECT symbol, epoch, ns, seq, seq - 3000 AS first_id, seq AS last_id FROM e WHERE kind = 'view')
SELECT s.symbol, s.epoch::BIGINT AS epoch, snapshot_id, arg_min(seq, (ns, seq)) AS bridge_seq, arg_min(first_id, (ns, seq)) AS first_id, arg_min(last_id, (ns, seq)) AS last_id FROM s JOIN d ON s.symbol = d.symbol AND s.epoch = d.epoch AND first_id <= snapshot_id AND snapshot_id <= last_id GROUP BY ALL""")
def snapshot_bridge(spark: SparkSession, sf: str) -> DataFrame:
    e = book.epochs(tape(spark, sf), F.col("kind") == "error")
    snapshots = e.where("kind = 'signup'").groupBy("symbol", "epoch").agg(F.min("seq").alias("snapshot_id"))
    depth = e.where("kind = 'view'").select("symbol", "epoch", "ns", "seq", (F.col("seq") - 3000).alias("first_id"), F.col("seq").alias("last_id"))
    return book.bridges(snapshots, depth)


# -- features


@query("""SELECT symbol, seq, sum(CASE WHEN side = 'ask' THEN -lots ELSE lots END) OVER w::BIGINT AS signed_lots, sum(lots) OVER w::BIGINT AS total_lots,
  round(sum(CASE WHEN side = 'ask' THEN -lots ELSE lots END) OVER w / sum(lots) OVER w::DOUBLE, 9) AS imbalance FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ns, seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def imbalance_window(spark: SparkSession, sf: str) -> DataFrame:
    lots = ticks.signed_lots(F.col("lots"), F.col("side") == "ask")
    out = framed(tape(spark, sf), ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], 12, {"signed_lots": lambda w: F.sum(lots).over(w), "total_lots": lambda w: F.sum("lots").over(w)})
    return out.select("symbol", "seq", "signed_lots", "total_lots", F.round(F.col("signed_lots") / F.col("total_lots"), 9).alias("imbalance"))


@query("""WITH r AS (SELECT *, CASE WHEN lag(tick) OVER p > 0 THEN abs(tick - lag(tick) OVER p) / lag(tick) OVER p::DOUBLE END AS ret FROM t WHERE kind = 'view' WINDOW p AS (PARTITION BY symbol ORDER BY ns, seq))
SELECT symbol, seq, round(coalesce(avg(ret) OVER (PARTITION BY symbol ORDER BY ns, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0), 9) AS volatility FROM r""")
def rolling_vol(spark: SparkSession, sf: str) -> DataFrame:
    day = chunk_of("ns", 24 * HOUR)
    views = previous(tape(spark, sf).where("kind = 'view'"), ["symbol"], day, ["ns", "seq"], {"before": F.col("tick")})
    ret = views.withColumn("ret", ticks.absolute_return(F.col("before"), F.col("tick")))
    out = framed(ret, ["symbol"], day, ["ns", "seq"], 30, {"mean": lambda w: F.avg("ret").over(w)})
    return out.select("symbol", "seq", F.round(F.coalesce("mean", F.lit(0.0)), 9).alias("volatility"))


@query("""WITH r AS (SELECT *, CASE WHEN lag(tick) OVER p > 0 AND tick > 0 THEN ln(tick / lag(tick) OVER p::DOUBLE) END AS ret FROM t WHERE kind = 'view' WINDOW p AS (PARTITION BY symbol ORDER BY ns, seq))
SELECT symbol, seq, round(greatest(0.01, coalesce(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ns, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0) * sqrt(252)), 6) AS realized_vol FROM r""")
def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    day = chunk_of("ns", 24 * HOUR)
    views = previous(tape(spark, sf).where("kind = 'view'"), ["symbol"], day, ["ns", "seq"], {"before": F.col("tick")})
    ret = views.withColumn("ret", ticks.log_return(F.col("before"), F.col("tick")))
    out = framed(ret, ["symbol"], day, ["ns", "seq"], 30, {"dev": lambda w: F.stddev_samp("ret").over(w)})
    return out.select("symbol", "seq", F.round(F.greatest(F.lit(0.01), F.coalesce("dev", F.lit(0.0)) * 252**0.5), 6).alias("realized_vol"))


REGIME_SQL = """r AS (SELECT *, k % 5 AS spread, (lots - 4) / 4.0 AS lean FROM t),
g AS (SELECT *, CASE WHEN spread <= 1 THEN 'tight' WHEN spread <= 3 THEN 'normal' ELSE 'wide' END || '_' || CASE WHEN lean >= 0.35 THEN 'strong_buy' WHEN lean <= -0.35 THEN 'strong_sell' WHEN lean >= 0.15 THEN 'buy' WHEN lean <= -0.15 THEN 'sell' ELSE 'balanced' END AS regime FROM r)"""


@query(f"WITH {REGIME_SQL} SELECT regime, count(*) AS fills, sum(lots)::BIGINT AS qty, round(sum(tick * lots) / sum(lots)::DOUBLE, 6) AS capture, round(count(*) FILTER (k < 30) / count(*)::DOUBLE, 9) AS adverse_rate FROM g GROUP BY regime")
def regime(spark: SparkSession, sf: str) -> DataFrame:
    g = tape(spark, sf).withColumn("regime", ticks.regime(F.col("k") % 5, (F.col("lots") - 4) / 4.0))
    return g.groupBy("regime").agg(F.count("*").alias("fills"), F.sum("lots").alias("qty"), F.round(fills.weighted(F.col("tick"), F.col("lots")), 6).alias("capture"), F.round(F.avg((F.col("k") < 30).cast("double")), 9).alias("adverse_rate"))


@query("""SELECT seq, CASE WHEN (k - 50) / 50.0 >= 0.3 AND (lots - 4) / 4.0 >= 0.3 THEN 'buy_pressure' WHEN (k - 50) / 50.0 <= -0.3 AND (lots - 4) / 4.0 <= -0.3 THEN 'sell_pressure' ELSE 'neutral' END AS gate,
  floor(tick - greatest(1.0, tick * 5.0 * (1 + k / 100.0 * 2.0) / 10000) - (lots - 4) * 3.0 / 10000 * tick + 0.5)::BIGINT AS bid_tick,
  floor(tick + greatest(1.0, tick * 5.0 * (1 + k / 100.0 * 2.0) / 10000) + (lots - 4) * 3.0 / 10000 * tick + 0.5)::BIGINT AS ask_tick FROM (SELECT seq, k::DOUBLE AS k, lots::DOUBLE AS lots, tick::DOUBLE AS tick FROM t)""")
def quotes(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf).select("seq", *[F.col(c).cast("double").alias(c) for c in ("k", "lots", "tick")])
    bid, ask = ticks.baseline_quotes(F.col("tick"), F.col("lots") - 4, F.col("k") / 100.0, half_spread_bps=5.0, skew_bps=3.0, volatility_factor=2.0)
    return t.select("seq", ticks.gate((F.col("k") - 50) / 50.0, (F.col("lots") - 4) / 4.0, 0.3).alias("gate"), bid.alias("bid_tick"), ask.alias("ask_tick"))


GATED_SQL = """g AS (SELECT seq, tick::DOUBLE AS mid, (lots - 4) * 0.5::DOUBLE AS skew, k / 100.0::DOUBLE AS vol, (k - 50) / 50.0::DOUBLE AS book, (lots - 4) / 4.0::DOUBLE AS trade, k % 4 AS gate FROM t),
q AS (SELECT *, (book + trade) / 2 AS combined, CASE WHEN gate <= 0 THEN 'neutral' WHEN book >= 0.3::DOUBLE AND trade >= 0.3::DOUBLE THEN 'bullish' WHEN book <= -0.3::DOUBLE AND trade <= -0.3::DOUBLE THEN 'bearish' ELSE 'neutral' END AS label,
  CASE WHEN gate <= 0 THEN 'gate_size_zero' WHEN book >= 0.3::DOUBLE AND trade >= 0.3::DOUBLE THEN 'book_and_trade_buy_pressure_agree' WHEN book <= -0.3::DOUBLE AND trade <= -0.3::DOUBLE THEN 'book_and_trade_sell_pressure_agree'
    WHEN abs(book) >= 0.3::DOUBLE OR abs(trade) >= 0.3::DOUBLE THEN 'only_one_signal_strong_or_signals_disagree' ELSE 'below_threshold' END AS reason FROM g),
x AS (SELECT *, CASE label WHEN 'bearish' THEN gate ELSE 0 END AS down, CASE label WHEN 'bullish' THEN gate ELSE 0 END AS up FROM q)"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    t = tape(spark, sf).select("seq", d("tick").alias("mid"), ((d("lots") - 4) * 0.5).alias("skew"), (d("k") / 100).alias("vol"), ((d("k") - 50) / 50).alias("book"), ((d("lots") - 4) / 4).alias("trade"), (F.col("k") % 4).alias("ticks"))
    label, reason, active = ticks.gate_details(F.col("book"), F.col("trade"), 0.3, F.col("ticks"))
    return t.withColumns({"label": label, "reason": reason, "gate": active})


_LADDER = """n AS (SELECT *, floor(mid - skew - near - down + 0.5)::BIGINT AS bid, floor(mid - skew + near + up + 0.5)::BIGINT AS ask FROM h),
w AS (SELECT *, least(floor(mid - skew - wide - down + 0.5)::BIGINT, bid - 1) AS far_bid, greatest(floor(mid - skew + wide + up + 0.5)::BIGINT, ask + 1) AS far_ask FROM n)
SELECT seq, label, reason, CASE WHEN bid < ask THEN bid END AS bid, CASE WHEN bid < ask THEN ask END AS ask, CASE WHEN bid < ask THEN far_bid END AS far_bid, CASE WHEN bid < ask THEN far_ask END AS far_ask FROM w"""


@query(f"WITH {GATED_SQL}, h AS (SELECT *, greatest(1.0::DOUBLE, mid * 5.0::DOUBLE * (1 + vol * 2.0::DOUBLE) / 10000) AS near, greatest(greatest(1.0::DOUBLE, mid * 5.0::DOUBLE * (1 + vol * 2.0::DOUBLE) / 10000), mid * 12.0::DOUBLE * (1 + vol * 2.0::DOUBLE) / 10000) AS wide FROM x), {_LADDER}")
def layered_quotes(spark: SparkSession, sf: str) -> DataFrame:
    g = _gated(spark, sf)
    found = ticks.layered_quotes(*[F.col(c) for c in ("mid", "skew", "vol", "label", "gate")], inner_bps=5.0, outer_bps=12.0, volatility_factor=2.0)
    return g.select("seq", "label", "reason", *[c.alias(k) for k, c in zip(("bid", "ask", "far_bid", "far_ask"), found, strict=True)])


@query(f"""WITH {GATED_SQL}, s AS (SELECT *, greatest(0.0::DOUBLE, 5.0::DOUBLE * (1 + vol * 2.0::DOUBLE) + abs(combined) * 4.0::DOUBLE, 6.0::DOUBLE) AS half FROM x), y AS (SELECT *, greatest(1.0::DOUBLE, mid * half / 10000) AS near FROM s),
h AS (SELECT *, greatest(near + 1, mid * greatest(12.0::DOUBLE, half * 2) / 10000) AS wide FROM y), {_LADDER}""")
def research_quotes(spark: SparkSession, sf: str) -> DataFrame:
    g = _gated(spark, sf).withColumn("combined", (F.col("book") + F.col("trade")) / 2)
    found = ticks.research_quotes(*[F.col(c) for c in ("mid", "skew", "vol", "combined", "label", "gate")], half_bps=5.0, outer_bps=12.0, volatility_factor=2.0, toxicity_factor=4.0, floor_bps=6.0)
    return g.select("seq", "label", "reason", *[c.alias(k) for k, c in zip(("bid", "ask", "far_bid", "far_ask"), found, strict=True)])


@query("""SELECT seq, round(CASE WHEN side = 'bid' THEN k * 30 - tick ELSE tick - k * 30 END * lots, 6)::BIGINT AS capture, round(tick * lots * (k % 7 - 2) / 10000.0::DOUBLE, 9) AS fee, round((k - lots) / (k + lots)::DOUBLE, 9) AS imbalance, round(tick / 100.0::DOUBLE, 2) AS price,
  CASE WHEN k % 2 = 0 THEN k || 's' ELSE (k * 1000 + 1) || 'ms' END AS horizon, greatest(0.0::DOUBLE, k % 7 - 2) + 0.5::DOUBLE AS floor_bps, round_even(k * 62.5::DOUBLE, 0)::BIGINT AS latency_us FROM t""")
def fill_features(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar rules of fills: capture, fees and rebates, imbalance, prices of ticks, labels of horizons, fee floors, and microseconds rounded half to even."""
    c = F.col
    bps = c("k") % 7 - 2
    return tape(spark, sf).select(
        "seq", ticks.spread_capture(c("side"), c("k") * 30, c("tick"), c("lots")).alias("capture"), F.round(ticks.fee(c("tick"), c("lots"), F.lit(1), bps).cast("double"), 9).alias("fee"),
        F.round(ticks.imbalance(c("k"), c("lots")), 9).alias("imbalance"), ticks.from_units(c("tick"), F.lit("0.01").cast("decimal(18,2)")).cast("double").alias("price"),
        ticks.horizon_label(F.when(c("k") % 2 == 0, c("k") * 1000).otherwise(c("k") * 1000 + 1)).alias("horizon"), ticks.fee_floor_bps(bps, F.lit(0.5)).alias("floor_bps"), ticks.ms_to_us(c("k") * 0.0625).alias("latency_us"),
    )


# -- as-of joins and markouts


@query("SELECT f.symbol, f.seq, m.tick AS mark_asof, m.ns AS at_asof FROM f ASOF LEFT JOIN (SELECT * FROM t WHERE kind = 'view') m ON f.symbol = m.symbol AND m.ns >= f.ns + 21600000000000")
def markout_forward(spark: SparkSession, sf: str) -> DataFrame:
    views = tape(spark, sf).where("kind = 'view'").select("symbol", "ns", "seq", F.col("tick").alias("mark"))
    return asof(fill_rows(spark, sf), views, ["symbol"], F.col("ns") + 6 * HOUR, F.col("ns"), ["mark"], forward=True).select("symbol", "seq", "mark_asof", "at_asof")


@query("SELECT f.symbol, f.seq, m.tick AS mark_asof, m.ns AS at_asof FROM f ASOF LEFT JOIN (SELECT * FROM t WHERE kind = 'view') m ON f.symbol = m.symbol AND m.ns <= f.ns")
def mid_backward(spark: SparkSession, sf: str) -> DataFrame:
    views = tape(spark, sf).where("kind = 'view'").select("symbol", "ns", "seq", F.col("tick").alias("mark"))
    return asof(fill_rows(spark, sf), views, ["symbol"], F.col("ns"), F.col("ns"), ["mark"]).select("symbol", "seq", "mark_asof", "at_asof")


HORIZON_SQL = """h AS (SELECT unnest([3600000000000, 21600000000000, 86400000000000]) AS horizon_ns), d AS (SELECT f.*, horizon_ns, f.ns + horizon_ns AS due FROM f, h),
v AS (SELECT * FROM t WHERE kind = 'view'), m AS (SELECT d.*, v.tick AS mark, v.ns AS mark_ns, CASE WHEN d.side = 'bid' THEN v.tick - d.tick ELSE d.tick - v.tick END AS markout FROM d ASOF LEFT JOIN v ON d.symbol = v.symbol AND v.ns >= d.due)"""
HORIZONS = (HOUR, 6 * HOUR, 24 * HOUR)


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    views = tape(spark, sf).where("kind = 'view'").select("symbol", "ns", "seq", F.col("tick").alias("mark"))
    return fills.markouts(fill_rows(spark, sf), views, HORIZONS)


@query(f"""WITH {HORIZON_SQL} SELECT horizon_ns, count(mark) AS resolved, count(*) - count(mark) AS unresolved, round(count(mark) / count(*)::DOUBLE, 9) AS coverage,
  (sum(mark_ns - due) // count(mark))::BIGINT AS mean_lag_ns, max(mark_ns - due) AS max_lag_ns, round(sum(markout * abs(lots)) / sum(abs(lots)) FILTER (mark IS NOT NULL)::DOUBLE, 9) AS markout FROM m GROUP BY horizon_ns""")
def markout_horizons(spark: SparkSession, sf: str) -> DataFrame:
    m, resolved = _marked(spark, sf), F.col("status") == "resolved"
    qty = F.when(resolved, F.abs("lots"))
    return m.groupBy("horizon_ns").agg(
        F.count_if(resolved).alias("resolved"), F.count_if(~resolved).alias("unresolved"), F.round(F.count_if(resolved) / F.count("*"), 9).alias("coverage"),
        F.expr("sum(cast(lag_ns AS decimal(19,0))) div count(lag_ns)").alias("mean_lag_ns"), F.max("lag_ns").alias("max_lag_ns"), F.round(F.sum(F.col("markout") * qty) / F.sum(qty), 9).alias("markout"),
    )


@query(f"""WITH {HORIZON_SQL}, s AS (SELECT * FROM (VALUES ('bid'), ('ask'), ('cross')) AS x(side))
SELECT s.side, count(m.mark) AS samples, count(*) FILTER (m.markout < 0) AS adverse FROM s LEFT JOIN m ON s.side = m.side GROUP BY s.side""")
def zero_filled_sources(spark: SparkSession, sf: str) -> DataFrame:
    m = _marked(spark, sf)
    return fills.zero_filled(m, "side", ["bid", "ask", "cross"], {"samples": F.count("markout"), "adverse": F.count_if(F.col("adverse"))})


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS step FROM f), n AS (SELECT symbol, max(step) AS last FROM s GROUP BY symbol),
m AS (SELECT s.symbol, s.step, (r.tick - s.tick) * s.lots AS markout FROM s JOIN n USING (symbol) JOIN s r ON r.symbol = s.symbol AND r.step = least(s.step + 5, n.last))
SELECT symbol, step, markout::BIGINT AS markout, sum(markout) OVER (PARTITION BY symbol ORDER BY step)::BIGINT AS cumulative FROM m""")
def step_markouts(spark: SparkSession, sf: str) -> DataFrame:
    s = numbered(fill_rows(spark, sf), ["symbol"], chunk_of("ns"), ["ns", "seq"], "step")
    return research.step_markouts(s, 5)


@query("""WITH e AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ns, seq)::BIGINT AS epoch FROM t), n AS (SELECT symbol, max(epoch) AS last_epoch FROM e GROUP BY symbol),
h AS (SELECT unnest([3600000000000, 21600000000000, 86400000000000]) AS horizon_ns), d AS (SELECT e.*, horizon_ns, e.ns + horizon_ns AS due FROM e, h WHERE kind = 'purchase'), v AS (SELECT * FROM e WHERE kind = 'view'),
m AS (SELECT d.*, v.tick AS mark, v.ns AS mark_ns, n.last_epoch, CASE WHEN d.side = 'bid' THEN v.tick - d.tick ELSE d.tick - v.tick END AS markout FROM d JOIN n ON d.symbol = n.symbol ASOF LEFT JOIN v ON d.symbol = v.symbol AND d.epoch = v.epoch AND v.ns >= d.due)
SELECT horizon_ns, count(mark) AS resolved, count(*) FILTER (mark IS NULL AND epoch < last_epoch) AS invalidated, count(*) - count(mark) AS unresolved, count(*) FILTER (markout < 0) AS adverse,
  round(count(mark) / count(*)::DOUBLE, 9) AS coverage, max(mark_ns - due) AS max_lag_ns, round(sum(markout * lots) / sum(lots) FILTER (mark IS NOT NULL)::DOUBLE, 9) AS markout FROM m GROUP BY horizon_ns""")
def markout_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Horizons take marks of their fill's epoch only; what is open at its end is invalidated and stays unresolved."""
    e = book.epochs(tape(spark, sf), F.col("kind") == "error")
    views = e.where("kind = 'view'").select("symbol", "epoch", "ns", "seq", F.col("tick").alias("mark"))
    m = fills.markouts(e.where("kind = 'purchase'"), views, HORIZONS, e.groupBy("symbol").agg(F.max("epoch").alias("last_epoch")))
    is_, qty = lambda status: F.col("status") == status, F.when(F.col("status") == "resolved", F.col("lots"))
    return m.groupBy("horizon_ns").agg(
        F.count_if(is_("resolved")).alias("resolved"), F.count_if(is_("invalidated")).alias("invalidated"), F.count_if(~is_("resolved")).alias("unresolved"), F.count_if(F.col("adverse")).alias("adverse"),
        F.round(F.count_if(is_("resolved")) / F.count("*"), 9).alias("coverage"), F.max("lag_ns").alias("max_lag_ns"), F.round(F.sum(F.col("markout") * qty) / F.sum(qty), 9).alias("markout"),
    )


# -- accounting


_CLOSED = "CASE WHEN sign(s.lots) * sign(x.lots) < 0 THEN least(abs(s.lots), abs(x.lots)) ELSE 0 END"
_PART = f"CASE WHEN ({_CLOSED}) = abs(s.lots) THEN s.cost ELSE (abs(s.cost) * ({_CLOSED}) // greatest(abs(s.lots), 1)) * sign(s.cost) END"


FOLD_SQL = f"""c AS (SELECT symbol, list({{'lots': lots::BIGINT, 'cost': 0::BIGINT, 'realized': 0::BIGINT, 'tick': tick}} ORDER BY ns, seq) AS r FROM f GROUP BY symbol),
z AS (SELECT symbol, len(r) AS fills, list_reduce(list_prepend({{'lots': 0::BIGINT, 'cost': 0::BIGINT, 'realized': 0::BIGINT, 'tick': 0::BIGINT}}, r),
  lambda s, x: {{'lots': (s.lots + x.lots)::BIGINT, 'cost': (s.cost - ({_PART}) + (x.lots + sign(s.lots) * ({_CLOSED})) * x.tick)::BIGINT, 'realized': (s.realized + sign(s.lots) * ({_CLOSED}) * x.tick - ({_PART}))::BIGINT, 'tick': 0::BIGINT}}) AS v FROM c)"""


@query(f"""WITH {FOLD_SQL}
SELECT symbol, fills, v.lots AS lots, v.cost AS cost, v.realized AS realized FROM z""")
def position_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fills.position(fill_rows(spark, sf))


MARKED_SQL = f"""{BOOK_SQL}, {FOLD_SQL}, m AS (SELECT symbol, (max(tick) FILTER (side = 'bid') + min(tick) FILTER (side = 'ask')) / 2.0::DOUBLE * 100 AS mid FROM b GROUP BY symbol),
u AS (SELECT z.symbol, z.v.lots AS lots, z.v.realized AS realized, CASE WHEN z.v.lots = 0 THEN 0.0::DOUBLE ELSE z.v.lots * m.mid - z.v.cost END AS unrealized FROM z LEFT JOIN m ON z.symbol = m.symbol)"""


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    marks = book.best(book.book(levels(spark, sf))).select("symbol", (F.col("mid") * 100).alias("mid"))
    return fills.pnl(fills.position(fill_rows(spark, sf)), marks)


@query(f"WITH {MARKED_SQL} SELECT symbol, lots, realized, unrealized, realized + unrealized AS total FROM u")
def pnl(spark: SparkSession, sf: str) -> DataFrame:
    return _valued(spark, sf).select("symbol", "lots", "realized", "unrealized", "total")


@query(f"""WITH {MARKED_SQL} SELECT sum(realized)::BIGINT AS realized, CASE WHEN count(*) = count(unrealized) THEN sum(unrealized) END::DOUBLE AS unrealized,
  CASE WHEN count(*) = count(unrealized) THEN sum(realized + unrealized) END::DOUBLE AS total, count(*) - count(unrealized) AS unpriced FROM u""")
def portfolio_pnl(spark: SparkSession, sf: str) -> DataFrame:
    return fills.portfolio_pnl(_valued(spark, sf))


@query("""WITH p AS (SELECT *, sum(lots) OVER (PARTITION BY symbol ORDER BY ns, seq) AS position FROM f)
SELECT symbol, round(avg(position), 9) AS mean, round(stddev_samp(position), 9) AS stdev, max(abs(position))::BIGINT AS largest FROM p GROUP BY symbol""")
def inventory_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = fills.inventory_stats(fills.inventory(fill_rows(spark, sf)), "position")
    return out.select("symbol", F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev"), "largest")


@query("""WITH p AS (SELECT *, sum(lots) OVER (PARTITION BY symbol ORDER BY ns, seq) AS position FROM f),
g AS (SELECT *, lag(position) OVER w AS v, ns - lag(ns) OVER w AS d FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ns, seq))
SELECT symbol, sum(v * d)::DOUBLE / sum(d)::DOUBLE AS mean, sum(abs(v) * d)::DOUBLE / sum(d)::DOUBLE AS mean_absolute FROM g WHERE d IS NOT NULL GROUP BY symbol""")
def time_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fills.time_weighted(fills.inventory(fill_rows(spark, sf)), "position")


EQUITY_SQL = "q AS (SELECT *, (k - 50) * lots AS delta, sum((k - 50) * lots) OVER (PARTITION BY symbol ORDER BY ns, seq) AS equity FROM f)"


def _equity(spark: SparkSession, sf: str) -> DataFrame:
    f = fill_rows(spark, sf).withColumn("delta", (F.col("k") - 50) * F.col("lots"))
    return running(f, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"equity": ("sum", F.col("delta"))})


@query(f"""WITH {EQUITY_SQL}, m AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY ns, seq)) AS pk FROM q)
SELECT symbol, max(pk)::BIGINT AS peak, arg_max(equity, (ns, seq))::BIGINT AS final, max(pk - equity)::BIGINT AS max_drawdown FROM m GROUP BY symbol""")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return fills.drawdown(_equity(spark, sf), "equity")


@query(f"""WITH {EQUITY_SQL}, m AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY ns, seq)) - equity AS dd FROM q)
SELECT symbol, min(ns) AS halt_ns, arg_min(seq, (ns, seq)) AS halt_seq FROM m WHERE dd > 400 GROUP BY symbol""")
def kill_switch(spark: SparkSession, sf: str) -> DataFrame:
    return fills.halts(_equity(spark, sf), "equity", 400)


@query(f"""WITH {EQUITY_SQL}, i AS (SELECT *, sum(CASE WHEN delta < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ns, seq) AS island FROM q),
r AS (SELECT symbol, island, count(*) FILTER (delta < 0) AS run FROM i GROUP BY ALL) SELECT symbol, max(run) AS max_loss_streak FROM r GROUP BY symbol""")
def loss_streak(spark: SparkSession, sf: str) -> DataFrame:
    return fills.loss_streak(_equity(spark, sf), "delta")


@query("SELECT l_suppkey, l_linestatus, sum((l_extendedprice * 100)::BIGINT)::BIGINT AS notional_cents, round(sum((l_extendedprice * 100)::BIGINT * CASE WHEN l_returnflag = 'R' THEN 4 ELSE -1 END) / 1000000.0::DOUBLE, 6) AS fees FROM lineitem GROUP BY ALL")
def fee_notional(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    bps = F.when(F.col("l_returnflag") == "R", 4).otherwise(-1)
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.sum(cents).alias("notional_cents"), F.round(F.sum(ticks.fee(cents.cast("decimal(18,0)"), F.lit(1), F.lit(1), bps)).cast("double") / 100, 6).alias("fees"))


@query("SELECT kind, round(sum(tick * lots) / sum(lots)::DOUBLE, 6) AS average_tick, round(count(*) FILTER (k < 50) / count(*)::DOUBLE, 9) AS low_rate, max(lots) AS max_lots, count(*) FILTER (lots > 3) AS queued FROM t GROUP BY kind")
def weighted_avgs(spark: SparkSession, sf: str) -> DataFrame:
    return tape(spark, sf).groupBy("kind").agg(F.round(fills.weighted(F.col("tick"), F.col("lots")), 6).alias("average_tick"), F.round(F.avg((F.col("k") < 50).cast("double")), 9).alias("low_rate"), F.max("lots").alias("max_lots"), F.count_if(F.col("lots") > 3).alias("queued"))


@query(f"""WITH {BOOK_SQL}, m AS (SELECT symbol, (max(tick) FILTER (side = 'bid') + min(tick) FILTER (side = 'ask')) / 2.0::DOUBLE AS mid FROM b GROUP BY symbol), i AS (SELECT symbol, sum(lots)::BIGINT AS lots FROM f GROUP BY symbol)
SELECT count(*) AS symbols, sum(abs(lots))::BIGINT AS lots, bool_or(mid IS NULL AND lots <> 0) AS unpriced, CASE WHEN bool_or(mid IS NULL AND lots <> 0) THEN NULL ELSE sum(abs(lots) * mid) END::DOUBLE AS gross_notional, sum(abs(lots) * coalesce(mid, 0))::DOUBLE AS priced_notional FROM i LEFT JOIN m USING (symbol)""")
def portfolio_notional(spark: SparkSession, sf: str) -> DataFrame:
    inventory = fill_rows(spark, sf).groupBy("symbol").agg(F.sum("lots").alias("lots"))
    priced = inventory.join(book.best(book.book(levels(spark, sf))).select("symbol", "mid"), "symbol", "left")
    missing, value = F.bool_or(F.col("mid").isNull() & (F.col("lots") != 0)), F.abs("lots") * F.col("mid")
    return priced.agg(F.count("*").alias("symbols"), F.sum(F.abs("lots")).alias("lots"), missing.alias("unpriced"), F.when(~missing, F.sum(value)).alias("gross_notional"), F.sum(F.coalesce(value, F.lit(0.0))).alias("priced_notional"))


@query("SELECT CASE WHEN kind IS NULL THEN 'total' ELSE kind END AS source, sum(lots)::BIGINT AS observed, sum(least(lots, 3))::BIGINT AS modeled, sum(lots - least(lots, 3))::BIGINT AS netted FROM t GROUP BY ROLLUP (kind)")
def consumption_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return tape(spark, sf).rollup("kind").agg(F.sum("lots").alias("observed"), F.sum(F.least("lots", F.lit(3))).alias("modeled"), F.sum(F.col("lots") - F.least("lots", F.lit(3))).alias("netted")).withColumn("kind", F.coalesce("kind", F.lit("total"))).withColumnRenamed("kind", "source")


# -- audit


@query("SELECT f.seq FROM f WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.seq AND o.o_orderstatus = 'F')")
def evidence_anti(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seq"))
    return audit.unresolved(fill_rows(spark, sf).select("seq"), known, "seq")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def filled_semi(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(returned, "o_orderkey", "left_semi")


@query("""WITH live AS (SELECT symbol, side, abs(lots) AS slot, max(tick) AS tick FROM f GROUP BY ALL), want AS (SELECT symbol, side, lots AS slot, min(tick) AS tick FROM t WHERE kind = 'view' GROUP BY ALL)
SELECT coalesce(live.symbol, want.symbol) AS symbol, coalesce(live.side, want.side) AS side, coalesce(live.slot, want.slot) AS slot, CASE WHEN want.tick IS NULL THEN 'cancel' WHEN live.tick IS NULL THEN 'new' WHEN live.tick <> want.tick THEN 'replace' ELSE 'keep' END AS action
FROM live FULL JOIN want ON live.symbol = want.symbol AND live.side = want.side AND live.slot = want.slot""")
def quote_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    live = fill_rows(spark, sf).groupBy("symbol", "side", F.abs("lots").alias("slot")).agg(F.max("tick").alias("tick"))
    want = tape(spark, sf).where("kind = 'view'").groupBy("symbol", "side", F.col("lots").alias("slot")).agg(F.min("tick").alias("tick"))
    return audit.reconcile(live, want, ["symbol", "side", "slot"], "tick")


@query("""WITH a AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS n FROM t WHERE kind = 'purchase'), b AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS n FROM t WHERE kind = 'click')
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.n, b.n) AS n, a.seq AS left_seq, b.seq AS right_seq FROM a FULL JOIN b ON a.symbol = b.symbol AND a.n = b.n""")
def trace_merge(spark: SparkSession, sf: str) -> DataFrame:
    return audit.merge(*[tape(spark, sf).where(F.col("kind") == kind) for kind in ("purchase", "click")])


@query("""WITH g AS (SELECT *, CASE WHEN tick <= 0 THEN 'tick' END AS r1, CASE WHEN kind = 'purchase' AND k < 10 THEN 'low_k' END AS r2, CASE WHEN lots > 6 THEN 'lots' END AS r3 FROM t)
SELECT reason, count(*) AS n FROM (SELECT unnest([r1, r2, r3]) AS reason FROM g) WHERE reason IS NOT NULL GROUP BY reason""")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"tick": F.col("tick") > 0, "low_k": (F.col("kind") != "purchase") | (F.col("k") >= 10), "lots": F.col("lots") <= 6}
    return audit.violations(tape(spark, sf), rules).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT symbol, list(seq || ':' || tick ORDER BY ns, seq) AS rows FROM f GROUP BY symbol)
SELECT symbol, len(rows) AS n, list_reduce(list_prepend(sha256('fills'), rows), lambda h, r: sha256(h || chr(10) || r)) AS digest FROM c""")
def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    return audit.hash_chain(fill_rows(spark, sf), ["symbol"], ["ns", "seq"], F.concat_ws(":", "seq", "tick"), "fills")


@query("""SELECT symbol, count(*) AS n, sha256('[' || string_agg('{"seq":' || seq || ',"tick":' || tick || '}', ',' ORDER BY ns, seq) || ']') AS digest FROM f GROUP BY symbol""")
def canonical_list_hash(spark: SparkSession, sf: str) -> DataFrame:
    return audit.list_hash(fill_rows(spark, sf), ["symbol"], ["ns", "seq"], F.to_json(F.struct("seq", "tick")))


@query("""WITH a AS (SELECT DISTINCT symbol, k FROM t WHERE kind = 'view'), b AS (SELECT DISTINCT symbol, k FROM t WHERE kind = 'click')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'only_left', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_right', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (tape(spark, sf).where(F.col("kind") == kind).select("symbol", "k").distinct() for kind in ("view", "click"))
    found = {"union": a.union(b).distinct(), "only_left": a.exceptAll(b), "only_right": b.exceptAll(a)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


# -- research and options


@query("SELECT kind, round(quantile_cont(tick, 0.5), 6) AS p50, round(quantile_cont(tick, 0.99), 6) AS p99, round(median(lots), 6) AS median_lots FROM t GROUP BY kind")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)
    return tape(spark, sf).groupBy("kind").agg(p("tick", 0.5).alias("p50"), p("tick", 0.99).alias("p99"), F.round(F.median("lots"), 6).alias("median_lots"))


@query("""WITH g AS (SELECT * FROM (VALUES ('a', 1.0), ('b', 0.5)) AS p(profile, weight), (VALUES (1), (2), (5)) AS s(spread)), r AS (SELECT profile, spread, round(sum(tick % (spread + 3)) * weight::DOUBLE, 6) AS score FROM g, f GROUP BY profile, spread, weight)
SELECT profile, spread, score, row_number() OVER (ORDER BY score DESC, profile, spread) AS rank FROM r""")
def rank_sweep(spark: SparkSession, sf: str) -> DataFrame:
    grid = research.grid(spark, {"profile": ["a", "b"], "spread": [1, 2, 5]}).withColumn("weight", F.when(F.col("profile") == "a", 1.0).otherwise(0.5))
    scored = fill_rows(spark, sf).withColumn("spread", F.explode(F.array(*[F.lit(s) for s in (1, 2, 5)]))).groupBy("spread").agg(F.sum(F.col("tick") % (F.col("spread") + 3)).alias("s"))
    out = grid.join(F.broadcast(scored), "spread").select("profile", "spread", F.round(F.col("s") * F.col("weight"), 6).alias("score"))
    return research.rank(out, [F.desc("score"), F.asc("profile"), F.asc("spread")])


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), n AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM d)
SELECT day::VARCHAR AS day, CASE WHEN i <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN i <= greatest(1, floor(n * 0.6)) + greatest(1, floor(n * 0.2)) THEN 'validation' ELSE 'test' END AS split FROM n""")
def day_split(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return research.day_split(days).withColumn("day", F.col("day").cast("string"))


@query()
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return research.bootstrap(daily, "day", "value", block=3, replicates=2000, seed=7)


def _cdf_sql(z: str) -> str:
    """The normal distribution function: terms of the series from their logarithms."""
    return f"0.5::DOUBLE + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda i: sign({z}) * exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300::DOUBLE)) - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1))))"


GREEKS_SQL = f"""s AS (SELECT symbol, avg(tick) AS spot FROM t GROUP BY symbol), c AS (SELECT symbol, spot, days, moneyness, option_type, spot * moneyness AS strike, days / 365.0::DOUBLE AS years, 0.02::DOUBLE AS rate
  FROM s, (SELECT unnest([7, 30, 90]) AS days), (SELECT unnest([0.9, 0.95, 1.0, 1.05, 1.1]::DOUBLE[]) AS moneyness), (SELECT unnest(['call', 'put']) AS option_type)),
v AS (SELECT *, greatest(0.05::DOUBLE, 0.5::DOUBLE - 0.2::DOUBLE * ln(strike / spot) + 0.4::DOUBLE * ln(strike / spot) * ln(strike / spot) + 0.05::DOUBLE * sqrt(years)) AS vol FROM c),
d AS (SELECT *, (ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * sqrt(years)) AS d1 FROM v), d2 AS (SELECT *, d1 - vol * sqrt(years) AS d2 FROM d),
n AS (SELECT *, {_cdf_sql("d1")} AS n1, {_cdf_sql("d2")} AS n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf, exp(-rate * years) AS disc, option_type = 'call' AS call FROM d2),
g AS (SELECT symbol, spot, days, moneyness, option_type, strike, years, rate, vol, CASE WHEN call THEN spot * n1 - strike * disc * n2 ELSE strike * disc * (1 - n2) - spot * (1 - n1) END AS fair, CASE WHEN call THEN n1 ELSE n1 - 1 END AS delta, pdf / (spot * vol * sqrt(years)) AS gamma,
  spot * pdf * sqrt(years) AS vega, -spot * pdf * vol / (2 * sqrt(years)) + CASE WHEN call THEN -rate * strike * disc * n2 ELSE rate * strike * disc * (1 - n2) END AS theta FROM n)"""
GREEKS = ("fair", "delta", "gamma", "vega", "theta")


def _greeks(spark: SparkSession, sf: str) -> DataFrame:
    chain = research.grid(spark, {"days": [7, 30, 90], "moneyness": [0.9, 0.95, 1.0, 1.05, 1.1], "option_type": ["call", "put"]})
    spots = tape(spark, sf).groupBy("symbol").agg(F.avg("tick").alias("spot"))
    priced = spots.join(F.broadcast(chain)).withColumns({"strike": F.col("spot") * F.col("moneyness"), "years": F.col("days") / 365.0, "rate": F.lit(0.02)})
    priced = priced.withColumn("vol", opt.implied_vol(F.col("spot"), F.col("strike"), F.col("years"), atm=0.5, skew=-0.2, convexity=0.4, term=0.05, floor=0.05))
    return opt.with_greeks(priced)


@query(f"""WITH {GREEKS_SQL} SELECT symbol, days, moneyness, option_type, round(spot, 4) AS spot, round(strike, 4) AS strike, round(vol, 9) AS vol, {", ".join(f"round({c}, {9 if c in ('delta', 'gamma') else 4}) AS {c}" for c in GREEKS)} FROM g""")
def options_greeks(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"spot": 4, "strike": 4, "vol": 9} | {c: 9 if c in ("delta", "gamma") else 4 for c in GREEKS}
    return _greeks(spark, sf).select("symbol", "days", "moneyness", "option_type", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(f"""WITH {GREEKS_SQL}, z AS (SELECT *, CASE option_type WHEN 'call' THEN days % 4 ELSE -(days % 3) END AS size FROM g), p AS (SELECT symbol, sum(size * delta) AS pd, sum(size * gamma) AS pg, sum(size * vega) AS pv FROM z GROUP BY symbol),
q AS (SELECT z.*, pd * delta * 0.02::DOUBLE + pv * vega * 0.00001::DOUBLE AS reservation, greatest(0.05::DOUBLE, 0.5::DOUBLE + vol * 2 + abs(pg) * 10) AS half FROM z JOIN p USING (symbol)), b AS (SELECT *, greatest(0.01::DOUBLE, fair - half - reservation) AS bid FROM q)
SELECT symbol, days, moneyness, option_type, round(fair, 4) AS fair, round(bid, 4) AS bid, round(greatest(bid + 0.01::DOUBLE, fair + half - reservation), 4) AS ask FROM b""")
def option_quotes(spark: SparkSession, sf: str) -> DataFrame:
    greeks = _greeks(spark, sf).withColumn("size", F.when(F.col("option_type") == "call", F.col("days") % 4).otherwise(-(F.col("days") % 3)))
    risk = opt.portfolio(greeks, ["symbol"]).select("symbol", *[F.col(g).alias(f"book_{g}") for g in ("delta", "gamma", "vega")])
    bid, ask = opt.quotes(*[F.col(c) for c in ("fair", "delta", "vega", "book_delta", "book_vega", "book_gamma", "vol")], delta_weight=0.02, vega_weight=1e-5, base=0.5, vol_weight=2.0, gamma_weight=10.0, least=0.05)
    return greeks.join(risk, "symbol").select("symbol", "days", "moneyness", "option_type", *[F.round(c, 4).alias(n) for n, c in (("fair", F.col("fair")), ("bid", bid), ("ask", ask))])


@query("""WITH c AS (SELECT symbol, k % 3 AS tenor, k % 5 AS strike, sum(lots)::BIGINT AS lots FROM f GROUP BY ALL)
SELECT tenor, sum(lots) FILTER (strike = 0)::BIGINT AS s0, sum(lots) FILTER (strike = 1)::BIGINT AS s1, sum(lots) FILTER (strike = 2)::BIGINT AS s2, sum(lots) FILTER (strike = 3)::BIGINT AS s3, sum(lots) FILTER (strike = 4)::BIGINT AS s4 FROM c GROUP BY tenor""")
def options_surface(spark: SparkSession, sf: str) -> DataFrame:
    c = fill_rows(spark, sf).withColumns({"tenor": F.col("k") % 3, "strike": F.concat(F.lit("s"), F.col("k") % 5)})
    return c.groupBy("tenor").pivot("strike", [f"s{i}" for i in range(5)]).agg(F.sum("lots"))


@query("""WITH g AS (SELECT k % 3 AS tenor, k % 5 AS strike, sum(lots)::BIGINT AS lots FROM f GROUP BY ALL), n AS (SELECT k % 5 AS strike, count(*) AS n, min(seq) AS first FROM f GROUP BY ALL)
SELECT 'bucket' AS what, arg_max(tenor * 10 + strike, (abs(lots), -(tenor * 10 + strike))) AS item, max(abs(lots)) AS size FROM g UNION ALL SELECT * FROM (SELECT 'traded', strike, n FROM n ORDER BY n DESC, first LIMIT 3)""")
def largest_buckets(spark: SparkSession, sf: str) -> DataFrame:
    f = fill_rows(spark, sf)
    item = F.col("k") % 3 * 10 + F.col("k") % 5
    top = f.groupBy(item.alias("item")).agg(F.sum("lots").alias("lots")).agg(F.max_by("item", F.struct(F.abs("lots"), -F.col("item"))).alias("item"), F.max(F.abs("lots")).alias("size"))
    traded = f.groupBy((F.col("k") % 5).alias("item")).agg(F.count("*").alias("size"), F.min("seq").alias("first")).orderBy(F.desc("size"), "first").limit(3)
    return top.select(F.lit("bucket").alias("what"), "item", "size").union(traded.select(F.lit("traded").alias("what"), "item", "size"))


# -- event-time windows


@query("SELECT kind, (ns // 3600000000000) * 3600 AS window_start_s, count(*) AS n, sum(lots)::BIGINT AS lots FROM t GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = windows.timed(table(spark, sf, "events"))
    w = windows.tumbling(e.withColumn("lots", F.from_json("props", "k bigint")["k"] % 7 + 1), "1 hour", ["event_type"], {"n": F.count("*"), "lots": F.sum("lots")})
    return w.select(F.col("event_type").alias("kind"), F.unix_seconds("window_start").alias("window_start_s"), "n", "lots")


@query("""WITH g AS (SELECT symbol, ns, CASE WHEN ns - lag(ns) OVER (PARTITION BY symbol ORDER BY ns) < 21600000000000 THEN 0 ELSE 1 END AS fresh FROM t), s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ns) AS session FROM g)
SELECT symbol, min(ns) // 1000 AS start_us, max(ns) // 1000 + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY symbol, session""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.sessions(windows.timed(table(spark, sf, "events")), "6 hours", ["user_id"], {"n": F.count("*")})
    return s.select(F.col("user_id").alias("symbol"), F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("""WITH d AS (SELECT symbol, unnest(range(min(ns) // 86400000000000 + 1, max(ns) // 86400000000000 + 1)) * 86400000000000 AS due FROM t GROUP BY symbol), v AS (SELECT * FROM t WHERE kind = 'view')
SELECT d.symbol, d.due, v.tick AS tick_asof, v.ns AS at_asof FROM d ASOF LEFT JOIN v ON d.symbol = v.symbol AND v.ns <= d.due""")
def decision_clock(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf)
    day = 24 * HOUR
    span = t.groupBy("symbol").agg((F.floor(F.min("ns") / day) + 1).alias("low"), F.floor(F.max("ns") / day).alias("high")).where("low <= high")
    due = span.select("symbol", F.explode(F.sequence("low", "high")).alias("day")).select("symbol", (F.col("day") * day).alias("due"))
    return asof(due, t.where("kind = 'view'"), ["symbol"], F.col("due"), F.col("ns"), ["tick"])


# -- traces, schedules and ledgers


@query("SELECT seq, row_number() OVER (ORDER BY ns, seq) - 1 AS position FROM t")
def resequence(spark: SparkSession, sf: str) -> DataFrame:
    out = running(tape(spark, sf), [], chunk_of("ns"), ["ns", "seq"], {"position": ("sum", F.lit(1).cast("long"))}, before=True)
    return out.select("seq", "position")


@query("""SELECT count(*) AS records, count(*) FILTER (kind = 'signup') AS arrivals, count(*) FILTER (kind = 'purchase') AS fills, count(*) FILTER (kind = 'error') AS rejects, count(*) FILTER (kind = 'purchase' AND k % 3 = 0) AS first_fills,
  max(lots) FILTER (kind = 'purchase') AS max_ahead, sum(lots) FILTER (kind = 'purchase')::BIGINT AS sum_ahead FROM t""")
def trace_recount(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda kind: F.col("kind") == kind
    ahead = F.when(is_("purchase"), F.col("lots"))
    return tape(spark, sf).agg(F.count("*").alias("records"), F.count_if(is_("signup")).alias("arrivals"), F.count_if(is_("purchase")).alias("fills"), F.count_if(is_("error")).alias("rejects"), F.count_if(is_("purchase") & (F.col("k") % 3 == 0)).alias("first_fills"), F.max(ahead).alias("max_ahead"), F.sum(ahead).alias("sum_ahead"))


@query("SELECT count(*) AS rows, count(seq) AS seq, count(CASE WHEN k < 90 THEN k END) AS k, count(CASE WHEN k < 90 THEN k END) = count(*) AS complete FROM f")
def provenance_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(fill_rows(spark, sf).select("seq", F.when(F.col("k") < 90, F.col("k")).alias("k")), ["seq", "k"])


@query("""WITH v AS (SELECT symbol, bool_or(kind = 'signup') AS book, bool_and(tick > 0) AS clock, NOT bool_or(kind = 'error' AND k >= 90) AS capture, bool_or(kind = 'purchase') AS trade, symbol % 2 = 0 AS trade_required, count(DISTINCT kind) AS streams, count(*) FILTER (kind = 'error' AND k < 20) AS invalidations FROM t GROUP BY symbol)
SELECT symbol, book AND clock AND capture AND (trade OR NOT trade_required) AS execution_valid, book AND clock AND capture AND (trade OR NOT trade_required) AND streams > 0 AND invalidations = 0 AS claim_ready FROM v""")
def claim_gate(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda kind: F.col("kind") == kind
    v = tape(spark, sf).groupBy("symbol").agg(F.bool_or(is_("signup")).alias("book"), F.bool_and(F.col("tick") > 0).alias("clock"), (~F.bool_or(is_("error") & (F.col("k") >= 90))).alias("capture"), F.bool_or(is_("purchase")).alias("trade"), F.countDistinct("kind").alias("streams"), F.count_if(is_("error") & (F.col("k") < 20)).alias("invalidations"))
    return audit.claims(v.withColumn("trade_required", F.col("symbol") % 2 == 0)).select("symbol", "execution_valid", "claim_ready")


@query("SELECT kind AS name, count(*) AS runs, count(DISTINCT CASE kind WHEN 'view' THEN k ELSE 0 END) = 1 AS deterministic FROM t GROUP BY kind")
def determinism(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.when(F.col("kind") == "view", F.col("k")).otherwise(0)
    return audit.deterministic(tape(spark, sf).select(F.col("kind").alias("name"), digest.alias("digest")))


@query("""WITH d AS (SELECT *, tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ns, seq) AS drift FROM f)
SELECT CASE WHEN drift >= 0 THEN 'up' ELSE 'down' END AS direction, count(*) AS fills, round(count(*) FILTER (k < 50) / count(*)::DOUBLE, 9) AS adverse_rate FROM d WHERE drift IS NOT NULL GROUP BY 1""")
def adverse_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = previous(fill_rows(spark, sf), ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], {"p": F.col("tick")}).where("p IS NOT NULL")
    return d.groupBy(F.when(F.col("tick") >= F.col("p"), "up").otherwise("down").alias("direction")).agg(F.count("*").alias("fills"), F.round(F.avg((F.col("k") < 50).cast("double")), 9).alias("adverse_rate"))


@query("SELECT seq, list_has_any(['e' || (k % 5), 'e' || (seq % 5)], ['e0', 'e3']) AS linked, len(list_distinct(['e' || (k % 5), 'e' || (seq % 5), 'e' || (k % 5)])) AS n, 'e' || (k % 5) || CASE WHEN k % 5 <> seq % 5 THEN ',e' || (seq % 5) ELSE '' END AS evidence FROM f")
def combined_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda c: F.concat(F.lit("e"), (F.col(c) % 5).cast("string"))
    ids = F.array_distinct(F.concat(F.array(e("k"), e("seq")), F.array(e("k"))))
    return fill_rows(spark, sf).select("seq", F.arrays_overlap(ids, F.array(F.lit("e0"), F.lit("e3"))).alias("linked"), F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("evidence"))


@query("""WITH a AS (SELECT symbol, ns + 3600000000000 AS due_ns, seq, seq // 3 AS action_id FROM t WHERE kind = 'view'), c AS (SELECT symbol, seq // 3 AS action_id, min(ns) AS cancel_ns FROM t WHERE kind = 'error' GROUP BY ALL)
SELECT a.symbol, a.seq, a.action_id, row_number() OVER (PARTITION BY a.symbol ORDER BY due_ns, a.seq) AS position FROM a LEFT JOIN c ON a.symbol = c.symbol AND a.action_id = c.action_id WHERE cancel_ns IS NULL OR cancel_ns > due_ns""")
def scheduled_actions(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf).withColumn("action_id", F.floor(F.col("seq") / 3))
    actions = t.where("kind = 'view'").select("symbol", (F.col("ns") + HOUR).alias("due_ns"), "seq", "action_id")
    return ledger.scheduled(actions, t.where("kind = 'error'").select("symbol", "action_id", "ns")).select("symbol", "seq", "action_id", "position")


@query("""SELECT * FROM (WITH RECURSIVE e AS (SELECT symbol, ns, seq, CASE kind WHEN 'click' THEN 'release' WHEN 'purchase' THEN 'fill' ELSE 'reserve' END AS action, k % 4 AS order_id,
  CASE kind WHEN 'purchase' THEN CASE side WHEN 'ask' THEN -(lots % 3 + 1) ELSE lots % 3 + 1 END ELSE lots END AS lots, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS n FROM t WHERE kind <> 'error'),
r AS (SELECT symbol, NULL::BIGINT AS ns, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::BIGINT AS order_id, NULL::BIGINT AS lots, n - 1 AS n, false AS accepted, [0, 0, 0, 0]::BIGINT[] AS held, 0::BIGINT AS inventory FROM e WHERE n = 1
UNION ALL
SELECT symbol, ns, seq, action, order_id, lots, n, ok, list_transform(held, lambda h, i: CASE WHEN NOT ok OR i <> order_id + 1 THEN h WHEN action = 'reserve' THEN lots WHEN action = 'release' THEN 0 ELSE h - abs(lots) END), inventory + CASE WHEN ok AND action = 'fill' THEN lots ELSE 0 END
FROM (SELECT e.*, r.held, r.inventory, CASE e.action WHEN 'reserve' THEN r.held[e.order_id + 1] = 0 AND list_sum(r.held) + abs(r.inventory) + e.lots <= 12 WHEN 'release' THEN r.held[e.order_id + 1] > 0 ELSE abs(e.lots) <= r.held[e.order_id + 1] END AS ok
  FROM r JOIN (SELECT symbol, ns, seq, action, order_id, lots, n FROM e) e ON e.symbol = r.symbol AND e.n = r.n + 1))
SELECT symbol, ns, seq, action, order_id, lots, accepted, list_sum(held)::BIGINT AS reserved, inventory FROM r WHERE seq IS NOT NULL)""")
def reservation_ledger(spark: SparkSession, sf: str) -> DataFrame:
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "reserve", "view", "reserve", "click", "release", "purchase", "fill")]), F.col("kind"))
    events = tape(spark, sf).where("kind <> 'error'").select("symbol", "ns", "seq", action.alias("action"), (F.col("k") % 4).alias("order_id"), F.when(F.col("kind") == "purchase", ticks.signed_lots(F.col("lots") % 3 + 1, F.col("side") == "ask")).otherwise(F.col("lots")).alias("lots"))
    return ledger.reservations(events, 12)


@query()
def checksums(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), hashing.crc32c(F.col("props")).alias("crc32c"), F.sha2(F.col("props").cast("binary"), 256).alias("sha256"))


def _mixed(z: str, shift: int, factor: str) -> str:
    return f"((xor({z}, {z} // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {1 << 64}::UHUGEINT)"


_STATE = f"((11 + (seq + 1)::UHUGEINT * {research.GAMMA}::UHUGEINT) % {1 << 64}::UHUGEINT)"


@query(f"""WITH z0 AS (SELECT seq, {_STATE} AS z FROM f), z1 AS (SELECT {_mixed("z", 30, str(research.MIX_1))} AS z FROM z0), z2 AS (SELECT {_mixed("z", 27, str(research.MIX_2))} AS z FROM z1), z3 AS (SELECT xor(z, z // {1 << 31}::UHUGEINT) AS z FROM z2)
SELECT CASE WHEN z // {1 << 32}::UHUGEINT % 1000000 < 20000 THEN 50000 ELSE 100 * (1 << (z % 4)::INTEGER) END::BIGINT AS latency_us, count(*) AS n FROM z3 GROUP BY 1""")
def latency(spark: SparkSession, sf: str) -> DataFrame:
    drawn = hashing.latency_draws(fill_rows(spark, sf).select("symbol", "seq"), "seq", seed=11, samples_us=[100, 200, 400, 800], tail_us=50_000, tail_per_million=20_000)
    return drawn.groupBy("latency_us").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'depth' ELSE 'trade' END AS source, l_suppkey AS symbol, l_quantity::BIGINT AS lots FROM lineitem)
SELECT source, symbol, sum(lots)::BIGINT AS observed, count(*) AS n FROM s GROUP BY CUBE (source, symbol)""")
def level_cube(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "depth").otherwise("trade").alias("source"), F.col("l_suppkey").alias("symbol"), F.col("l_quantity").cast("long").alias("lots"))
    return s.cube("source", "symbol").agg(F.sum("lots").alias("observed"), F.count("*").alias("n"))


@query()
def book_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Which depth updates apply after which snapshot: the stream's operator over a table."""
    t = tape(spark, sf).where("kind IN ('signup', 'view', 'click')")
    before = previous(t, ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], {"p": F.col("seq")})
    kind = F.when(F.col("kind") == "signup", "snapshot").otherwise("depth")
    first = F.when(F.col("k") % 25 == 3, F.col("seq") + 1).otherwise(F.greatest(F.lit(0), F.col("seq") - 200))
    updates = before.select("symbol", "seq", kind.alias("kind"), first.alias("first_id"), F.col("seq").alias("last_id"), F.when(F.col("k") % 10 == 1, F.lit(0)).otherwise(F.coalesce("p", F.lit(0))).alias("previous_id"))
    return stream_book.synchronize_table(updates)


# -- audit of fills and markouts


RULED = "k % 11 = 0 AS r_side, k % 13 = 0 AS r_price, k % 17 = 0 AS r_evidence, k % 19 = 0 AS r_validity, k % 23 = 0 AS r_path, k % 29 = 0 AS r_draw"


@query(f"""WITH x AS (SELECT {RULED} FROM f) SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN r_side THEN 'side' END, CASE WHEN r_price THEN 'price' END, CASE WHEN r_evidence THEN 'evidence_ids' END,
  CASE WHEN r_validity THEN 'validity' END, CASE WHEN r_path THEN 'queue_path' END, CASE WHEN r_draw THEN 'latency_draws' END]) AS reason FROM x) WHERE reason IS NOT NULL GROUP BY reason""")
def fill_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Fills with planted faults against the rules of fills."""
    bad, ok = lambda n: F.col("k") % n == 0, F.lit(True)
    text, lots = lambda v: F.lit(v).cast("string"), F.abs("lots")
    path = [(audit.PASSIVE_PATH[0], lots + 5), (audit.PASSIVE_PATH[1], lots + F.when(bad(23), 1).otherwise(0)), (audit.PASSIVE_PATH[2], F.lit(5).cast("long"))]
    validity = {"book_valid": ok, "clock_valid": ok, "capture_valid": ok, "trade_stream_valid": ok, "trade_stream_required": ok, "execution_valid": ~bad(19), "reason": F.lit(None).cast("string")}
    rows = fill_rows(spark, sf).select(
        F.lit("agg_trade").alias("fill_source"), F.when(bad(11), "middle").otherwise(F.col("side")).alias("side"), F.col("seq").cast("string").alias("order_id"), F.when(bad(13), "0").otherwise("1.5").alias("price"),
        *[text("1").alias(c) for c in ("qty", "notional", "contract_multiplier", "fee")], text("-0.5").alias("fee_bps"), F.lit(1).alias("provenance_schema_version"), text("s").alias("scenario_id"), text("s").alias("expected_scenario_id"),
        F.when(bad(17), F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("evidence_ids"), F.struct(*[c.alias(k) for k, c in validity.items()]).alias("validity"),
        F.create_map(*[x for k, c in path for x in (F.lit(k), c)]).alias("queue_trajectory"), F.create_map(F.lit("new_order"), F.when(bad(29), -1.0).otherwise(2.0), F.lit("cancel"), F.lit(None).cast("double")).alias("latency_draws_ms"),
        F.struct(text("fixed").alias("mode"), F.lit(7).alias("seed"), text("configured_scenario").alias("source"), F.lit(False).alias("measured")).alias("latency_model"), text("live").alias("order_state_at_fill"), text("static_config_bps").alias("fee_model_id"),
    )
    return audit.violations(rows, audit.fill_rules()).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT k, k % 4 = 0 AS gone, k % 7 = 0 AS odd FROM f) SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN gone AND odd THEN 'null_outcome' END, CASE WHEN gone AND k % 5 = 0 THEN 'invalid_reason' END,
  CASE WHEN NOT gone AND k % 3 = 0 THEN 'adverse' END, CASE WHEN NOT gone AND odd THEN 'outcome' END]) AS reason FROM x) WHERE reason IS NOT NULL GROUP BY reason""")
def markout_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Markouts with planted faults against the rules of markouts."""
    k, gone, odd = F.col("k"), F.col("k") % 4 == 0, F.col("k") % 7 == 0
    rows = fill_rows(spark, sf).select(
        F.lit("depth_update").alias("fill_source"), "side", F.lit("1").alias("fill_price"), F.when(odd & ~gone, "0").otherwise("2").alias("qty"), F.when(gone, "invalidated").otherwise("resolved").alias("status"),
        F.when(~gone | odd, "1").alias("mid_after"), F.when(~gone, "-0.5").alias("markout"), F.when(~gone, k % 3 != 0).alias("adverse"), F.lit(None).cast("double").alias("resolution_lag_seconds"), F.when(gone & (k % 5 != 0), "gap").alias("invalid_reason"),
    )
    return audit.violations(rows, audit.markout_rules()).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT symbol, count(*) AS n, sum(lots)::BIGINT AS lots FROM f GROUP BY symbol) SELECT symbol, 'lots' AS field, (lots + 1)::DOUBLE AS told, lots::DOUBLE AS found FROM d WHERE symbol % 5 = 0
UNION ALL SELECT symbol, 'n', NULL, n::DOUBLE FROM d WHERE symbol % 7 = 0 UNION ALL SELECT symbol, 'lots', NULL, lots::DOUBLE FROM d WHERE symbol % 7 = 0 AND symbol % 5 <> 0""")
def summary_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A summary with planted faults against what its details give."""
    found = fill_rows(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("lots").alias("lots"))
    gone = (F.col("symbol") % 7 == 0) & (F.col("symbol") % 5 != 0)
    told = found.where(~gone).withColumn("lots", F.when(F.col("symbol") % 5 == 0, F.col("lots") + 1).otherwise(F.col("lots"))).withColumn("n", F.when(F.col("symbol") % 7 != 0, F.col("n")))
    return audit.summary_differences(told, found, ["symbol"])


# -- books of orders, sets and pivots


@query("""WITH o AS (SELECT symbol, CASE WHEN k % 2 = 1 THEN 'ask' ELSE 'bid' END AS side, tick // 100 AS tick, lots FROM t WHERE kind = 'view'),
b AS (SELECT symbol, max(tick) FILTER (side = 'bid') AS bid, min(tick) FILTER (side = 'ask') AS ask, count(*) FILTER (tick <= 0) AS bad_ticks, count(*) FILTER (lots <= 0) AS bad_lots FROM o GROUP BY symbol)
SELECT symbol, bid, ask, bad_ticks, bad_lots, coalesce(bid >= ask, false) AS crossed, bad_ticks = 0 AND bad_lots = 0 AND NOT coalesce(bid >= ask, false) AS valid FROM b""")
def book_invariants(spark: SparkSession, sf: str) -> DataFrame:
    o = tape(spark, sf).where("kind = 'view'").withColumn("tick", F.floor(F.col("tick") / 100))
    return book.invariants(o)


@query("""SELECT symbol, side, tick // 500 AS tick, sum(lots)::BIGINT AS lots, count(*) AS orders, arg_min(seq, (ns, seq)) AS first_order FROM t WHERE kind = 'view' GROUP BY ALL""")
def order_depth(spark: SparkSession, sf: str) -> DataFrame:
    return book.order_depth(tape(spark, sf).where("kind = 'view'").withColumn("tick", F.floor(F.col("tick") / 500)))


@query("""WITH b AS (SELECT symbol, side, tick // 500 AS tick, sum(lots)::BIGINT AS lots FROM t WHERE kind = 'view' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -tick ELSE tick END) AS n FROM b)
SELECT symbol, side, count(*) AS total, count(*) FILTER (n <= 2) AS shown, string_agg(tick || 'x' || lots, ',' ORDER BY n) FILTER (n <= 2) AS best FROM r GROUP BY symbol, side""")
def capped_depth(spark: SparkSession, sf: str) -> DataFrame:
    """The two best levels of each side as text, with how many there are in all."""
    depth = book.order_depth(tape(spark, sf).where("kind = 'view'").withColumn("tick", F.floor(F.col("tick") / 500))).select("symbol", "side", "tick", "lots")
    shown = book.top_levels(depth, 2).groupBy("symbol", "side").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("x", "tick", "lots").alias("cell")))).alias("c"))
    total = depth.groupBy("symbol", "side").agg(F.count("*").alias("total"))
    return total.join(shown, ["symbol", "side"]).select("symbol", "side", "total", F.size("c").cast("long").alias("shown"), F.array_join(F.transform("c", lambda x: x["cell"]), ",").alias("best"))


@query("SELECT kind, string_agg(DISTINCT symbol::VARCHAR, ',' ORDER BY symbol::VARCHAR) AS symbols, count(DISTINCT symbol) AS n FROM t WHERE k < 3 GROUP BY kind")
def symbol_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted sets of the symbols that each kind of record has at a low k."""
    sets = F.sort_array(F.collect_set(F.col("symbol").cast("string")))
    return tape(spark, sf).where("k < 3").groupBy("kind").agg(F.array_join(sets, ",").alias("symbols"), F.size(sets).cast("long").alias("n"))


@query("""WITH r AS (SELECT CASE WHEN k % 2 = 0 THEN 'base' ELSE 'candidate' END AS profile, count(*) AS fills, avg(tick) AS average_tick, sum(lots) AS lots FROM f GROUP BY 1),
c AS (SELECT profile, unnest([{'metric': 'fills', 'value': fills::DOUBLE}, {'metric': 'average_tick', 'value': average_tick}, {'metric': 'lots', 'value': lots::DOUBLE}]) AS c FROM r)
SELECT c.metric AS metric, round(max(c.value) FILTER (profile = 'base'), 6) AS base, round(max(c.value) FILTER (profile = 'candidate'), 6) AS candidate, round(max(c.value) FILTER (profile = 'candidate') - max(c.value) FILTER (profile = 'base'), 6) AS difference FROM c GROUP BY 1""")
def profile_pivot(spark: SparkSession, sf: str) -> DataFrame:
    runs = fill_rows(spark, sf).groupBy(F.when(F.col("k") % 2 == 0, "base").otherwise("candidate").alias("profile")).agg(F.count("*").alias("fills"), F.avg("tick").alias("average_tick"), F.sum("lots").alias("lots"))
    out = research.profile_pivot(runs, ["fills", "average_tick", "lots"], "base", "candidate")
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("base", "candidate", "difference")])


@query("""WITH s AS (SELECT symbol, avg(tick) AS spot FROM t GROUP BY symbol), d AS (SELECT unnest([7, 30, 90]) AS days),
v AS (SELECT symbol, days, m, greatest(0.05::DOUBLE, 0.5::DOUBLE - 0.2::DOUBLE * ln(m) + 0.4::DOUBLE * ln(m) * ln(m) + 0.05::DOUBLE * sqrt(days / 365.0::DOUBLE)) AS vol FROM s, d, (SELECT unnest([0.9::DOUBLE, 1.0::DOUBLE, 1.1::DOUBLE]) AS m))
SELECT symbol, days, round(max(vol) FILTER (m = 0.9::DOUBLE), 6) AS low, round(max(vol) FILTER (m = 1.0::DOUBLE), 6) AS middle, round(max(vol) FILTER (m = 1.1::DOUBLE), 6) AS high FROM v GROUP BY symbol, days""")
def vol_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Volatilities of a small chain by tenor, a column per moneyness."""
    chain = research.grid(spark, {"days": [7, 30, 90], "m": [0.9, 1.0, 1.1]})
    spots = tape(spark, sf).groupBy("symbol").agg(F.avg("tick").alias("spot"))
    priced = spots.join(F.broadcast(chain)).withColumn("vol", opt.implied_vol(F.col("spot"), F.col("spot") * F.col("m"), F.col("days") / 365.0, atm=0.5, skew=-0.2, convexity=0.4, term=0.05, floor=0.05))
    wide = priced.groupBy("symbol", "days").pivot("m", [0.9, 1.0, 1.1]).agg(F.round(F.max("vol"), 6))
    return wide.toDF("symbol", "days", "low", "middle", "high")


@query()
def notional_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One limit over all symbols of a portfolio of ten."""
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "reserve", "view", "reserve", "click", "cancel", "purchase", "fill", "error", "ack")]), F.col("kind"))
    events = tape(spark, sf).select((F.col("symbol") % 10).alias("portfolio"), "ns", "seq", action.alias("action"), "symbol", (F.col("k") % 40).alias("order_id"), (F.col("side") == "bid").alias("is_bid"), F.col("lots").alias("units"))
    return ledger.notional_reservations(events, 60)
