"""Queries on the evidence of captures and runs: validity of routes, lifecycles of orders, paths of markouts, positions, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options
from ..operators import audit, book, research, validity
from .catalogue import HOUR, NETTING_SQL, query
from .studies import OPTION_SQL, _option_fills
from .tape import fills as fill_rows
from .tape import table, tape

# -- captures: stretches of 250 events with faults by number

ROWS_SQL = """r AS (SELECT seq // 250 AS path, seq AS source_row_seq, symbol % 4 AS symbol,
  CASE WHEN kind = 'purchase' OR kind IN ('error', 'signup') AND k % 2 = 0 THEN 'market' ELSE 'public' END AS route,
  CASE kind WHEN 'view' THEN 'depthUpdate' WHEN 'click' THEN 'snapshot' WHEN 'purchase' THEN 'aggTrade' ELSE 'captureEvent' END AS kind,
  CASE WHEN seq % 250 = 249 THEN 'capture_trailer' WHEN kind = 'error' AND k % 25 = 7 THEN 'overflow' WHEN kind = 'error' THEN 'disconnect' WHEN kind = 'signup' THEN 'reconnect' END AS event,
  CASE WHEN seq % 700 <> 5 THEN CASE WHEN seq % 900 = 133 THEN seq - 40 ELSE seq END END AS recv_seq, seq * 1000 - CASE WHEN seq % 1100 = 77 THEN 5000 ELSE 0 END AS mono,
  CASE WHEN k % 3 > 0 THEN seq // 90 END AS stream_epoch, CASE WHEN kind = 'view' AND k % 4 = 0 THEN seq // 60 END AS sync_epoch,
  CASE WHEN kind = 'click' THEN k % 6 > 0 END AS accepted FROM t),
c AS (SELECT *, max(recv_seq) OVER w AS b_seq, max(CASE WHEN recv_seq IS NOT NULL THEN mono END) OVER w AS b_mono FROM r
  WINDOW w AS (PARTITION BY path ORDER BY source_row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, recv_seq IS NULL AS lost, coalesce(recv_seq <= b_seq, false) AS repeats, coalesce(recv_seq > b_seq + 1, false) AS skips,
  coalesce(recv_seq IS NOT NULL AND mono < b_mono, false) AS late, coalesce(event = 'overflow', false) AS abort FROM c),
e AS (SELECT *, NOT bool_or(lost OR repeats OR skips OR abort) OVER w AS capture_valid, NOT bool_or(late) OVER w AS clock_valid,
  last_value(CASE route WHEN 'public' THEN stream_epoch END IGNORE NULLS) OVER p AS b_public, last_value(CASE route WHEN 'market' THEN stream_epoch END IGNORE NULLS) OVER p AS b_market,
  last_value(CASE route WHEN 'public' THEN sync_epoch END IGNORE NULLS) OVER p AS b_sync FROM d
  WINDOW w AS (PARTITION BY path ORDER BY source_row_seq), p AS (PARTITION BY path, symbol ORDER BY source_row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, coalesce(event IN ('disconnect', 'overflow'), false) AS stops, coalesce(event = 'reconnect', false) AS opens, kind = 'snapshot' AND NOT accepted AS rejected,
  coalesce(route = 'public' AND stream_epoch <> b_public, false) AS new_public, coalesce(route = 'market' AND stream_epoch <> b_market, false) AS new_market,
  coalesce(route = 'public' AND sync_epoch <> b_sync, false) AS new_sync FROM e),
h AS (SELECT *, CASE WHEN rejected THEN false WHEN route = 'public' AND stops THEN false WHEN route = 'public' AND opens THEN true
    WHEN kind IN ('depthUpdate', 'snapshot') THEN CASE WHEN b_public IS NULL THEN true END WHEN new_public OR new_sync THEN false END AS depth_turn,
  CASE WHEN route = 'market' AND stops THEN false WHEN route = 'market' AND opens THEN true WHEN kind = 'aggTrade' THEN CASE WHEN b_market IS NULL THEN true END WHEN new_market THEN false END AS trade_turn FROM g),
i AS (SELECT *, coalesce(last_value(depth_turn IGNORE NULLS) OVER p, false) AS was_depth, coalesce(last_value(trade_turn IGNORE NULLS) OVER p, false) AS was_trade FROM h
  WINDOW p AS (PARTITION BY path, symbol ORDER BY source_row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, coalesce(depth_turn, was_depth) AS depth_valid, coalesce(trade_turn, was_trade) AS trade_valid,
  capture_valid AND clock_valid AND coalesce(depth_turn, was_depth) AND coalesce(trade_turn, was_trade) AS execution_valid,
  list_filter([CASE WHEN lost THEN 'missing_capture_metadata' END, CASE WHEN repeats THEN 'non_increasing_receive_sequence' END, CASE WHEN skips THEN 'receive_sequence_gap' END,
    CASE WHEN late THEN 'receive_monotonic_regression' END, CASE WHEN abort THEN event END, CASE WHEN new_public THEN 'public_stream_epoch_changed' END, CASE WHEN new_sync THEN 'capture_sync_epoch_changed' END,
    CASE WHEN new_market THEN 'market_stream_epoch_changed' END, CASE WHEN stops THEN route || '_stream_' || event END, CASE WHEN rejected THEN 'snapshot_rejected' END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN route = 'public' AND opens AND (NOT was_depth OR new_public OR new_sync) THEN 'public_connected' END, CASE WHEN route = 'market' AND opens AND (NOT was_trade OR new_market) THEN 'market_connected' END,
    CASE WHEN kind IN ('depthUpdate', 'snapshot') AND NOT rejected AND depth_turn AND NOT was_depth THEN 'public_observed' END,
    CASE WHEN kind = 'aggTrade' AND trade_turn AND NOT was_trade THEN 'market_observed' END], lambda x: x IS NOT NULL) AS good FROM i)"""


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    k, seq, kind = F.col("k"), F.col("seq"), F.col("kind")
    route = F.when((kind == "purchase") | (kind.isin("error", "signup") & (k % 2 == 0)), "market").otherwise("public")
    type_ = F.when(kind == "view", "depthUpdate").when(kind == "click", "snapshot").when(kind == "purchase", "aggTrade").otherwise("captureEvent")
    event = F.when(seq % 250 == 249, "capture_trailer").when((kind == "error") & (k % 25 == 7), "overflow").when(kind == "error", "disconnect").when(kind == "signup", "reconnect")
    received = F.when(seq % 700 != 5, F.when(seq % 900 == 133, seq - 40).otherwise(seq))
    return tape(spark, sf).select(
        F.floor(seq / 250).alias("path"), seq.alias("source_row_seq"), (F.col("symbol") % 4).alias("symbol"), route.alias("route"), type_.alias("kind"), event.alias("event"),
        received.alias("recv_seq"), (seq * 1000 - F.when(seq % 1100 == 77, 5000).otherwise(0)).alias("recv_monotonic_ns"), F.when(k % 3 > 0, F.floor(seq / 90)).alias("stream_epoch"),
        F.when((kind == "view") & (k % 4 == 0), F.floor(seq / 60)).alias("sync_epoch"), F.when(kind == "click", k % 6 > 0).alias("snapshot_accepted"),
    )


@query(f"""WITH {ROWS_SQL} SELECT source_row_seq AS seq, capture_valid, clock_valid, depth_valid, trade_valid, execution_valid,
  array_to_string(list_sort(bad), ',') AS invalidated, array_to_string(list_sort(good), ',') AS recovered FROM v""")
def route_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Validity of capture, clock and routes after each row, with the boundaries it makes."""
    reasons = lambda kind: F.array_join(F.array_sort(F.transform(F.filter("boundaries", lambda b: b["kind"] == kind), lambda b: b["reason"])), ",")
    flags = [f"{x}_valid" for x in ("capture", "clock", "depth", "trade", "execution")]
    return validity.routes(_captures(spark, sf)).select(F.col("source_row_seq").alias("seq"), *flags, reasons("invalidated").alias("invalidated"), reasons("recovered").alias("recovered"))


@query(f"""WITH {ROWS_SQL}, s AS (SELECT path, symbol, arg_max(execution_valid, source_row_seq) AS able FROM v GROUP BY ALL), n AS (SELECT path, count(*) FILTER (able) AS able, count(*) AS symbols FROM s GROUP BY path),
a AS (SELECT path, bool_and(capture_valid) AS capture_valid, bool_and(clock_valid) AS clock_valid, sum(len(bad) + len(good))::BIGINT AS boundaries, sum(len(bad))::BIGINT AS invalidated, bool_or(coalesce(event = 'capture_trailer', false)) AS trailer FROM v GROUP BY path)
SELECT *, capture_valid AND clock_valid AND trailer AND invalidated = 0 AND able = symbols AS claim_ready FROM a JOIN n USING (path)""")
def capture_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return validity.verdict(validity.routes(_captures(spark, sf)))


# -- runs


@query("""WITH r AS (SELECT symbol, CASE kind WHEN 'view' THEN 'order_arrival' WHEN 'signup' THEN 'order_arrival_scheduled' WHEN 'click' THEN 'cancel_requested' WHEN 'error' THEN 'cancel_ack' ELSE 'fill' END AS e,
  k % 3 > 0 AS resting, CASE WHEN k % 3 > 0 THEN k - 50 END AS ahead, k % 4 AS immediate, lots - 2 AS remaining, k % 17 = 0 AS prevented FROM t)
SELECT symbol, count(*) FILTER (e = 'order_arrival_scheduled') AS arrival_scheduled, count(*) FILTER (e = 'order_arrival') AS arrived, count(*) FILTER (e = 'order_arrival' AND resting) AS rested_after_arrival,
  count(*) FILTER (e = 'order_arrival' AND immediate > 0) AS immediate_fill_arrivals, count(*) FILTER (e = 'order_arrival' AND NOT resting AND remaining > 0) AS expired_unfilled_arrivals,
  count(*) FILTER (e = 'order_arrival' AND prevented) AS self_trade_prevented, count(*) FILTER (e = 'cancel_requested') AS cancel_requested, count(*) FILTER (e = 'cancel_ack') AS cancel_acknowledged,
  count(*) FILTER (e = 'fill') AS fills, count(*) FILTER (e = 'markout') AS markouts, count(*) FILTER (e = 'order_arrival' AND resting AND ahead >= 0) AS queue_samples,
  count(*) FILTER (e = 'order_arrival' AND resting AND ahead > 0) AS with_queue, coalesce(sum(ahead) FILTER (e = 'order_arrival' AND resting AND ahead >= 0), 0)::BIGINT AS queue_sum,
  coalesce(max(ahead) FILTER (e = 'order_arrival' AND resting AND ahead >= 0), 0) AS queue_max, count(*) FILTER (e = 'order_arrival' AND resting AND ahead < 0) AS bad_queues FROM r GROUP BY symbol""")
def lifecycle_recount(spark: SparkSession, sf: str) -> DataFrame:
    k, kind = F.col("k"), F.col("kind")
    name = F.when(kind == "view", "order_arrival").when(kind == "signup", "order_arrival_scheduled").when(kind == "click", "cancel_requested").when(kind == "error", "cancel_ack").otherwise("fill")
    trace = tape(spark, sf).select(
        "symbol", name.alias("event_type"), (k % 3 > 0).alias("resting"), F.when(k % 3 > 0, k - 50).alias("ahead"), (k % 4).alias("immediate"),
        (F.col("lots") - 2).alias("remaining"), (k % 17 == 0).alias("prevented"),
    )
    return audit.lifecycle(trace, ["symbol"])


@query(f"""WITH {OPTION_SQL}, p AS (SELECT s.symbol, step FROM (SELECT DISTINCT symbol FROM x) s, (SELECT unnest(range(0, 120, 5)) AS step)),
m AS (SELECT symbol, step, sum(markout) AS m, sum(CASE WHEN toxic THEN markout ELSE 0 END) AS x FROM x GROUP BY ALL)
SELECT symbol, step, coalesce(m, 0)::BIGINT AS markout, coalesce(x, 0)::BIGINT AS toxic_markout, coalesce(sum(m) OVER w, 0)::BIGINT AS total, coalesce(sum(x) OVER w, 0)::BIGINT AS toxic_total
FROM p LEFT JOIN m USING (symbol, step) WINDOW w AS (PARTITION BY symbol ORDER BY step)""")
def markout_path(spark: SparkSession, sf: str) -> DataFrame:
    f = _option_fills(spark, sf)
    path = f.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(115).cast("long"), F.lit(5).cast("long"))).alias("step"))
    return research.markout_path(path, f, ["symbol"])


@query("""WITH h AS (SELECT symbol, seq % 7 AS contract, sum(lots)::BIGINT AS quantity, arg_max(tick, (ns, seq)) AS price FROM f GROUP BY ALL),
s AS (SELECT symbol, sum(CASE WHEN k % 2 = 0 THEN lots ELSE 0 END)::BIGINT AS quantity, max(tick) AS price FROM f GROUP BY ALL)
SELECT symbol, 'option' AS instrument, contract::VARCHAR AS contract, quantity, price, quantity * 100 * price AS mark_value, quantity * 100 * (contract - 3) AS net_delta, quantity * 100 * (contract + 1) AS net_vega FROM h WHERE quantity <> 0
UNION ALL SELECT symbol, 'underlying', NULL, quantity, price, quantity * price, quantity, 0 FROM s WHERE quantity <> 0""")
def option_positions(spark: SparkSession, sf: str) -> DataFrame:
    f = fill_rows(spark, sf).withColumn("contract", F.col("seq") % 7)
    held = f.groupBy("symbol", "contract").agg(F.sum("lots").alias("quantity"), F.max_by("tick", F.struct("ns", "seq")).alias("price"))
    held = held.select("symbol", F.col("contract").cast("string").alias("contract"), "quantity", "price", (F.col("contract") - 3).alias("delta"), (F.col("contract") + 1).alias("vega"))
    stock = f.groupBy("symbol").agg(F.sum(F.when(F.col("k") % 2 == 0, F.col("lots")).otherwise(0)).alias("quantity"), F.max("tick").alias("price"))
    return options.positions(held, stock, 100)


@query(f"""SELECT * FROM ({NETTING_SQL}, b AS (SELECT source, sum(lots)::BIGINT AS observed, sum(lots - netted)::BIGINT AS modeled FROM r GROUP BY source)
SELECT profile, source, observed, CASE WHEN profile = 'base' THEN modeled WHEN profile = 'aggressive' OR source = 'trade' THEN observed ELSE 0 END AS consumed
FROM b, (SELECT unnest(['conservative', 'base', 'aggressive']) AS profile))""")
def profile_consumption(spark: SparkSession, sf: str) -> DataFrame:
    """Lots that each set of assumptions lets the queues lose."""
    t = tape(spark, sf).where("kind IN ('view', 'purchase')")
    source = F.when(F.col("kind") == "view", "depth").otherwise("trade")
    signals = t.select("symbol", "side", F.floor(F.col("tick") / 500).alias("tick"), "ns", "seq", source.alias("source"), "lots")
    return book.profile_consumption(signals, 24 * HOUR)


@query("""WITH d AS (SELECT c_nationkey AS key, DATE '2024-01-01' + (c_custkey % (c_nationkey + 1))::INT AS day FROM customer)
SELECT key, count(DISTINCT day) AS days, count(DISTINCT day) >= 10 AS claim_ready, CASE WHEN count(DISTINCT day) < 3 THEN 'three days are needed to split'
  WHEN count(DISTINCT day) < 10 THEN 'only ' || count(DISTINCT day) || ' days; need 10' END AS reason FROM d GROUP BY key""")
def split_verdict(spark: SparkSession, sf: str) -> DataFrame:
    day = F.expr("date_add(DATE '2024-01-01', CAST(c_custkey % (c_nationkey + 1) AS INT))")
    return research.split_verdict(table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), day.alias("day")), ["key"])


# -- queues with an end


@query("""WITH e AS (SELECT symbol, side, tick // 500 AS tick, ns, seq, kind, lots, count(*) FILTER (kind = 'error') OVER (PARTITION BY symbol, side, tick // 500 ORDER BY ns, seq) AS stretch FROM t WHERE kind IN ('view', 'purchase', 'error')),
x AS (SELECT *, CASE kind WHEN 'view' THEN lots ELSE -lots END AS delta FROM e WHERE kind <> 'error'),
y AS (SELECT *, sum(delta) OVER w AS free, coalesce(sum(CASE WHEN delta < 0 THEN -delta END) OVER w, 0) AS before, coalesce(sum(CASE WHEN delta < 0 THEN -delta END) OVER (PARTITION BY symbol, side, tick, stretch), 0) AS total FROM x
  WINDOW w AS (PARTITION BY symbol, side, tick, stretch ORDER BY ns, seq)),
q AS (SELECT *, free - delta - least(0, coalesce(min(free) OVER (PARTITION BY symbol, side, tick, stretch ORDER BY ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ahead FROM y)
SELECT seq + 1 AS order_id, greatest(0, least(delta, total - before - ahead))::BIGINT AS filled FROM q WHERE delta > 0 AND least(delta, total - before - ahead) > 0""")
def queue_lives(spark: SparkSession, sf: str) -> DataFrame:
    """Lots that each order gets of its level's consumption before the next error there ends all that rest."""
    kind = F.col("kind")
    action = F.when(kind == "view", "place").when(kind == "purchase", "consume").otherwise("invalidate")
    rests = lambda c: F.when(kind == "view", c)
    events = tape(spark, sf).where("kind IN ('view', 'purchase', 'error')").select(
        "symbol", "side", F.floor(F.col("tick") / 500).alias("tick"), "ns", "seq", action.alias("action"), rests(F.col("seq") + 1).alias("order_id"), rests(F.lit(0).cast("long")).alias("ahead"), "lots",
    )
    taken = book.queue_lives(events).select(F.explode("filled").alias("fill"))
    return taken.groupBy(F.col("fill.order_id").alias("order_id")).agg(F.sum("fill.lots").alias("filled"))
