"""More registered queries: orders, registries, option fills, labels and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, ticks
from ..operators import book, fills, research
from ..operators.ordered import chunk_of
from ..sources import tape as source
from .catalogue import HOUR, NETTING_SQL, query
from .tape import fills as fill_rows
from .tape import table, tape

# -- orders

OWN_SQL = "o AS (SELECT symbol, ns, seq, side, tick // 500 AS tick, CASE WHEN k % 9 > 0 THEN ns + (k % 9) * 21600000000000 END AS end_ns FROM t WHERE kind = 'view')"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    life = F.when(F.col("k") % 9 > 0, F.col("ns") + F.col("k") % 9 * (6 * HOUR))
    return tape(spark, sf).where("kind = 'view'").select("symbol", "ns", "seq", "side", F.floor(F.col("tick") / 500).alias("tick"), life.alias("end_ns"))


@query(f"""WITH {OWN_SQL} SELECT symbol, side, seq, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -tick ELSE tick END, CASE side WHEN 'bid' THEN -ns ELSE ns END,
  CASE side WHEN 'bid' THEN -seq ELSE seq END) AS rank FROM o""")
def order_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return book.order_ranks(_orders(spark, sf)).select("symbol", "side", "seq", "rank")


@query(f"""WITH {OWN_SQL} SELECT symbol, seq, EXISTS (SELECT 1 FROM o r WHERE r.symbol = o.symbol AND r.side <> o.side AND (r.ns, r.seq) < (o.ns, o.seq) AND (r.end_ns IS NULL OR r.end_ns > o.ns)
  AND CASE o.side WHEN 'bid' THEN o.tick >= r.tick ELSE o.tick <= r.tick END) AS crosses FROM o""")
def self_crosses(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that would trade with an own one that still rests."""
    return book.self_crosses(_orders(spark, sf)).select("symbol", "seq", "crosses")


@query("""WITH h AS (SELECT unnest([3600000000000, 172800000000000]) AS h)
SELECT symbol, seq, (SELECT count(*) FROM f b, h WHERE b.symbol = a.symbol AND (b.ns, b.seq) < (a.ns, a.seq) AND b.ns + h.h > a.ns) AS pending,
  (SELECT count(*) FROM f b, h WHERE b.symbol = a.symbol AND (b.ns, b.seq) < (a.ns, a.seq) AND b.ns + h.h > a.ns) + 2 > 3 AS refused FROM f a""")
def pending_markouts(spark: SparkSession, sf: str) -> DataFrame:
    out = fills.pending_markouts(fill_rows(spark, sf), [HOUR, 48 * HOUR], 3)
    return out.select("symbol", "seq", "pending", "refused")


@query(f"""SELECT * FROM ({NETTING_SQL} SELECT coalesce(source, 'total') AS source, sum(lots)::BIGINT AS observed, sum(netted)::BIGINT AS netted, sum(lots - netted)::BIGINT AS modeled, count(*) FILTER (netted = lots) AS fully_netted FROM r GROUP BY ROLLUP (source))""")
def consumption_netted(spark: SparkSession, sf: str) -> DataFrame:
    """Observed, netted and modeled lots by source, and in all, of what the netting gives."""
    t = tape(spark, sf).where("kind IN ('view', 'purchase')")
    signals = t.select("symbol", "side", F.floor(F.col("tick") / 500).alias("tick"), "ns", "seq", F.when(F.col("kind") == "view", "depth").otherwise("trade").alias("source"), "lots")
    sums = book.overlap_netting(signals, 24 * HOUR).rollup("source").agg(F.sum("lots").alias("observed"), F.sum("netted").alias("netted"), F.sum("modeled").alias("modeled"), F.count_if(F.col("netted") == F.col("lots")).alias("fully_netted"))
    return sums.withColumn("source", F.coalesce("source", F.lit("total")))


# -- research


@query("""SELECT p_partkey, substring(sha256('{"config":{"brand":' || to_json(p_brand) || ',"size":' || p_size || '},"name":' || to_json(p_name) || '}'), 1, 16) AS variant_id FROM part""")
def variant_ids(spark: SparkSession, sf: str) -> DataFrame:
    config = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return table(spark, sf, "part").select("p_partkey", research.variant_id(F.col("p_name"), config).alias("variant_id"))


@query("""WITH r AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT c_custkey + 10 AS key, count(*) AS n FROM customer GROUP BY 1)
SELECT key, coalesce(r.n, 0) AS rows, coalesce(v.n, 0) AS variants, CASE WHEN v.n IS NULL THEN 'unregistered' WHEN r.n IS NULL THEN 'missing' ELSE 'duplicate' END AS issue
FROM r FULL JOIN v USING (key) WHERE v.n IS NULL OR r.n IS NULL OR r.n > 1 OR v.n > 1""")
def registry_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return research.registry_issues(rows, table(spark, sf, "customer").select((F.col("c_custkey") + 10).alias("key")), "key")


@query("""WITH a AS (SELECT symbol, tick, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS position FROM t WHERE kind = 'view'), b AS (SELECT symbol, tick, row_number() OVER (PARTITION BY symbol ORDER BY ns, seq) AS position FROM t WHERE kind = 'click')
SELECT symbol, position, a.tick AS "left", b.tick AS "right", a.tick - b.tick AS delta FROM a FULL JOIN b USING (symbol, position)""")
def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    t = tape(spark, sf)
    return research.paired(t.where("kind = 'view'"), t.where("kind = 'click'"), ["symbol"], chunk_of("ns", 24 * HOUR), ["ns", "seq"], "tick")


@query("""WITH s AS (SELECT symbol, k AS step, lots FROM f), c AS (SELECT DISTINCT symbol, unnest([10, 25, 50, 90]::BIGINT[]) AS step FROM f)
SELECT symbol, step, coalesce((SELECT sum(lots) FROM s WHERE s.symbol = c.symbol AND s.step <= c.step), 0)::BIGINT AS total FROM c""")
def checkpoint_sums(spark: SparkSession, sf: str) -> DataFrame:
    f = fill_rows(spark, sf).withColumn("step", F.col("k"))
    marks = f.select("symbol").distinct().select("symbol", F.explode(F.array(*[F.lit(s).cast("long") for s in (10, 25, 50, 90)])).alias("step"))
    return research.checkpoint_sums(f, marks, ["symbol"], "lots", block=20)


# -- option fills


OPTION_SQL = """x AS (SELECT symbol, seq, k AS step, 'C' || (seq % 7) AS contract, CASE side WHEN 'bid' THEN 'buy' ELSE 'sell' END AS mm_side, (tick - 2000) * lots AS markout, k % 3 = 0 AS toxic, k % 5 - 2 AS hedge_qty FROM f)"""


def _option_fills(spark: SparkSession, sf: str) -> DataFrame:
    return fill_rows(spark, sf).select(
        "symbol", "seq", F.col("k").alias("step"), F.concat(F.lit("C"), F.col("seq") % 7).alias("contract"), F.when(F.col("side") == "bid", "buy").otherwise("sell").alias("mm_side"),
        ((F.col("tick") - 2000) * F.col("lots")).alias("markout"), (F.col("k") % 3 == 0).alias("toxic"), (F.col("k") % 5 - 2).alias("hedge_qty"),
    )


@query(f"""WITH {OPTION_SQL} SELECT seq, CASE WHEN markout < 0 AND toxic THEN 'picked off' WHEN markout < 0 THEN 'adverse selection' WHEN mm_side = 'buy' THEN 'good buy' ELSE 'sold rich' END
  || CASE WHEN hedge_qty > 0 THEN '; hedged short delta' WHEN hedge_qty < 0 THEN '; hedged long delta' ELSE '' END AS comment, CASE mm_side WHEN 'buy' THEN sign(hedge_qty) ELSE -sign(hedge_qty) END::DOUBLE AS direction,
  round(1 / (0.2::DOUBLE + abs(ln((step + 1) / 50.0::DOUBLE))) * (1 / (0.05::DOUBLE + (step + 1) / 365.0::DOUBLE)), 9) AS weight FROM x""")
def fill_comments(spark: SparkSession, sf: str) -> DataFrame:
    weight = labels.contract_weight(F.lit(50.0), F.col("step") + 1, (F.col("step") + 1) / 365.0)
    return _option_fills(spark, sf).select("seq", labels.comment(F.col("mm_side"), F.col("markout"), F.col("toxic"), F.col("hedge_qty")).alias("comment"), labels.economic_direction(F.col("mm_side"), F.col("hedge_qty")).alias("direction"), F.round(weight, 9).alias("weight"))


@query(f"""WITH {OPTION_SQL} SELECT symbol, count(*) AS fills, sum(markout)::BIGINT AS markout, coalesce(sum(markout) FILTER (toxic), 0)::BIGINT AS toxic_markout, coalesce(sum(markout) FILTER (NOT toxic), 0)::BIGINT AS other_markout,
  count(*) FILTER (toxic) AS toxic_fills, round(count(*) FILTER (markout < 0) / count(*)::DOUBLE, 9) AS adverse_rate, max(markout) AS best, min(markout) AS worst FROM x GROUP BY symbol""")
def option_summary(spark: SparkSession, sf: str) -> DataFrame:
    return research.markout_summary(_option_fills(spark, sf), ["symbol"]).withColumn("adverse_rate", F.round("adverse_rate", 9))


@query(f"""WITH {OPTION_SQL}, h AS (SELECT *, median(abs(markout)) OVER (PARTITION BY symbol) AS middle FROM x WHERE hedge_qty <> 0), r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY abs(abs(markout) - middle), step, contract) AS n, step, contract, markout FROM h),
  s AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY NOT toxic, markout, step, contract) AS n, step, contract, markout FROM h)
SELECT u.symbol, r.contract AS contract, r.step AS step, r.markout AS markout, s.contract AS stress_contract, s.step AS stress_step, s.markout AS stress_markout FROM (SELECT DISTINCT symbol FROM x) u LEFT JOIN r ON r.symbol = u.symbol AND r.n = 1 LEFT JOIN s ON s.symbol = u.symbol AND s.n = 1""")
def worked_examples(spark: SparkSession, sf: str) -> DataFrame:
    out = research.worked_examples(_option_fills(spark, sf), ["symbol"])
    names = ("contract", "step", "markout")
    return out.select("symbol", *[F.col(f"representative.{c}").alias(c) for c in names], *[F.col(f"stress.{c}").alias(f"stress_{c}") for c in names])


# -- labels, details and economics of fills


@query("""WITH c AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'conservative' ELSE 'aggressive' END AS profile, k % 2 = 0 AS trades, k % 5 < 2 AS depth, k % 7 > 0 AS netting, k AS width FROM t)
SELECT *, 'public_l2:' || profile || ':signal=' || CASE WHEN trades AND depth THEN 'trade_and_depth' WHEN trades THEN 'trade' WHEN depth THEN 'depth' ELSE 'none' END || ':overlap_us=' || CASE WHEN netting AND trades AND depth THEN width * 250000 ELSE 0 END AS scenario_id FROM c""")
def scenario_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    profile = F.when(k % 3 == 0, "base").when(k % 3 == 1, "conservative").otherwise("aggressive")
    c = tape(spark, sf).select(profile.alias("profile"), (k % 2 == 0).alias("trades"), (k % 5 < 2).alias("depth"), (k % 7 > 0).alias("netting"), k.alias("width")).distinct()
    return c.withColumn("scenario_id", labels.scenario_id(*[F.col(x) for x in ("profile", "trades", "depth", "netting")], F.col("width") / 4.0))


@query("""SELECT seq, CASE kind WHEN 'purchase' THEN '{"tick":' || tick || ',"lots":' || lots || '}' WHEN 'error' THEN '{"reason":"' || side || '"}' ELSE '{}' END AS details FROM t""")
def trace_details(spark: SparkSession, sf: str) -> DataFrame:
    found = labels.details(F.col("kind"), {"purchase": {"tick": F.col("tick"), "lots": F.col("lots")}, "error": {"reason": F.col("side")}})
    return tape(spark, sf).select("seq", found.alias("details"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_type, ' '), lambda s: upper(trim(s))), lambda s: s <> '') AS parts, len(list_filter(list_transform(string_split(p_type, ' '), lambda s: upper(trim(s))), lambda s: s <> '')) AS n FROM part")
def symbol_lists(spark: SparkSession, sf: str) -> DataFrame:
    found = labels.symbols(F.concat(F.regexp_replace("p_type", " ", " , "), F.lit(", ")))
    return table(spark, sf, "part").select("p_partkey", found.alias("parts"), F.size(found).cast("long").alias("n"))


@query("""SELECT seq, round(CASE side WHEN 'bid' THEN 2100 - tick ELSE tick - 2100 END * abs(lots) / 100.0::DOUBLE, 6) AS capture, round(tick / 100.0::DOUBLE * abs(lots) * 10 * -0.5::DOUBLE / 10000, 6) AS fee,
  round((lots + k) / (abs(lots) + k)::DOUBLE, 9) AS imbalance, round(tick * 2.5::DOUBLE / 10000 / 0.5::DOUBLE, 9) AS bps_ticks, round(tick * 0.05::DOUBLE, 2) AS price, CASE WHEN k % 4 = 0 THEN (k // 4) || 's' ELSE (k * 250) || 'ms' END AS horizon FROM f""")
def fill_economics(spark: SparkSession, sf: str) -> DataFrame:
    lots, tick, k = F.abs("lots"), F.col("tick"), F.col("k")
    return fill_rows(spark, sf).select(
        "seq", F.round(ticks.spread_capture(F.col("side"), F.lit(21.0), tick / 100, lots), 6).alias("capture"), F.round(ticks.fee(tick / 100, lots, F.lit(10), F.lit(-0.5)), 6).alias("fee"),
        F.round(ticks.imbalance((lots + F.col("lots")) / 2 + k, (lots - F.col("lots")) / 2), 9).alias("imbalance"), F.round(ticks.bps_to_ticks(tick, F.lit(2.5), F.lit(0.5)), 9).alias("bps_ticks"),
        F.round(ticks.from_units(tick, F.lit("0.05")).cast("double"), 2).alias("price"), ticks.horizon_label(k * 250).alias("horizon"),
    )


# -- receipts


@query("""WITH r AS (SELECT symbol, seq, CASE WHEN k % 97 <> 5 THEN CASE WHEN k % 50 = 7 THEN seq - 400 ELSE seq END END AS recv_seq, ns - CASE WHEN k % 60 = 9 THEN 864000000000000 ELSE 0 END AS mono, kind FROM t),
g AS (SELECT *, last_value(recv_seq IGNORE NULLS) OVER w AS before, last_value(CASE WHEN recv_seq IS NOT NULL THEN mono END IGNORE NULLS) OVER w AS mono_before FROM r WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT symbol, count(*) FILTER (recv_seq IS NULL) AS missing, count(*) FILTER (recv_seq > before + 1) AS gaps, count(*) FILTER (recv_seq <= before) AS regressions, count(*) FILTER (recv_seq IS NOT NULL AND mono < mono_before) AS clock_regressions,
  count(*) FILTER (kind = 'error') AS invalidations, bool_or(kind = 'signup') AS trailer FROM g GROUP BY symbol)
SELECT *, missing = 0 AND gaps = 0 AND regressions = 0 AND clock_regressions = 0 AND trailer AS receipt_ok, missing = 0 AND gaps = 0 AND regressions = 0 AND clock_regressions = 0 AND trailer AND invalidations = 0 AS valid FROM a""")
def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of each symbol's rows as if it were a capture."""
    k = F.col("k")
    rows = tape(spark, sf).select(
        F.col("symbol").alias("path"), F.col("seq").alias("source_row_seq"), F.when(k % 97 != 5, F.when(k % 50 == 7, F.col("seq") - 400).otherwise(F.col("seq"))).alias("recv_seq"),
        (F.col("ns") - F.when(k % 60 == 9, 240 * HOUR).otherwise(0)).alias("recv_monotonic_ns"), F.lit(3).alias("schema_version"), F.lit(True).alias("receive_clock"), (F.col("kind") == "error").alias("invalidation"), (F.col("kind") == "signup").alias("trailer"),
    )
    return source.receipts(rows).select(F.col("path").alias("symbol"), "missing", "gaps", "regressions", "clock_regressions", "invalidations", "trailer", "receipt_ok", "valid")
