import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import options, ticks
from tidemark.operators import audit, book, fills, research
from tidemark.operators.asof import asof
from tidemark.operators.ordered import previous, running
from tests.conftest import SF


def tape(n, seed, symbols=3):
    rng = random.Random(seed)
    return [(rng.randrange(symbols), rng.randrange(200), i, rng.choice([None, 1, 2, 3, -4])) for i in range(n)]


def test_running_values_equal_one_ordered_pass(spark):
    rows = tape(300, 1)
    df = spark.createDataFrame(rows, "symbol long, ns long, seq long, v long")
    for before, reverse in itertools.product((False, True), repeat=2):
        out = running(df, ["symbol"], F.floor(F.col("ns") / 20).cast("long"), ["ns", "seq"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, before=before, reverse=reverse)
        found = {r.seq: (r.s, r.m, r.l) for r in out.collect()}
        for symbol in range(3):
            seen = []
            for _, _, seq, v in sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1:3], reverse=reverse):
                if not before:
                    seen.append(v)
                real = [x for x in seen if x is not None]
                assert found[seq] == (sum(real), max(real, default=None), real[-1] if real else None)
                if before:
                    seen.append(v)


def test_previous_handles_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, 1, 5), (None, 2, 2, 6), (1, 1, 3, 7)], "symbol long, ns long, seq long, v long")
    out = {r.seq: r.p for r in previous(df, ["symbol"], F.col("ns"), ["ns", "seq"], {"p": F.col("v")}).collect()}
    assert out == {1: None, 2: 5, 3: None}
    assert previous(df.limit(0), ["symbol"], F.col("ns"), ["ns"], {"p": F.col("v")}).count() == 0


def test_asof_both_ways(spark):
    rng = random.Random(3)
    left = [(rng.randrange(3), rng.randrange(100), i) for i in range(80)]
    right = [(rng.randrange(3), rng.randrange(100), i, i * 10) for i in range(80)]
    a = spark.createDataFrame(left, "symbol long, ns long, seq long")
    b = spark.createDataFrame(right, "symbol long, ns long, seq long, mark long")
    for forward in (False, True):
        found = {r.seq: (r.at_asof, r.mark_asof) for r in asof(a, b, ["symbol"], F.col("ns"), F.col("ns"), ["mark"], forward=forward, width=7).collect()}
        for symbol, ns, seq in left:
            if forward:
                m = min((r[1:] for r in right if r[0] == symbol and r[1] >= ns), default=None)
            else:
                m = max((r[1:] for r in right if r[0] == symbol and r[1] <= ns), default=None)
            assert found[seq] == ((m[0], m[2]) if m else (None, None))


def test_overlap_netting_depletes_credits_in_order(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), "bid", rng.randrange(2), rng.randrange(0, 4000, 10), i, rng.choice(["depth", "trade"]), rng.randrange(1, 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol long, side string, tick long, ns long, seq long, source string, lots long")
    for consuming in (("depth", "trade"), ("trade",)):
        found = {r.seq: (r.netted, r.modeled) for r in book.overlap_netting(df, 50, consuming).collect()}
        credits = {}
        for symbol, side, tick, ns, seq, source, lots in sorted(rows, key=lambda r: (r[3], r[4])):
            rest, own = lots, credits.setdefault((symbol, side, tick), [])
            for c in own:
                if ns - c[0] <= 50 and c[1] != source:
                    used = min(rest, c[2])
                    c[2], rest = c[2] - used, rest - used
            if rest and source in consuming:
                own.append([ns, source, rest])
            assert found[seq] == (lots - rest, rest)


def test_position_cost_basis(spark):
    df = spark.createDataFrame([(1, 1, 1, 10, 100), (1, 2, 2, -4, 110), (1, 3, 3, -10, 120), (1, 4, 4, 4, 90)], "symbol long, ns long, seq long, lots long, tick long")
    r = fills.position(df).first()
    assert (r.lots, r.cost, r.realized, r.fills) == (0, 0, 40 + 120 + 120, 4)


def test_ticks(spark):
    df = spark.createDataFrame([("1.5",), ("1.55",), ("-1",), ("nan",)], "p string")
    out = [tuple(r) for r in df.select(*[ticks.to_units(F.col("p").try_cast("decimal(18,4)"), F.lit("0.1").cast("decimal(18,4)"), how) for how in ("exact", "round", "floor", "ceil")]).collect()]
    assert out == [(15, 15, 15, 15), (None, 16, 15, 16), (None, -10, -10, -10), (None, None, None, None)]
    r = spark.range(1).select(ticks.exchange_ns(F.lit("1700000000123")), ticks.exchange_ns(F.lit("1700000000.5")), ticks.horizon_label(F.lit(5000)), ticks.horizon_label(F.lit(250))).first()
    assert tuple(r) == (1700000000123000000, 1700000000500000000, "5s", "250ms")


def test_options_against_closed_form(spark):
    xs = [x / 4 for x in range(-40, 41)]
    found = {r.x: r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", options.normal_cdf(F.col("x")).alias("c")).collect()}
    assert all(abs(found[x] - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-12 for x in xs)
    df = spark.createDataFrame([(100.0, 100.0, t, 0.02, 0.3, k) for t in (0.5, 0.0) for k in ("call", "put")], "spot double, strike double, years double, rate double, vol double, option_type string")
    rows = {(r.years, r.option_type): r for r in options.with_greeks(df).collect()}
    call, put = rows[0.5, "call"], rows[0.5, "put"]
    assert abs(call.fair - put.fair - (100 - 100 * math.exp(-0.01))) < 1e-9
    assert abs(call.delta - put.delta - 1) < 1e-12 and call.gamma > 0 and call.vega > 0 and call.theta < 0
    assert rows[0.0, "call"].fair == 0 and rows[0.0, "call"].gamma == 0


def test_bootstrap_draws_one_stream(spark):
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame(list(enumerate(values)), "day long, value double")
    r = research.bootstrap(df, "day", "value", block=3, replicates=50, seed=7).first()
    state, means = 7, []
    for _ in range(50):
        picked = []
        for _ in range(3):
            state = (state + research.GAMMA) % 2**64
            z = state
            z = (z ^ (z >> 30)) * research.MIX_1 % 2**64
            z = (z ^ (z >> 27)) * research.MIX_2 % 2**64
            start = (z ^ (z >> 31)) % 6
            picked += values[start : start + 3]
        means.append(sum(picked[:8]) / 8)
    assert abs(r.low - np.quantile(means, 0.025)) < 1e-12 and abs(r.high - np.quantile(means, 0.975)) < 1e-12


def test_audit_rules_and_claims(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "seq long, v long")
    assert [tuple(r) for r in audit.violations(df, {"v": F.col("v") > 3}).select("seq", "reasons").collect()] == [(2, ["v"])]
    assert tuple(audit.coverage(df, ["seq", "v"]).first()) == (2, 2, 1, False)
    s = spark.createDataFrame([(True, True, True, False, False, 1, 0), (True, True, True, False, True, 1, 0)], "book boolean, clock boolean, capture boolean, trade boolean, trade_required boolean, streams long, invalidations long")
    assert [r.claim_ready for r in audit.claims(s).collect()] == [True, False]
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "name string, digest string")
    assert {r.name: r.deterministic for r in audit.deterministic(d).collect()} == {"a": True, "b": False}


def test_results_do_not_depend_on_row_order_or_partitions(spark):
    from tidemark.plans.tape import fills as fill_rows

    f = fill_rows(spark, SF)
    a = sorted(map(tuple, fills.position(f).collect()))
    assert a == sorted(map(tuple, fills.position(f.repartition(7).orderBy(F.rand(3))).collect()))


def test_crc32c_and_latency_draws(spark):
    from tidemark.functions import hashing

    df = spark.createDataFrame([(0, "123456789"), (1, ""), (2, None), (3, "a" * 100)], "i long, s string")
    assert [r.c for r in df.select("i", hashing.crc32c(F.col("s")).alias("c")).orderBy("i").collect()] == [0xE3069283, 0, None, hashing_reference("a" * 100)]
    draws = hashing.latency_draws(spark.range(1000), "id", seed=3, samples_us=[1, 2, 3], tail_us=99, tail_per_million=100_000)
    a = {r.id: r.latency_us for r in draws.collect()}
    b = {r.id: r.latency_us for r in hashing.latency_draws(spark.range(1000).repartition(5), "id", seed=3, samples_us=[1, 2, 3], tail_us=99, tail_per_million=100_000).collect()}
    assert a == b and set(a.values()) == {1, 2, 3, 99} and 50 < sum(v == 99 for v in a.values()) < 160


def hashing_reference(text):
    crc = 0xFFFFFFFF
    for byte in text.encode():
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_reservations_hold_the_limit(spark):
    from tidemark.operators import ledger
    from tidemark.plans import catalogue

    rows = [(1, 1, 1, "reserve", 1, 8), (1, 2, 2, "reserve", 2, 5), (1, 3, 3, "fill", 1, -3), (1, 4, 4, "release", 1, 0), (1, 5, 5, "reserve", 2, 7), (1, 6, 6, "fill", 3, 1), (2, 1, 7, "release", 1, 0)]
    out = ledger.reservations(spark.createDataFrame(rows, "symbol long, ns long, seq long, action string, order_id long, lots long"), 10)
    assert [tuple(r) for r in out.orderBy("seq").select("accepted", "reserved", "inventory").collect()] == [(True, 8, 0), (False, 8, 0), (True, 5, -3), (True, 0, -3), (True, 7, -3), (False, 7, -3), (False, 0, 0)]
    assert all(r.reserved + abs(r.inventory) <= 12 for r in catalogue.reservation_ledger(spark, SF).collect())


def test_sweeps_walk_all_levels(spark):
    rng = random.Random(3)
    levels = [(s, side, tick, rng.randrange(1, 9)) for s in ("a", "b") for side, ticks in (("bid", range(1, 201)), ("ask", range(301, 501))) for tick in ticks]
    orders = [(rng.choice("ab"), i, rng.choice(("bid", "ask")), rng.randrange(600), rng.choice((0, 1, 7, 64, 500, 2000))) for i in range(200)]
    wanted = []
    for symbol, i, side, limit, rest in orders:
        for _, _, tick, lots in sorted((x for x in levels if x[0] == symbol and x[1] != side), key=lambda x: x[2], reverse=side == "ask"):
            if rest <= 0 or (tick > limit if side == "bid" else tick < limit):
                break
            wanted.append((symbol, i, side, tick, min(rest, lots)))
            rest -= min(rest, lots)
    df = spark.createDataFrame(orders, "symbol string, order_id long, side string, limit_tick long, lots long")
    found = book.sweep(df, spark.createDataFrame(levels, "symbol string, side string, tick long, lots long")).collect()
    assert sorted(map(tuple, found)) == sorted(wanted) and max(n for n in np.bincount([r.order_id for r in found])) > 50


def test_queue_fills_equal_a_queue(spark):
    rng = random.Random(9)
    rows = [(1, "bid", rng.randrange(3), rng.randrange(10**14), i, rng.randrange(1, 6), rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol long, side string, tick long, ns long, seq long, lots long, order boolean")
    found = {r.seq: (r.ahead, r.filled) for r in book.queue_fills(df.where("order").drop("order"), df.where("NOT order").drop("order")).collect()}
    for tick in range(3):
        queue, ahead, filled = [], {}, {}
        for *_, seq, lots, order in sorted((r for r in rows if r[2] == tick), key=lambda r: r[3:5]):
            if order:
                ahead[seq], filled[seq] = sum(q[1] for q in queue), 0
                queue.append([seq, lots])
                continue
            while queue and lots:
                used = min(lots, queue[0][1])
                filled[queue[0][0]] += used
                queue[0][1] -= used
                lots -= used
                if not queue[0][1]:
                    queue.pop(0)
        assert all(found[s] == (ahead[s], filled[s]) for s in ahead)


def test_option_books_and_quotes(spark):
    from tidemark.plans import catalogue

    rows = catalogue.option_quotes(spark, SF).collect()
    assert rows and all(0.01 <= r.bid < r.ask for r in rows)
    df = spark.createDataFrame([("a", 2.0, k, 100.0, 100.0, 0.5, 0.0, 0.2) for k in ("call", "put")], "book string, size double, option_type string, spot double, strike double, years double, rate double, vol double")
    r = options.portfolio(options.with_greeks(df), ["book"]).first()
    one = options.with_greeks(df).where("option_type = 'call'").first()
    assert abs(r.gamma - 4 * one.gamma) < 1e-12 and abs(r.delta - 2 * (2 * one.delta - 1)) < 1e-9


def test_units_are_exact_to_18_decimals(spark):
    rows = [("0.00000000004", "0.1"), ("0.000000000000000003", "0.000000000000000001"), ("12345678901234567.3", "0.1"), ("1", "0"), ("1", None), ("-0.25", "0.1"), ("0.25", "0.1"), ("x", "1")]
    df = spark.createDataFrame(rows, "v string, u string")
    out = [tuple(r) for r in df.select(*[ticks.to_units(F.col("v"), F.col("u"), how) for how in ("exact", "round", "floor", "ceil")]).collect()]
    assert out == [(None, 0, 0, 1), (3, 3, 3, 3), (123456789012345673,) * 4, (None,) * 4, (None,) * 4, (None, -3, -3, -2), (None, 3, 2, 3), (None,) * 4]


def test_framed_windows_equal_one_window(spark):
    from pyspark.sql import Window

    from tidemark.operators.ordered import framed

    df = spark.createDataFrame([(0, ns, seq, v) for _, ns, seq, v in tape(400, 4)], "symbol long, ns long, seq long, v long")
    f = {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count("*").over(w)}
    found = framed(df, ["symbol"], F.floor(F.col("ns") / 20).cast("long"), ["ns", "seq"], 12, f, block=50)
    plain = Window.partitionBy("symbol").orderBy("ns", "seq").rowsBetween(-11, 0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.select("*", *[c(plain).alias(k) for k, c in f.items()]).collect()))


def test_positions_are_cut_where_they_are_flat(spark):
    rng = random.Random(11)
    rows = [(s, i, i, rng.choice([-2, -1, 1, 2]), rng.randrange(90, 110)) for i in range(300) for s in (1,)]
    df = spark.createDataFrame(rows, "symbol long, ns long, seq long, lots long, tick long")
    lots = cost = realized = 0
    for _, _, _, q, tick in rows:
        closed = min(abs(lots), abs(q)) if lots * q < 0 else 0
        sign = (lots > 0) - (lots < 0)
        part = cost if closed == abs(lots) else int(abs(cost) * closed // abs(lots)) * (1 if cost > 0 else -1)
        realized += sign * closed * tick - part
        cost += (q + sign * closed) * tick - part
        lots += q
    r = fills.position(df).first()
    assert (r.lots, r.cost, r.realized, r.fills) == (lots, cost, realized, 300)
    marks = spark.createDataFrame([(1, 100.0)], "symbol long, mid double")
    v = fills.pnl(fills.position(df), marks).first()
    assert v.unrealized == (lots * 100.0 - cost if lots else 0) and v.total == realized + v.unrealized
    assert fills.portfolio_pnl(fills.pnl(fills.position(df.where("seq < 1")), marks.limit(0))).first().total is None


def test_one_symbol_of_all_rows_is_spread(spark):
    """No task of a window gets more than a few chunks of a symbol that has all rows."""
    from pyspark.sql import Window

    from tidemark.operators.ordered import framed, numbered

    df = spark.range(40_000).select(F.lit(1).alias("symbol"), (F.col("id") * 10**9).alias("ns"), F.col("id").alias("seq"))
    rows = numbered(df, ["symbol"], F.floor(F.col("ns") / (3600 * 10**9)).cast("long"), ["ns", "seq"], "n")
    assert rows.where("n <> seq + 1").count() == 0
    out = framed(df, ["symbol"], F.floor(F.col("ns") / (3600 * 10**9)).cast("long"), ["ns", "seq"], 5, {"c": lambda w: F.count("*").over(w)}, block=1000)
    sizes = {}
    for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        if "Window [" in line and "_tm_block" in line:
            sizes["blocked"] = True
    assert sizes and out.agg(F.sum("c")).first()[0] == 5 * 40_000 - 10


def test_notional_ledger_equals_a_recount(spark):
    from tidemark.plans import catalogue

    rows = catalogue.notional_ledger(spark, SF).orderBy("portfolio", "ns", "seq").collect()
    book, orders, held = None, {}, {}
    for r in rows:
        if r.portfolio != book:
            book, orders, held = r.portfolio, {}, {}
        live = lambda: sum(o["left"] for o in orders.values() if o["state"] in ("live", "pending"))  # noqa: B023, E731
        o, why = orders.get(r.order_id), ""
        if r.action == "reserve":
            why = "duplicate_order_id" if o else "portfolio_notional_limit" if live() + sum(map(abs, held.values())) + r.units > 60 else ""
            if not o:
                orders[r.order_id] = {"symbol": r.symbol, "bid": r.is_bid, "left": r.units, "state": "refused" if why else "live"}
        elif not o or o["state"] == "refused":
            why = "unknown_order"
        elif r.action == "cancel":
            why = "" if o["state"] == "live" else "order_not_live"
            o["state"] = o["state"] if why else "pending"
        elif r.action == "ack":
            why = "" if o["state"] == "pending" else "cancel_not_pending"
            o["state"] = o["state"] if why else "cancelled"
        else:
            after = {**held, o["symbol"]: held.get(o["symbol"], 0) + (r.units if o["bid"] else -r.units)}
            if o["state"] not in ("live", "pending"):
                why = "order_not_fillable"
            elif r.units > o["left"]:
                why = "fill_exceeds_remaining"
            elif sum(map(abs, after.values())) + live() - r.units > 60:
                why = "portfolio_notional_limit"
            else:
                held = after
                o["left"] -= r.units
                o["state"] = o["state"] if o["left"] else "filled"
        assert (r.reason, r.reserved, r.inventory) == (why, live(), sum(map(abs, held.values())))
    assert {r.reason for r in rows} >= {"", "duplicate_order_id", "portfolio_notional_limit", "unknown_order"}
