"""Faults planted in traces, own crosses of orders that rest for long, and what a portfolio has at stake."""

import random

import pytest

from tidemark.operators import audit, book, ledger

TRACE = "seq long, kind string, symbol string, order_id long, ns long, lots long, ahead_before long, ahead_after long, left_after long, fill_seq long, horizon_ns long"


def sound_trace(orders=12):
    """Orders that wait, are filled in two parts or cancelled, and whose fills are marked out at two horizons."""
    rng, rows, ns = random.Random(2), [], 0
    steps = []
    for o in range(orders):
        lots = rng.randrange(2, 6)
        life = [("place", o, lots, None, 9, lots)] + [("queue", o, None, a, b, None) for a, b in ((9, 5), (5, 0))]
        life += [("fill", o, 1, 0, 0, lots - 1), ("fill", o, lots - 1, 0, 0, 0)] if o % 3 else [("cancel", o, None, None, 0, None)]
        steps.append(life)
    while any(steps):
        life = rng.choice([s for s in steps if s])
        kind, o, lots, before, after, left = life.pop(0)
        ns += rng.randrange(3)
        rows.append([len(rows), kind, "S", o, ns, lots, before, after, left, None, None])
    due = []
    for r in [r for r in rows if r[1] == "fill"]:
        due += [(r[4] + h, r[3], r[0], h) for h in (100, 200)]
    for at, o, fill, h in sorted(due):
        ns = max(ns, at)
        rows.append([len(rows), "markout", "S", o, ns, None, None, None, None, fill, h])
    return rows


def faults(spark, rows, chunk):
    found = audit.trace_faults(spark.createDataFrame([tuple(r) for r in rows], TRACE).repartition(3), [100, 200], chunk=chunk)
    return {(r.seq, reason) for r in found.collect() for reason in r.reasons}


@pytest.mark.parametrize("chunk", [4, 100_000])
def test_planted_faults_are_found_and_nothing_else(spark, chunk):
    rows = sound_trace()
    assert faults(spark, rows, chunk) == set()
    of = lambda kind, n=0: [r[0] for r in rows if r[1] == kind][n]
    last_fill = max(r[0] for r in rows if r[1] == "fill" and r[8] == 0)
    order = rows[last_fill][3]
    later = next(r for r in rows if r[0] > last_fill and r[1] == "markout")

    def planted(*edits):
        out = [list(r) for r in rows]
        for seq, column, value in edits:
            out[seq][column] = value
        return faults(spark, out, chunk)

    queue, fill = of("queue", 3), of("fill")
    assert (queue, "queue_path") in planted((queue, 6, 7))
    assert (queue, "queue_grows") in planted((queue, 7, 10))
    assert (fill, "fill_in_queue") in planted((fill, 7, 1))
    assert (fill, "left") in planted((fill, 8, 77))
    assert (of("place", 4), "left") in planted((of("place", 4), 5, 0))
    assert planted((of("markout"), 9, of("place"))) == {(of("markout"), "unknown_fill")} or (of("markout"), "unknown_fill") in planted((of("markout"), 9, of("place")))
    assert (of("markout"), "horizon") in planted((of("markout"), 10, 150))
    assert (of("markout", 1), "markout_twice") in planted((of("markout", 1), 9, rows[of("markout")][9]), (of("markout", 1), 10, rows[of("markout")][10]), (of("markout", 1), 3, rows[of("markout")][3]))
    assert (20, "clock") in planted((20, 4, -5)) and (20, "unknown_kind") in planted((20, 1, "other"))
    changed = planted((later[0], 1, "cancel"), (later[0], 3, order), (later[0], 9, None), (later[0], 10, None))
    assert changed == {(later[0], "after_end")}
    assert (of("place", 2), "unplaced") in planted((of("place", 2), 1, "cancel"))
    assert (fill, "placed_twice") in planted((fill, 1, "place"))
    gone = [r for r in rows if r[0] != 10]
    assert (11, "sequence") in faults(spark, gone, chunk)


def test_own_crosses_of_orders_without_end(spark):
    rng = random.Random(6)
    rows = [("AB"[i % 5 == 0], i // 2, i, rng.choice(("bid", "ask")), rng.randrange(40), rng.choice((None, i // 2, i // 2 + rng.randrange(1, 90)))) for i in range(500)]
    df = spark.createDataFrame([*rows, (None, 1, 900, "bid", 99, None), ("A", 1, 901, "bid", None, None)], "symbol string, ns long, seq long, side string, tick long, end_ns long")
    for slot_rows in (7, 50_000):
        found = {r.seq: r.crosses for r in book.self_crosses(df, slot_rows).collect()}
        assert len(found) == 502 and not found[900] and not found[901]
        for symbol, ns, seq, side, tick, _ in rows:
            hit = any(s == symbol and d != side and (n, q) < (ns, seq) and (e is None or e > ns) and (tick >= t if side == "bid" else tick <= t) for s, n, q, d, t, e in rows)
            assert found[seq] == hit


def test_what_a_portfolio_has_at_stake(spark):
    inventory = spark.createDataFrame([("A", -3), ("B", 0), ("C", 2)], "symbol string, lots long")
    orders = spark.createDataFrame([("A", 10, 2, "live"), ("A", 11, 1, "pending"), ("B", 5, -4, "live"), ("B", 5, 9, "done")], "symbol string, tick long, lots long, state string")
    marks = lambda *rows: spark.createDataFrame(list(rows), "symbol string, mid double")
    assert tuple(ledger.gross_notional(inventory, marks(("A", 10.5), ("C", 2.0)), orders).first()) == (35.5, 40, 11, 86.5, 0)
    assert tuple(ledger.gross_notional(inventory, marks(("A", 10.5)), orders).first()) == (None, 40, 11, None, 1)
    assert tuple(ledger.gross_notional(inventory.limit(0), marks(), orders.limit(0)).first()) == (0.0, 0, 0, 0.0, 0)
