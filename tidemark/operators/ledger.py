"""Ledgers whose decisions depend on what came before: reservations against a limit, and scheduled actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import chunk_of, numbered


def reservations(events: DataFrame, limit: int) -> DataFrame:
    """Adds accepted, reserved and inventory after each event (symbol, ns, seq, action, order_id, lots).

    ``reserve`` holds lots for an order if reserved + |inventory| + lots stay within the limit; ``release``
    frees what the order still holds; ``fill`` turns signed lots of the order's hold into inventory. An
    event that can't apply is not accepted and changes nothing. Decisions feed back, so a symbol's events
    run in order in one task; state is one number per open order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, held, total, inventory = None, {}, 0, 0
        for rows in batches:
            out = []
            for r in rows[["symbol", "action", "order_id", "lots"]].itertuples(index=False):
                if r.symbol != symbol:
                    symbol, held, total, inventory = r.symbol, {}, 0, 0
                ok = False
                if r.action == "reserve" and r.lots > 0 and r.order_id not in held:
                    ok = total + abs(inventory) + r.lots <= limit
                    if ok:
                        held[r.order_id] = r.lots
                        total += r.lots
                elif r.action == "release":
                    ok = r.order_id in held
                    total -= held.pop(r.order_id, 0)
                elif r.action == "fill" and 0 < abs(r.lots) <= held.get(r.order_id, 0):
                    ok, inventory = True, inventory + r.lots
                    held[r.order_id] -= abs(r.lots)
                    total -= abs(r.lots)
                    if not held[r.order_id]:
                        del held[r.order_id]
                out.append((ok, total, inventory))
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame(out, columns=["accepted", "reserved", "inventory"])], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", accepted boolean, reserved long, inventory long"
    return events.repartition("symbol").sortWithinPartitions("symbol", "ns", "seq").mapInPandas(run, schema)


def scheduled(actions: DataFrame, cancels: DataFrame) -> DataFrame:
    """Actions (symbol, due_ns, seq, action_id) that no cancel takes back before they are due, numbered in their order of execution."""
    taken = cancels.groupBy("symbol", "action_id").agg(F.min("ns").alias("_cancel_ns"))
    live = actions.join(taken, ["symbol", "action_id"], "left").where(F.col("_cancel_ns").isNull() | (F.col("_cancel_ns") > F.col("due_ns"))).drop("_cancel_ns")
    return numbered(live, ["symbol"], chunk_of("due_ns"), ["due_ns", "seq"], "position")


#: Why an event of the notional ledger is refused.
REFUSALS = ("invalid_order_id", "duplicate_order_id", "invalid_notional", "portfolio_notional_limit", "unknown_order", "order_not_live", "cancel_not_pending", "order_not_fillable", "invalid_fill_quantity", "fill_exceeds_remaining", "")


def notional_reservations(events: DataFrame, limit: int) -> DataFrame:
    """Adds reason ("" if accepted), reserved and inventory (gross) after each event (portfolio, ns, seq, action, symbol, order_id, is_bid, units).

    One limit holds for a portfolio: the sum of its symbols' inventories by size and of all that live orders and those with a
    pending cancel may still take, never netted. Actions: inventory (marks a symbol), reserve, cancel, ack, fill, invalidate (ends all open orders).
    A refused event changes nothing, but an order id is used up by its first reserve. Every decision feeds back, so a portfolio's events
    run in order in one task; state is a row per order and symbol.
    """
    bad_id, twice, bad_units, over, unknown, dead, no_cancel, closed, bad_fill, exceeds, fine = REFUSALS
    lives = ("live", "pending_cancel")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, orders, held, reserved, gross = None, {}, {}, 0, 0
        for rows in batches:
            out = []
            for r in rows[["portfolio", "action", "symbol", "order_id", "is_bid", "units"]].itertuples(index=False):
                if r.portfolio != book:
                    book, orders, held, reserved, gross = r.portfolio, {}, {}, 0, 0
                order, why = orders.get(r.order_id), fine
                if r.action == "inventory":
                    after = gross - abs(held.get(r.symbol, 0)) + abs(r.units)
                    if after + reserved > limit:
                        why = over
                    else:
                        held[r.symbol], gross = r.units, after
                elif r.action == "reserve":
                    if r.order_id < 0:
                        why = bad_id
                    elif order:
                        why = twice
                    else:
                        why = bad_units if r.units <= 0 else over if gross + reserved + r.units > limit else fine
                        orders[r.order_id] = [r.symbol, r.is_bid, r.units, "live" if why == fine else "refused"]
                        reserved += r.units if why == fine else 0
                elif r.action == "invalidate":
                    for order in orders.values():
                        order[3] = "invalidated" if order[3] in lives else order[3]
                    reserved = 0
                elif not order or order[3] == "refused":
                    why = unknown
                elif r.action == "cancel":
                    why, order[3] = (fine, "pending_cancel") if order[3] == "live" else (dead, order[3])
                elif r.action == "ack":
                    why = fine if order[3] == "pending_cancel" else no_cancel
                    if why == fine:
                        order[3], reserved = "cancelled", reserved - order[2]
                elif r.action == "fill":
                    why = closed if order[3] not in lives else bad_fill if r.units <= 0 else exceeds if r.units > order[2] else fine
                    if why == fine:
                        now = held.get(order[0], 0) + (r.units if order[1] else -r.units)
                        after = gross - abs(held.get(order[0], 0)) + abs(now)
                        if after + reserved - r.units > limit:
                            why = over
                        else:
                            held[order[0]], gross, reserved = now, after, reserved - r.units
                            order[2] -= r.units
                            order[3] = order[3] if order[2] else "filled"
                out.append((why, reserved, gross))
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame(out, columns=["reason", "reserved", "inventory"])], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", reason string, reserved long, inventory long"
    return events.repartition("portfolio").sortWithinPartitions("portfolio", "ns", "seq").mapInPandas(run, schema)


def gross_notional(inventory: DataFrame, marks: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: what a portfolio has at stake in inventory at its marks, in live and in pending orders at their prices, and in all; null where a held symbol has no mark.

    ``inventory``: symbol, lots; ``marks``: symbol, mid; ``orders``: symbol, tick, lots, state (live, pending; others don't count). Sums of
    parts, so no row but one a symbol is shuffled. Nothing held or ordered: zeros.
    """
    held = inventory.join(marks.select("symbol", "mid"), "symbol", "left").where("lots <> 0")
    stake = held.agg(F.count_if(F.col("mid").isNull()).alias("unpriced"), F.coalesce(F.sum(F.abs("lots") * F.col("mid")), F.lit(0.0)).cast("double").alias("inventory"))
    at = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, F.col("tick") * F.abs("lots"))), F.lit(0)).cast("long").alias(state)
    both = stake.crossJoin(F.broadcast(orders.agg(at("live"), at("pending"))))  # a row each
    whole = F.when(F.col("unpriced") == 0, F.col("inventory"))
    return both.select(whole.alias("inventory"), "live", "pending", (whole + F.col("live") + F.col("pending")).alias("gross"), "unpriced")
