"""Books from level updates: epochs, level changes, best levels, queues, overlap of signals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .levels import Book
from .ordered import chunk_of, numbered, previous, running


def epochs(tape: DataFrame, boundary: Column) -> DataFrame:
    """Adds ``epoch``: boundaries of the symbol up to and with the row."""
    return running(tape, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"epoch": ("sum", F.when(boundary, 1).otherwise(0).cast("long"))})


def validity(tape: DataFrame, transition: Column) -> DataFrame:
    """Adds ``valid``: the last transition (true, false, or null for none) of the symbol; true before any."""
    out = running(tape, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"valid": ("last", transition)})
    return out.withColumn("valid", F.coalesce("valid", F.lit(True)))


def level_changes(levels: DataFrame) -> DataFrame:
    """Rows (symbol, side, tick, ns, seq, lots) that change a level, with previous_lots; a level starts at 0."""
    out = previous(levels, ["symbol", "side", "tick"], chunk_of("ns", 24 * 3_600_000_000_000), ["ns", "seq"], {"previous_lots": F.col("lots")})
    return out.withColumn("previous_lots", F.coalesce("previous_lots", F.lit(0))).where("lots <> previous_lots")


def book(levels: DataFrame) -> DataFrame:
    """Live levels (symbol, side, tick, lots): the last update of each, if it isn't 0. Mergeable, so partly aggregated before the shuffle."""
    return levels.groupBy("symbol", "side", "tick").agg(F.max_by("lots", F.struct("ns", "seq")).alias("lots")).where("lots > 0")


def best(book_levels: DataFrame) -> DataFrame:
    """Best bid and ask, mid (null if a side is empty) and number of levels of each symbol."""
    side = lambda s: F.when(F.col("side") == s, F.col("tick"))
    out = book_levels.groupBy("symbol").agg(F.max(side("bid")).alias("best_bid"), F.min(side("ask")).alias("best_ask"), F.count("*").alias("levels"))
    return out.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)


PATH = "symbol {}, ns long, seq long, best_bid long, best_ask long, bid_lots long, ask_lots long, levels long"


def path(levels: DataFrame, *, slot_rows: int = 50_000) -> DataFrame:
    """Best prices, mid (null if a side is empty), lots on each side and number of levels after each event of level updates (symbol, side, tick, ns, seq, lots).

    A maximum from which levels go again can't be a running value. A symbol's events are numbered and cut into slots of
    ``slot_rows``; each slot starts from the levels that live at its border, carried from the slot of their last update up to
    that of their next, and is swept with heaps of its live prices. So a task gets one slot and its live levels, whatever a
    symbol's share of the rows. An event may update several levels (each once), and its row tells what all of them leave.
    Null lots: no update. Rows of a null symbol, side or tick are left out. Empty table: empty result.
    """
    day, keys = chunk_of("ns", 24 * 3_600_000_000_000), ["symbol", "side", "tick"]
    sound = levels.where("symbol IS NOT NULL AND side IN ('bid', 'ask') AND tick IS NOT NULL AND lots IS NOT NULL").select(*keys, "ns", "seq", F.col("lots").cast("long").alias("lots"))
    events = sound.groupBy("symbol", "ns", "seq").agg(F.collect_list(F.struct("side", "tick", "lots")).alias("l"))
    slots = numbered(events, ["symbol"], day, ["ns", "seq"], "_n").withColumn("_slot", F.floor((F.col("_n") - 1) / slot_rows))
    own = slots.select("symbol", "_slot", F.lit(True).alias("_own"), "ns", "seq", F.inline("l"))
    last = own.groupBy(*keys, "_slot").agg(F.max_by("lots", F.struct("ns", "seq")).alias("lots"))
    ends = slots.groupBy("symbol").agg(F.max("_slot").alias("_end"))
    until = F.coalesce(F.lead("_slot").over(Window.partitionBy(*keys).orderBy("_slot")), F.col("_end"))
    lives = last.join(ends, "symbol").withColumn("_until", until).where("lots > 0 AND _until > _slot")
    carried = lives.select("symbol", F.explode(F.sequence(F.col("_slot") + 1, F.col("_until"))).alias("_slot"), F.lit(False).alias("_own"), F.lit(None).cast("long").alias("ns"), F.lit(None).cast("long").alias("seq"), "side", "tick", "lots")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PATH.split(", ")]
        slot, at, now = None, None, Book()

        def row() -> tuple:
            return slot[0], *at, now.best("bid"), now.best("ask"), now.totals["bid"], now.totals["ask"], len(now.lots)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"best_bid": "Int64", "best_ask": "Int64"})

        for batch in batches:
            out = []
            for symbol, number, mine, ns, seq, side, tick, lots in batch.itertuples(index=False):
                here = (symbol, number)
                if at is not None and (here != slot or (ns, seq) != at):
                    out.append(row())
                    at = None
                if here != slot:
                    slot, now = here, Book()
                now.put(side, int(tick), int(lots))
                if mine:
                    at = (int(ns), int(seq))
            yield frame(out)
        if at is not None:
            yield frame([row()])

    kind = levels.schema["symbol"].dataType.simpleString()
    dealt = own.unionByName(carried).select("symbol", "_slot", "_own", "ns", "seq", "side", "tick", "lots").repartition("symbol", "_slot").sortWithinPartitions("symbol", "_slot", "_own", "ns", "seq")
    return dealt.mapInPandas(sweep, PATH.format(kind)).withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)


def invariants(levels: DataFrame) -> DataFrame:
    """Best prices of each symbol's levels (symbol, side, tick, lots) and what no book may be: crossed or locked, with ticks or lots that aren't positive."""
    side = lambda s: F.when(F.col("side") == s, F.col("tick"))
    out = levels.groupBy("symbol").agg(F.max(side("bid")).alias("bid"), F.min(side("ask")).alias("ask"), F.count_if(F.col("tick") <= 0).alias("bad_ticks"), F.count_if(F.col("lots") <= 0).alias("bad_lots"))
    out = out.withColumn("crossed", F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False)))
    return out.withColumn("valid", (F.col("bad_ticks") == 0) & (F.col("bad_lots") == 0) & ~F.col("crossed"))


def uncrossed(best_bid: Column, best_ask: Column) -> Column:
    """Whether a bid and an ask can stand in one book: the bid is lower, or one of them is missing."""
    return F.coalesce(best_bid < best_ask, F.lit(True))


def order_depth(orders: DataFrame) -> DataFrame:
    """Levels of resting orders (symbol, side, tick, ns, seq, lots): lots, number of orders, and the one that is first in the queue."""
    return orders.groupBy("symbol", "side", "tick").agg(F.sum("lots").alias("lots"), F.count("*").alias("orders"), F.min_by("seq", F.struct("ns", "seq")).alias("first_order"))


def top_levels(book_levels: DataFrame, n: int) -> DataFrame:
    """The ``n`` best levels of each side, with their rank: bids from the highest, asks from the lowest."""
    way = F.when(F.col("side") == "bid", -F.col("tick")).otherwise(F.col("tick"))
    return book_levels.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(way)).cast("long")).where(F.col("rank") <= n)


def queue_ahead(orders: DataFrame) -> DataFrame:
    """Adds ``ahead``: lots that rest before the order at its (symbol, side, tick), by (ns, seq)."""
    return running(orders, ["symbol", "side", "tick"], chunk_of("ns", 24 * 3_600_000_000_000), ["ns", "seq"], {"ahead": ("sum", F.col("lots"))}, before=True)


def queue_fills(orders: DataFrame, consumption: DataFrame) -> DataFrame:
    """Lots of each resting order that its level's consumption takes, first come first served: ``ahead`` at arrival and ``filled``.

    ``orders`` and ``consumption``: symbol, side, tick, ns, seq, lots. What is consumed from an empty queue is lost.
    The queue is the running sum of arrivals less consumption, reflected at zero by its running minimum;
    what is consumed after an order's arrival takes the queue before it, then the order.
    """
    keys, day, place = ["symbol", "side", "tick"], 24 * 3_600_000_000_000, ["ns", "seq"]
    mark = lambda df, delta, rest: df.select(*keys, *place, delta.alias("delta"), rest.alias("rest"))
    events = mark(orders, F.col("lots"), F.col("lots")).unionByName(mark(consumption, -F.col("lots"), F.lit(None).cast("long")))
    eaten = F.when(F.col("rest").isNull(), -F.col("delta")).otherwise(F.lit(0))
    free = running(events, keys, chunk_of("ns", day), place, {"free": ("sum", F.col("delta")), "before": ("sum", eaten)})
    low = running(free, keys, chunk_of("ns", day), place, {"low": ("min", F.col("free"))}, before=True)
    queue = F.col("free") - F.col("delta") - F.least(F.lit(0), F.coalesce("low", F.lit(0)))
    total = consumption.groupBy(*keys).agg(F.sum("lots").alias("total"))
    met = low.where("rest IS NOT NULL").join(total, keys, "left").select(*keys, "seq", F.col("rest").alias("lots"), queue.alias("ahead"), (F.coalesce("total", F.lit(0)) - F.col("before")).alias("later"))
    return met.select(*keys, "seq", "lots", "ahead", F.greatest(F.lit(0), F.least(F.col("lots"), F.col("later") - F.col("ahead"))).alias("filled"))


def sweep(orders: DataFrame, levels: DataFrame) -> DataFrame:
    """Fills (order, level) of takers against a frozen book: each walks the opposite levels from the best to its limit.

    ``orders``: symbol, order_id, side, limit_tick, lots; ``levels``: symbol, side, tick, lots. Prefix sums
    of the levels stand in for the walk, however many levels it takes. Takers don't see each other. Orders meet levels by the
    number of binary digits of the lots ahead of these, so an order meets only levels within about twice its lots.
    """
    way = F.when(F.col("side") == "bid", -F.col("tick")).otherwise(F.col("tick"))
    up = Window.partitionBy("symbol", "side").orderBy(way)
    ahead = F.coalesce(F.sum("lots").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    digits = lambda c: F.length(F.bin(c))
    opposite = levels.withColumn("ahead", ahead).select("symbol", F.when(F.col("side") == "bid", "ask").otherwise("bid").alias("side"), "tick", F.col("lots").alias("level_lots"), "ahead", digits(F.col("ahead")).alias("reach"))
    in_limit = F.when(F.col("side") == "bid", F.col("tick") <= F.col("limit_tick")).otherwise(F.col("tick") >= F.col("limit_tick"))
    takers = orders.where("lots > 0").withColumn("reach", F.explode(F.sequence(F.lit(1), digits(F.col("lots") - 1))))
    met = takers.join(opposite, ["symbol", "side", "reach"]).where(in_limit & (F.col("ahead") < F.col("lots")))
    return met.select("symbol", "order_id", "side", "tick", F.least("level_lots", F.col("lots") - F.col("ahead")).alias("fill_lots"))


def overlap_candidates(depth: DataFrame, trades: DataFrame, window_ns: int) -> DataFrame:
    """Pairs of a depth reduction and a trade at one (symbol, side, tick) with 0 <= age <= window.

    Times are cut into windows: a reduction meets the trades of its own window and of the one before.
    """
    slot = lambda c: F.floor(F.col(c) / window_ns)
    late = depth.select("symbol", "side", "tick", F.col("ns").alias("depth_ns"), F.col("seq").alias("depth_seq"), F.col("lots").alias("depth_lots"), F.explode(F.array(slot("ns") - 1, slot("ns"))).alias("slot"))
    early = trades.select("symbol", "side", "tick", F.col("ns").alias("trade_ns"), F.col("seq").alias("trade_seq"), F.col("lots").alias("trade_lots"), slot("ns").alias("slot"))
    return late.join(early, ["symbol", "side", "tick", "slot"]).where((F.col("depth_ns") >= F.col("trade_ns")) & (F.col("depth_ns") - F.col("trade_ns") <= window_ns)).drop("slot")


def overlap_netting(signals: DataFrame, window_ns: int, consuming: tuple[str, ...] = ("depth", "trade")) -> DataFrame:
    """Adds netted and modeled lots to signals (symbol, side, tick, ns, seq, source, lots).

    A signal is netted, oldest first, against credits that the other source left at its level within
    the window; what remains is modeled and, if its source is ``consuming``, becomes a credit. Credits
    deplete lot by lot in order, so a level's signals are folded in sequence. A gap longer than the
    window empties all credits: levels are cut there, and each stretch is folded on its own, so a level's
    length bounds no task.
    """
    keys = ["symbol", "side", "tick"]
    gaps = previous(signals, keys, chunk_of("ns", 24 * 3_600_000_000_000), ["ns", "seq"], {"_before": F.col("ns")})
    fresh = F.col("_before").isNull() | (F.col("ns") - F.col("_before") > window_ns)
    cut = running(gaps, keys, chunk_of("ns", 24 * 3_600_000_000_000), ["ns", "seq"], {"_stretch": ("sum", fresh.cast("long"))}).drop("_before")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, credits = None, []
        for rows in batches:
            netted = []
            for *at, ns, source, lots in rows[[*keys, "_stretch", "ns", "source", "lots"]].itertuples(index=False):
                if at != key:
                    key, credits = at, []
                credits = [c for c in credits if c[2] and ns - c[0] <= window_ns]
                rest = lots
                for credit in credits:
                    if credit[1] != source:
                        used = min(rest, credit[2])
                        credit[2] -= used
                        rest -= used
                if rest and source in consuming:
                    credits.append([ns, source, rest])
                netted.append(lots - rest)
            yield rows.drop(columns="_stretch").assign(netted=netted, modeled=rows["lots"] - pd.Series(netted, index=rows.index, dtype="int64"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema) + ", netted long, modeled long"
    return cut.repartition(*[F.col(c) for c in (*keys, "_stretch")]).sortWithinPartitions(*keys, "_stretch", "ns", "seq").mapInPandas(fold, schema)


def bridges(snapshots: DataFrame, depth: DataFrame) -> DataFrame:
    """First depth update of each snapshot whose ids straddle it: first_id <= snapshot_id <= last_id, in the snapshot's epoch."""
    met = snapshots.join(depth, ["symbol", "epoch"]).where((F.col("first_id") <= F.col("snapshot_id")) & (F.col("snapshot_id") <= F.col("last_id")))
    return met.groupBy("symbol", "epoch", "snapshot_id").agg(F.min(F.struct("ns", "seq", "first_id", "last_id")).alias("b")).select("symbol", "epoch", "snapshot_id", F.col("b.seq").alias("bridge_seq"), F.col("b.first_id").alias("first_id"), F.col("b.last_id").alias("last_id"))


def order_ranks(orders: DataFrame) -> DataFrame:
    """Adds ``rank`` within (symbol, side): asks by price, time and id, bids by all three reversed (symbol, side, tick, ns, seq).

    Ranks run over chunks of prices, so that a side isn't ordered in one task.
    """
    sign = F.when(F.col("side") == "bid", -1).otherwise(1)
    rows = orders.withColumns({f"_tm_{c}": sign * F.col(c) for c in ("tick", "ns", "seq")})
    return numbered(rows, ["symbol", "side"], F.col("_tm_tick"), ["_tm_tick", "_tm_ns", "_tm_seq"], "rank").drop("_tm_tick", "_tm_ns", "_tm_seq")


def self_crosses(orders: DataFrame, slot_rows: int = 50_000) -> DataFrame:
    """Adds ``crosses``: an earlier order of the other side that still rests would trade with this one (symbol, ns, seq, side, tick, end_ns).

    The own orders make a book: each adds one to its level when it arrives and takes it back when it ends (before what arrives at
    that time; never, without an end), and an arrival crosses if the best price of the other side is as good as its own. So no
    order is copied over the time it rests, and no pairs are formed; see :func:`path` for the slots. Orders that end when
    they arrive never rest. Null symbol, side, tick or ns: never crosses.
    """
    first = -(1 << 62)  # ends sort before arrivals of their time
    sound = orders.where("symbol IS NOT NULL AND side IN ('bid', 'ask') AND tick IS NOT NULL AND ns IS NOT NULL").select("symbol", "side", "tick", "ns", "seq", "end_ns")
    rests = F.col("end_ns").isNull() | (F.col("end_ns") > F.col("ns"))
    begun = sound.select("symbol", "side", "tick", "ns", "seq", F.when(rests, 1).otherwise(0).cast("long").alias("_tm_n"))
    ended = sound.where("end_ns > ns").select("symbol", "side", "tick", F.col("end_ns").alias("ns"), (F.col("seq") + first).alias("seq"), F.lit(-1).cast("long").alias("_tm_n"))
    counted = running(begun.unionByName(ended), ["symbol", "side", "tick"], chunk_of("ns", 24 * 3_600_000_000_000), ["ns", "seq"], {"lots": ("sum", F.col("_tm_n"))})
    best = path(counted.select("symbol", "side", "tick", "ns", "seq", "lots"), slot_rows=slot_rows).select("symbol", "ns", "seq", "best_bid", "best_ask")
    hit = F.when(F.col("side") == "bid", F.col("tick") >= F.col("best_ask")).when(F.col("side") == "ask", F.col("tick") <= F.col("best_bid"))
    return orders.join(best, ["symbol", "ns", "seq"], "left").select(*orders.columns, F.coalesce(hit, F.lit(False)).alias("crosses"))


# fixed values: which sources consume queues under each set of assumptions, and whether they are netted
PROFILES = {"conservative": (("trade",), True), "base": (("depth", "trade"), True), "aggressive": (("depth", "trade"), False)}


def profile_consumption(signals: DataFrame, window_ns: int) -> DataFrame:
    """(profile, source, observed, consumed): lots of the signals that each profile lets queues lose."""
    runs = []
    for name, (sources, netted) in PROFILES.items():
        modeled = overlap_netting(signals, window_ns, sources) if netted else signals.withColumn("modeled", F.col("lots"))
        consumed = F.when(F.col("source").isin(*sources), F.col("modeled")).otherwise(0)
        sums = modeled.groupBy("source").agg(F.sum("lots").alias("observed"), F.sum(consumed).alias("consumed"))
        runs.append(sums.select(F.lit(name).alias("profile"), "source", "observed", "consumed"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def queue_lives(events: DataFrame) -> DataFrame:
    """Decides on each event of single-price queues: accepted, reason, fills (order_id, lots) and unused lots of consumption.

    ``events``: symbol, side, tick, ns, seq, action (place, cancel, consume, invalidate), order_id, ahead, lots. An order waits for
    the ``ahead`` lots before it, first come first served; cancels and invalidations take orders out without filling them. Other actions
    and nulls in what an action needs are refused. A level is cut at its invalidations and each stretch is folded in order of (ns, seq),
    with its live orders as state: a stretch is one task, its rows are streamed.
    """
    keys, day, place = ["symbol", "side", "tick"], chunk_of("ns", 24 * 3_600_000_000_000), ["ns", "seq"]
    sound = (F.col("action") == "place") & (F.col("order_id") > 0) & (F.col("ahead") >= 0) & (F.col("lots") > 0)
    known = running(events, [*keys, "order_id"], day, place, {"_known": ("sum", F.coalesce(sound, F.lit(False)).cast("long"))}, before=True)
    cut = running(known, keys, day, place, {"_stretch": ("sum", F.coalesce(F.col("action") == "invalidate", F.lit(False)).cast("long"))})
    wanted = ["_stretch", "action", "order_id", "ahead", "lots", "_known"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, queue = None, {}
        for rows in batches:
            told = []
            for *at, action, order, ahead, lots, seen in rows[[*keys, *wanted]].astype(object).where(rows[[*keys, *wanted]].notna(), None).itertuples(index=False):
                if at != key:
                    key, queue = at, {}
                told.append(_decide(queue, action, order, ahead, lots, bool(seen)))
            out = rows.drop(columns=["_stretch", "_known"])
            for i, name in enumerate(("accepted", "reason", "filled", "unused")):
                out[name] = pd.Series([t[i] for t in told], index=rows.index, dtype=object)
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    schema += ", accepted boolean, reason string, filled array<struct<order_id: bigint, lots: bigint>>, unused bigint"
    return cut.repartition(*[F.col(c) for c in (*keys, "_stretch")]).sortWithinPartitions(*keys, "_stretch", *place).mapInPandas(fold, schema)


def _decide(queue: dict[int, list[int]], action: str | None, order: int | None, ahead: int | None, lots: int | None, seen: bool) -> tuple:
    """One event against the live orders of a queue, id -> [lots ahead, lots left] in order of arrival, which it changes."""
    refused = lambda reason: (False, reason, [], 0)
    if action == "place":
        if order is None or order <= 0:
            return refused("invalid_order_id")
        if seen:
            return refused("duplicate_order_id")
        if ahead is None or ahead < 0:
            return refused("invalid_queue_ahead")
        if lots is None or lots <= 0:
            return refused("invalid_quantity")
        queue[int(order)] = [int(ahead), int(lots)]
        return True, None, [], 0
    if action == "cancel":
        if not seen:
            return refused("unknown_order")
        return (True, None, [], 0) if queue.pop(int(order), None) else refused("order_not_live")
    if action == "invalidate":
        return True, None, [], 0
    if action != "consume":
        return refused("unknown_action")
    if lots is None or lots <= 0:
        return refused("invalid_consumption")
    fills, rest = [], int(lots)
    for order_id in list(queue):
        waits, left = queue[order_id]
        passed = min(rest, waits)
        taken = min(rest - passed, left)
        rest -= passed + taken
        queue[order_id] = [waits - passed, left - taken]
        if taken:
            fills.append({"order_id": order_id, "lots": taken})
        if left == taken:
            del queue[order_id]
        if not rest:
            break
    return True, None, fills, rest
