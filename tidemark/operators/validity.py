"""Validity of captures and of their routes: receipts, epochs, failures, recoveries and what they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

# fixed values: events that end a route, events that end a capture, events that open a route
STOPS = ("disconnect", "connect_failure", "parse_failure", "overflow")
ABORTS = ("parse_failure", "overflow", "writer_failure", "capture_abort")
OPENS = ("connect", "reconnect")

BLOCK = 100_000


def _boundary(when: Column, kind: str, scope: str, reason: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), reason.alias("reason")))


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def routes(rows: DataFrame, *, trades_required: bool = True, initially: bool = False) -> DataFrame:
    """Adds the validity of capture, clock, depth and trade route after each row, and the row's boundaries.

    ``rows``: path (the capture), source_row_seq (its order), symbol, route (public or market), kind, event, recv_seq,
    recv_monotonic_ns, stream_epoch, sync_epoch, snapshot_accepted. A capture never recovers: a row without receipt, a gap or
    regression of the sequence, or an abort ends it, a regression of the clock ends the clock. A route starts as ``initially``
    (false from version 3 on), ends with a failure, a new epoch or a rejected snapshot, and opens with a connection or with the
    first data before any epoch. Rows of no symbol (null, empty, ``*``) have no routes. ``boundaries``: array of (kind, scope, reason).

    All state is a running maximum or a last value over blocks of rows, so no task holds a capture or a symbol.
    """
    block, order = F.floor(F.col("source_row_seq") / BLOCK).cast("long"), ["source_row_seq"]
    whole = _is(F.col("recv_seq").isNotNull() & F.col("recv_monotonic_ns").isNotNull() & (F.col("route") != ""))
    seen = {"_tm_seq": ("max", F.when(whole, F.col("recv_seq"))), "_tm_clock": ("max", F.when(whole, F.col("recv_monotonic_ns")))}
    received = running(rows, ["path"], block, order, seen, before=True)
    repeats, skips = whole & (F.col("recv_seq") <= F.col("_tm_seq")), whole & (F.col("recv_seq") > F.col("_tm_seq") + 1)
    faults = {
        "_tm_lost": ~whole, "_tm_repeats": _is(repeats), "_tm_skips": _is(skips),
        "_tm_back": _is(whole & (F.col("recv_monotonic_ns") < F.col("_tm_clock"))), "_tm_abort": _is(F.col("event").isin(*ABORTS)),
    }
    told = received.withColumns(faults)
    broken = F.col("_tm_lost") | F.col("_tm_repeats") | F.col("_tm_skips") | F.col("_tm_abort")
    ended = {"_tm_ended": ("max", broken.cast("int")), "_tm_late": ("max", F.col("_tm_back").cast("int"))}
    captured = running(told, ["path"], block, order, ended)

    public, market = _is(F.col("route") == "public"), _is(F.col("route") == "market")
    epochs = {
        "_tm_public": ("last", F.when(public, F.col("stream_epoch"))), "_tm_market": ("last", F.when(market, F.col("stream_epoch"))),
        "_tm_sync": ("last", F.when(public, F.col("sync_epoch"))),
    }
    known = running(captured, ["path", "symbol"], block, order, epochs, before=True)
    stops, opens = _is(F.col("event").isin(*STOPS)), _is(F.col("event").isin(*OPENS))
    rejected = _is((F.col("kind") == "snapshot") & ~F.col("snapshot_accepted"))
    depth_data, trade_data = _is(F.col("kind").isin("depthUpdate", "snapshot")) & ~rejected, _is(F.col("kind") == "aggTrade")
    new_public, new_market = _is(public & (F.col("stream_epoch") != F.col("_tm_public"))), _is(market & (F.col("stream_epoch") != F.col("_tm_market")))
    new_sync = _is(public & (F.col("sync_epoch") != F.col("_tm_sync")))

    def turn(route: Column, data: Column, epoch: str, changed: Column) -> Column:
        """What the row makes of its route; null if nothing."""
        return (
            F.when(route & stops, False).when(route & opens, True)
            .when(data, F.when(F.col(epoch).isNull(), True)).when(changed, False)
        )

    depth_turn = F.when(rejected, False).otherwise(turn(public, depth_data, "_tm_public", new_public | new_sync))
    turned = known.withColumns({
        "_tm_depth_turn": depth_turn, "_tm_trade_turn": turn(market, trade_data, "_tm_market", new_market),
        "_tm_new_public": new_public, "_tm_new_market": new_market, "_tm_new_sync": new_sync,
    })
    states = {"_tm_depth": ("last", F.col("_tm_depth_turn")), "_tm_trade": ("last", F.col("_tm_trade_turn"))}
    held = running(turned, ["path", "symbol"], block, order, states, before=True)

    named = _is(~F.col("symbol").cast("string").isin("", "*"))
    was = {k: F.coalesce(f"_tm_{k}", F.lit(initially)) for k in ("depth", "trade")}
    after = {k: F.when(named, F.coalesce(f"_tm_{k}_turn", was[k])) for k in was}
    fresh = {"depth": F.col("_tm_new_public") | F.col("_tm_new_sync"), "trade": F.col("_tm_new_market")}
    back = {k: F.coalesce(F.col(f"_tm_{k}_turn"), F.lit(False)) & named for k in was}
    boundaries = F.array_compact(F.array(
        _boundary(F.col("_tm_lost"), "invalidated", "capture", F.lit("missing_capture_metadata")),
        _boundary(F.col("_tm_repeats"), "invalidated", "capture", F.lit("non_increasing_receive_sequence")),
        _boundary(F.col("_tm_skips"), "invalidated", "capture", F.lit("receive_sequence_gap")),
        _boundary(F.col("_tm_back"), "invalidated", "clock", F.lit("receive_monotonic_regression")),
        _boundary(F.col("_tm_abort"), "invalidated", "capture", F.col("event")),
        _boundary(named & F.col("_tm_new_public"), "invalidated", "stream", F.lit("public_stream_epoch_changed")),
        _boundary(named & F.col("_tm_new_sync"), "invalidated", "sync", F.lit("capture_sync_epoch_changed")),
        _boundary(named & F.col("_tm_new_market"), "invalidated", "stream", F.lit("market_stream_epoch_changed")),
        _boundary(named & (public | market) & stops, "invalidated", "stream", F.concat("route", F.lit("_stream_"), "event")),
        _boundary(public & opens & back["depth"] & (~was["depth"] | fresh["depth"]), "recovered", "stream", F.lit("public_connected")),
        _boundary(market & opens & back["trade"] & (~was["trade"] | fresh["trade"]), "recovered", "stream", F.lit("market_connected")),
        _boundary(named & rejected, "invalidated", "book", F.lit("snapshot_rejected")),
        _boundary(depth_data & back["depth"] & ~opens & ~was["depth"], "recovered", "stream", F.lit("public_observed")),
        _boundary(trade_data & back["trade"] & ~opens & ~was["trade"], "recovered", "stream", F.lit("market_observed")),
    ))
    capture, clock = F.col("_tm_ended") == 0, F.col("_tm_late") == 0
    execution = capture & clock & after["depth"] & (after["trade"] if trades_required else F.lit(True))
    return held.select(
        *rows.columns, capture.alias("capture_valid"), clock.alias("clock_valid"), after["depth"].alias("depth_valid"), after["trade"].alias("trade_valid"),
        execution.alias("execution_valid"), boundaries.alias("boundaries"),
    )


def verdict(routed: DataFrame) -> DataFrame:
    """One row a capture: its state at the end, its boundaries, and whether claims may rest on it (``claim_ready``).

    Ready: a trailer, a valid capture and clock, all symbols able to execute at their last row, and no boundary that invalidates.
    """
    invalid = F.size(F.filter("boundaries", lambda b: b["kind"] == "invalidated"))
    last = routed.groupBy("path", "symbol").agg(
        F.bool_and("capture_valid").alias("capture_valid"), F.bool_and("clock_valid").alias("clock_valid"), F.max_by("execution_valid", "source_row_seq").alias("able"),
        F.sum(F.size("boundaries")).alias("boundaries"), F.sum(invalid).alias("invalidated"), F.bool_or(F.coalesce(F.col("event") == "capture_trailer", F.lit(False))).alias("trailer"),
    )
    out = last.groupBy("path").agg(
        F.bool_and("capture_valid").alias("capture_valid"), F.bool_and("clock_valid").alias("clock_valid"), F.count_if("able").alias("able"),
        F.count("able").alias("symbols"), F.sum("boundaries").alias("boundaries"), F.sum("invalidated").alias("invalidated"), F.bool_or("trailer").alias("trailer"),
    )
    sound = F.col("capture_valid") & F.col("clock_valid") & F.col("trailer") & (F.col("invalidated") == 0)
    return out.withColumn("claim_ready", sound & (F.col("symbols") > 0) & (F.col("able") == F.col("symbols")))
