"""Audit of traces: rule columns, evidence, merges, ordered digests, provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunk_of, numbered, previous, running


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken ones in ``reasons``; a null outcome breaks it."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def unresolved(evidence: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Evidence whose id is not in the input."""
    return evidence.join(known.select(key), key, "left_anti")


def reconcile(live: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """What to do about each key: new, replace, keep or cancel."""
    a, b = live.select(*keys, F.col(value).alias("_live")), wanted.select(*keys, F.col(value).alias("_want"))
    action = F.when(F.col("_want").isNull(), "cancel").when(F.col("_live").isNull(), "new").when(F.col("_live") != F.col("_want"), "replace").otherwise("keep")
    return a.join(b, list(keys), "full_outer").select(*keys, action.alias("action"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lock-step comparison of two traces by row number within the symbol; extras of either side have nulls."""
    a, b = (numbered(df, ["symbol"], chunk_of("ns"), ["ns", "seq"], "n").select("symbol", "n", F.col("seq").alias(name)) for df, name in ((left, "left_seq"), (right, "right_seq")))
    return a.join(b, ["symbol", "n"], "full_outer")


def _streamed(df: DataFrame, by: Sequence[str], order: Sequence[str], row: Column, start: Callable[[], Any], step: Callable[[Any, str | None], Any], end: Callable[[Any], str | None]) -> DataFrame:
    """(by, n, digest): each key's rows in order pass through one state, so a task holds a batch of rows and a state, however long a key is.

    A key's rows still go to one task, one after the other: what a digest in order is.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    placed = df.select(*by, *[F.col(c).alias(f"_tm_{i}") for i, c in enumerate(order)], row.cast("string").alias("_tm_row"))
    dealt = placed.repartition(*by).sortWithinPartitions(*by, *[f"_tm_{i}" for i in range(len(order))]).select(*by, "_tm_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0

        def told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in rows], f.type) for i, f in enumerate(schema) if f.name != "_tm_row"]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=[*by, "n", "digest"])

        schema = None
        for batch in batches:
            out, schema = [], batch.schema
            for *own, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key:
                    if key is not None:
                        out.append((key, n, end(state)))
                    key, state, n = own, start(), 0
                state, n = step(state, text), n + 1
            if out:
                yield told(out, schema)
        if key is not None:
            yield told([(key, n, end(state))], schema)

    return dealt.mapInArrow(run, f"{kinds}, n long, digest string")


def hash_chain(df: DataFrame, by: Sequence[str], order: Sequence[str], row: Column, domain: str) -> DataFrame:
    """Ordered digest of each key: h = sha256(h, newline, row), from sha256(domain); null if a row is. Each link hashes the one before."""
    first = hashlib.sha256(domain.encode()).hexdigest()
    link = lambda h, text: None if h is None or text is None else hashlib.sha256(f"{h}\n{text}".encode()).hexdigest()
    return _streamed(df, by, order, row, lambda: first, link, lambda h: h)


def joined_hash(df: DataFrame, by: Sequence[str], order: Sequence[str], row: Column, *, before: str = "", between: str = "", after: str = "") -> DataFrame:
    """SHA-256 of each key's rows in order, as one text with what stands before, between and after them, which is never built; null rows are left out."""

    def step(state: tuple[Any, bool], text: str | None) -> tuple[Any, bool]:
        whole, begun = state
        if text is None:
            return state
        whole.update(((between if begun else "") + text).encode())
        return whole, True

    def end(state: tuple[Any, bool]) -> str:
        state[0].update(after.encode())
        return state[0].hexdigest()

    return _streamed(df, by, order, row, lambda: (hashlib.sha256(before.encode()), False), step, end)


def list_hash(df: DataFrame, by: Sequence[str], order: Sequence[str], row: Column) -> DataFrame:
    """SHA-256 of each key's rows as one ordered JSON list."""
    return joined_hash(df, by, order, row, before="[", between=",", after="]")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have each column, and whether all have all."""
    counts = [F.count(c).alias(c) for c in columns]
    complete = F.lit(True)
    for c in columns:
        complete = complete & (F.count(c) == F.count("*"))
    return df.agg(F.count("*").alias("rows"), *counts, complete.alias("complete"))


def deterministic(digests: DataFrame) -> DataFrame:
    """Whether all runs of a name have one digest."""
    return digests.groupBy("name").agg(F.count("*").alias("runs"), (F.countDistinct("digest") == 1).alias("deterministic"))


def claims(summary: DataFrame) -> DataFrame:
    """Adds execution_valid and claim_ready of a validity summary (book, clock, capture, trade, trade_required, streams, invalidations)."""
    valid = F.col("book") & F.col("clock") & F.col("capture") & (F.col("trade") | ~F.col("trade_required"))
    return summary.withColumn("execution_valid", valid).withColumn("claim_ready", F.col("execution_valid") & (F.col("streams") > 0) & (F.col("invalidations") == 0))


# -- rules of fills and markouts: names and outcomes for :func:`violations`

#: Where a fill can come from, how a markout can end, what an order can be when it fills.
FILL_SOURCES, MARKOUT_STATUSES, FILL_STATES = ("depth_update", "agg_trade", "taker_order"), ("resolved", "invalidated"), ("live", "pending_cancel")
#: Fields of a passive fill's and of a taker's path through the queue.
PASSIVE_PATH, TAKER_PATH = ("queue_ahead_before_trigger_lots", "queue_consumed_before_fill_lots", "queue_ahead_at_fill_lots"), ("visible_level_before_lots", "fill_lots", "visible_level_after_lots")


def _positive(name: str) -> Column:
    return F.col(name).try_cast("decimal(38,18)") > 0


def fill_rules(schema_version: int = 1, fee_model: str = "static_config_bps") -> dict[str, Column]:
    """Rules of a fill (fill_source, side, order_id, price, qty, notional, contract_multiplier, fee_bps, fee as decimal strings, provenance_schema_version, scenario_id,
    expected_scenario_id, evidence_ids, validity struct, queue_trajectory map, latency_draws_ms map, latency_model struct, order_state_at_fill, fee_model_id)."""
    v, path, draws, model = (F.col(c) for c in ("validity", "queue_trajectory", "latency_draws_ms", "latency_model"))
    taker = F.col("fill_source") == "taker_order"
    lots = lambda k: F.element_at(path, F.lit(k))
    keys = lambda m, names: F.array_sort(F.map_keys(m)) == F.array_sort(F.array(*[F.lit(n) for n in names]))
    passes = v["book_valid"] & v["clock_valid"] & v["capture_valid"] & (v["trade_stream_valid"] | ~v["trade_stream_required"])
    before, at = lots(PASSIVE_PATH[0]), lots(PASSIVE_PATH[2])
    rules = {
        "fill_source": F.col("fill_source").isin(*FILL_SOURCES),
        "side": F.col("side").isin("bid", "ask"),
        "order_id": F.col("order_id") != "",
        **{c: _positive(c) for c in ("price", "qty", "notional", "contract_multiplier")},
        **{c: F.col(c).try_cast("decimal(38,18)").isNotNull() for c in ("fee_bps", "fee")},
        "provenance_schema_version": F.col("provenance_schema_version") == schema_version,
        "scenario_id": F.col("scenario_id") == F.col("expected_scenario_id"),
        "evidence_ids": (F.size("evidence_ids") > 0) & F.forall("evidence_ids", lambda e: F.coalesce(e != "", F.lit(False))) & (F.size(F.array_distinct("evidence_ids")) == F.size("evidence_ids")),
        "validity": F.coalesce(v["execution_valid"] == passes, F.lit(False)),
        "validity_reason": v["reason"].isNull() | (v["reason"] != ""),
        "trade_stream_required": (F.col("fill_source") != "agg_trade") | v["trade_stream_required"],
        "queue_fields": F.when(taker, keys(path, TAKER_PATH)).otherwise(keys(path, PASSIVE_PATH)),
        "queue_values": F.forall(F.map_values(path), lambda x: F.coalesce(x >= 0, F.lit(False))),
        "queue_path": F.when(taker, lots(TAKER_PATH[2]) == lots(TAKER_PATH[0]) - lots(TAKER_PATH[1])).otherwise((at <= before) & (lots(PASSIVE_PATH[1]) == before - at)),
        "latency_draws": keys(draws, ("new_order", "cancel")) & F.forall(F.map_values(draws), lambda x: x.isNull() | ((x >= 0) & (x < float("inf")))),
        "latency_model": (model["mode"] != "") & model["seed"].isNotNull() & (model["source"] == "configured_scenario") & ~model["measured"],
        "order_state": F.col("order_state_at_fill").isin(*FILL_STATES),
        "fee_model": F.col("fee_model_id") == fee_model,
    }
    return rules


#: What a row of queue consumption counts.
CONSUMPTION = ("observed_lots", "modeled_lots", "overlap_netted_lots", "queue_consumed_lots", "unmatched_lots")


def consumption_rules(sources: Sequence[str] = ("depth_update", "agg_trade")) -> dict[str, Column]:
    """Rules of a row of queue consumption (source and CONSUMPTION): a known source, whole lots from 0, and lots that add up from what is observed to what no queue takes."""
    observed, modeled, netted, consumed, unmatched = (F.col(c) for c in CONSUMPTION)
    return {
        "source": F.col("source").isin(*sources),
        **{c: F.col(c) >= 0 for c in CONSUMPTION},
        "models_more_than_observed": modeled <= observed,
        "netted": netted == observed - modeled,
        "consumes_more_than_modeled": consumed <= modeled,
        "unmatched": unmatched == modeled - consumed,
    }


def markout_rules() -> dict[str, Column]:
    """Rules of a markout (fill_source, side, fill_price, qty, status, mid_after, markout, adverse, resolution_lag_seconds, invalid_reason): outcomes only where resolved, and in accord."""
    status, reason = F.col("status"), F.col("invalid_reason")
    resolved, invalidated = status == "resolved", status == "invalidated"
    number = lambda c: F.col(c).try_cast("decimal(38,18)")
    empty = F.lit(True)
    for c in ("mid_after", "markout", "adverse", "resolution_lag_seconds"):
        empty = empty & F.col(c).isNull()
    return {
        "fill_source": F.col("fill_source").isin(*FILL_SOURCES),
        "side": F.col("side").isin("bid", "ask"),
        "fill_price": number("fill_price").isNotNull() & number("qty").isNotNull(),
        "status": status.isin(*MARKOUT_STATUSES),
        "null_outcome": ~invalidated | empty,
        "invalid_reason": F.when(invalidated, F.coalesce(reason != "", F.lit(False))).when(resolved, F.coalesce(reason == "", F.lit(True))).otherwise(True),
        "outcome": ~resolved | (number("markout").isNotNull() & (number("qty") > 0) & F.col("adverse").isNotNull()),
        "adverse": ~resolved | F.coalesce(F.col("adverse") == (number("markout") < 0), F.lit(True)),
    }


def summary_differences(summary: DataFrame, recounted: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, field, told, found) where a summary differs from what its details give, fields by name; a row that one side lacks differs in all of them."""
    fields = [c for c in summary.columns if c not in keys]
    cells = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias(name)) for c in fields])).alias("c")).select(*keys, "c.*")
    both = cells(summary, "told").join(cells(recounted, "found"), [*keys, "field"], "full_outer")
    near = F.abs(F.col("told") - F.col("found")) <= tolerance * F.greatest(F.lit(1.0), F.abs("found"))
    return both.where(~F.coalesce(near, F.col("told").isNull() & F.col("found").isNull()))


def lifecycle(trace: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counters of orders' lives, recounted from a trace (event_type, resting, ahead, immediate, remaining, prevented).

    ``ahead`` counts for arrivals that rest; one that is missing or below zero is a ``bad_queue``.
    """
    is_ = lambda name: F.col("event_type") == name
    arrived = is_("order_arrival")
    rested = arrived & F.col("resting")
    queued = F.when(rested & (F.col("ahead") >= 0), F.col("ahead"))
    counts = {
        "arrival_scheduled": is_("order_arrival_scheduled"), "arrived": arrived, "rested_after_arrival": rested,
        "immediate_fill_arrivals": arrived & (F.col("immediate") > 0), "expired_unfilled_arrivals": arrived & ~F.col("resting") & (F.col("remaining") > 0),
        "self_trade_prevented": arrived & F.col("prevented"), "cancel_requested": is_("cancel_requested"), "cancel_acknowledged": is_("cancel_ack"),
        "fills": is_("fill"), "markouts": is_("markout"), "queue_samples": queued.isNotNull(), "with_queue": queued > 0, "bad_queues": rested & queued.isNull(),
    }
    sums = [F.coalesce(F.sum(queued), F.lit(0)).alias("queue_sum"), F.coalesce(F.max(queued), F.lit(0)).alias("queue_max")]
    return trace.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in counts.items()], *sums)


#: Kinds of rows in a trace of orders.
TRACE_KINDS = ("place", "queue", "fill", "cancel", "markout")


def trace_faults(trace: DataFrame, horizons_ns: Sequence[int], *, chunk: int = 100_000) -> DataFrame:
    """Rows of a merged trace that contradict the rows before them, with ``reasons``.

    ``trace``: seq (of the whole trace, contiguous), kind (TRACE_KINDS), symbol, order_id, ns, lots (ordered, filled), ahead_before,
    ahead_after, left_after, fill_seq and horizon_ns (markouts). One pass in order of seq, with each order's state carried over chunks:

    - ``sequence``: seq doesn't follow the row before; ``clock``: ns runs back; ``unknown_kind``.
    - ``unplaced``: before the order's placing; ``placed_twice``; ``after_end``: the order was filled or cancelled before.
    - ``queue_path``: ahead_before isn't what the order's last row left; ``queue_grows``: ahead_after is above ahead_before or below 0.
    - ``fill_in_queue``: a fill while lots are ahead; ``left``: left_after isn't what was left less what is filled, or below 0.
    - ``unknown_fill``: a markout of a fill that isn't before it; ``horizon``: not one of those to be measured, or before it is due; ``markout_twice``.

    Rows of one seq are taken in order of ns, order_id and kind, so that reruns agree. Null in what a rule needs breaks it. An order's rows, and a fill's markouts, meet by chunk of seq, so no task gets all rows of one symbol or order.
    """
    place, kind = F.floor(F.col("seq") / chunk), lambda *names: F.col("kind").isin(*names)
    end = kind("cancel") | (kind("fill") & (F.col("left_after") == 0))
    own, order = ["order_id"], ["seq", "ns", "order_id", "kind"]
    rows = previous(trace.where("seq IS NOT NULL"), [], place, order, {"_tm_seq": F.col("seq"), "_tm_ns": F.col("ns")})
    of_order = kind("place", "queue", "fill", "cancel")
    state = {"_tm_placed": ("sum", kind("place").cast("long")), "_tm_ended": ("sum", F.coalesce(end, F.lit(False)).cast("long")), "_tm_ahead": ("last", F.when(of_order, F.col("ahead_after"))), "_tm_left": ("last", F.when(kind("place", "fill"), F.col("left_after")))}
    rows = running(rows, own, place, order, state, before=True)
    known = trace.where(kind("fill")).select(F.col("seq").alias("_tm_fill"), F.col("ns").alias("_tm_fill_ns"), F.col("order_id").alias("_tm_of")).distinct()
    asked = F.coalesce(F.when(kind("markout"), F.col("fill_seq")), -1 - F.col("seq"))  # rows that ask for no fill don't meet under one null key
    rows = rows.join(known, asked == F.col("_tm_fill"), "left")
    told = running(rows.where(kind("markout")).select("seq", "fill_seq", "horizon_ns"), ["fill_seq", "horizon_ns"], place, ["seq"], {"_tm_told": ("sum", F.lit(1).cast("long"))}, before=True).select(F.col("seq").alias("_tm_at"), "_tm_told")
    rows = rows.join(told, F.col("seq") == F.col("_tm_at"), "left")
    wrong = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = {
        "sequence": F.col("_tm_seq").isNotNull() & wrong(F.col("seq") == F.col("_tm_seq") + 1),
        "clock": F.col("_tm_seq").isNotNull() & wrong(F.col("ns") >= F.col("_tm_ns")),
        "unknown_kind": wrong(kind(*TRACE_KINDS)),
        "unplaced": kind("queue", "fill", "cancel") & (F.col("_tm_placed") == 0),
        "placed_twice": kind("place") & (F.col("_tm_placed") > 0),
        "after_end": of_order & (F.col("_tm_ended") > 0),
        "queue_path": kind("queue", "fill") & (F.col("_tm_placed") > 0) & wrong(F.col("ahead_before") == F.col("_tm_ahead")),
        "queue_grows": kind("queue", "fill") & wrong((F.col("ahead_after") <= F.col("ahead_before")) & (F.col("ahead_after") >= 0)),
        "fill_in_queue": kind("fill") & wrong(F.col("ahead_after") == 0),
        "left": (kind("place") & wrong((F.col("lots") > 0) & (F.col("left_after") == F.col("lots")))) | (kind("fill") & (F.col("_tm_placed") > 0) & wrong((F.col("lots") > 0) & (F.col("left_after") == F.col("_tm_left") - F.col("lots")) & (F.col("left_after") >= 0))),
        "unknown_fill": kind("markout") & wrong((F.col("_tm_fill") < F.col("seq")) & F.col("_tm_of").eqNullSafe(F.col("order_id"))),
        "horizon": kind("markout") & wrong(F.col("horizon_ns").isin(*horizons_ns) & (F.coalesce(F.col("ns") >= F.col("_tm_fill_ns") + F.col("horizon_ns"), F.col("_tm_fill").isNull()))),
        "markout_twice": kind("markout") & (F.coalesce("_tm_told", F.lit(0)) > 0),
    }
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return rows.select(*trace.columns, reasons.alias("reasons")).where(F.size("reasons") > 0)
