"""Exact conversions between prices, quantities, ticks and lots, and other scalar rules of a tape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"


def decimal(c: Column) -> Column:
    """Finite decimal of a numeric string or number; null for anything else."""
    return F.expr("null").cast(EXACT) if c is None else c.try_cast(EXACT)


def to_units(value: Column, unit: Column, how: str = "exact") -> Column:
    """Ticks of a price, or lots of a quantity: exact (null off the grid or below 0), round (half away from 0), floor or ceil.

    Both are taken to 18 decimals, and remainders are exact. Null, a unit that isn't positive, and what doesn't fit: null.
    """
    v, u = value.try_cast(EXACT), unit.try_cast("decimal(36,18)")
    size, over = F.abs(v), F.pmod(F.abs(v), u).cast("decimal(36,18)")
    whole = F.when(size.cast("double") / u.cast("double") < float(2**63 - 2**11), F.call_function("div", size, u))
    negative = v < 0
    units = {
        "exact": F.when(~negative & (over == 0), whole),
        "round": F.when(negative, -1).otherwise(1) * (whole + (over >= u - over).cast("long")),
        "floor": F.when(negative, -(whole + (over > 0).cast("long"))).otherwise(whole),
        "ceil": F.when(negative, -whole).otherwise(whole + (over > 0).cast("long")),
    }
    return F.when(u > 0, units[how]).cast("long")


def from_units(units: Column, unit: Column) -> Column:
    """Price of ticks, or quantity of lots, exact to 18 decimals; null where it doesn't fit."""
    u, n = unit.try_cast(EXACT), units.cast("decimal(19,0)")
    whole = F.floor(u).try_cast("decimal(18,0)")
    part = F.pmod(u, F.lit(1)).try_cast("decimal(18,18)")
    wide = "decimal(37,18)"  # so that the sum has 18 decimals, too
    return F.try_add((n * whole).try_cast(wide), (n * part).try_cast(wide))


def absolute_return(before: Column, now: Column) -> Column:
    """Size of the relative change; null unless the earlier price is above 0."""
    return F.when(before > 0, F.abs(now - before) / before)


def log_return(before: Column, now: Column) -> Column:
    """Logarithm of the ratio of prices; null unless both are above 0."""
    return F.when((before > 0) & (now > 0), F.log(now / before))


def signed_lots(lots: Column, buyer_is_maker: Column) -> Column:
    """A trade takes from the bids when the buyer rests."""
    return F.when(buyer_is_maker, -lots).otherwise(lots)


def imbalance(bid_lots: Column, ask_lots: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 if both are empty."""
    return F.when(bid_lots + ask_lots > 0, (bid_lots - ask_lots) / (bid_lots + ask_lots)).otherwise(0.0)


def fee(price: Column, qty: Column, multiplier: Column, bps: Column) -> Column:
    """Fee on the notional; negative basis points are a rebate."""
    return price * qty * multiplier * bps / 10_000


def spread_capture(side: Column, mid: Column, price: Column, qty: Column) -> Column:
    return F.when(side == "bid", mid - price).otherwise(price - mid) * qty


def regime(spread_ticks: Column, book_imbalance: Column) -> Column:
    """Spread bucket and imbalance bucket, e.g. tight_sell; unknown without a spread."""
    width = F.when(spread_ticks <= 1, "tight").when(spread_ticks <= 3, "normal").otherwise("wide")
    lean = F.when(book_imbalance >= 0.35, "strong_buy").when(book_imbalance <= -0.35, "strong_sell").when(book_imbalance >= 0.15, "buy").when(book_imbalance <= -0.15, "sell").otherwise("balanced")
    return F.when(spread_ticks.isNull(), "unknown").otherwise(F.concat_ws("_", width, lean))


def gate(book_imbalance: Column, trade_imbalance: Column, threshold: float) -> Column:
    """Buy or sell pressure when both imbalances are beyond the threshold on one side, else neutral."""
    return F.when((book_imbalance >= threshold) & (trade_imbalance >= threshold), "buy_pressure").when((book_imbalance <= -threshold) & (trade_imbalance <= -threshold), "sell_pressure").otherwise("neutral")


#: Outcomes of the pressure gate.
GATE_REASONS = ("gate_size_zero", "book_and_trade_buy_pressure_agree", "book_and_trade_sell_pressure_agree", "only_one_signal_strong_or_signals_disagree", "below_threshold")


def gate_details(book_imbalance: Column, trade_imbalance: Column, threshold: float, ticks: Column) -> tuple[Column, Column, Column]:
    """Label (bullish, bearish, neutral), reason and active ticks of a gate of ``ticks`` that acts when both imbalances agree."""
    zero, buy, sell, one, below = GATE_REASONS
    up = (book_imbalance >= threshold) & (trade_imbalance >= threshold)
    down = (book_imbalance <= -threshold) & (trade_imbalance <= -threshold)
    strong = (F.abs(book_imbalance) >= threshold) | (F.abs(trade_imbalance) >= threshold)
    label = F.when(ticks <= 0, "neutral").when(up, "bullish").when(down, "bearish").otherwise("neutral")
    reason = F.when(ticks <= 0, zero).when(up, buy).when(down, sell).when(strong, one).otherwise(below)
    return label, reason, F.when((ticks > 0) & (up | down), ticks).otherwise(0)


def bps_to_ticks(mid: Column, bps: Column, tick_size: Column) -> Column:
    return mid * bps / 10_000 / tick_size


def needs_refresh(layered: Column, quoted_key: Column, target_key: Column, queue_ahead: Column, most_ahead: int) -> Column:
    """Whether a quote that rests (its key isn't null) is to be placed anew: a layered one was made under another key than its target has, or too many lots wait before it."""
    return quoted_key.isNotNull() & (F.coalesce(layered & ~quoted_key.eqNullSafe(target_key), F.lit(False)) | F.coalesce(queue_ahead > most_ahead, F.lit(False)))


def fee_floor_bps(maker_bps: Column, buffer_bps: Column) -> Column:
    """Half spread that pays a maker's fee and a buffer; rebates don't lower it."""
    return F.greatest(F.lit(0.0), maker_bps.cast("double")) + buffer_bps


def ms_to_us(ms: Column) -> Column:
    """Microseconds of a latency in milliseconds, halves to the even one; null unless finite and from 0."""
    ok = (ms >= 0) & (ms < float("inf")) & ~F.isnan(ms.cast("double"))
    return F.when(ok, F.bround(ms.cast("double") * 1000, 0).cast("long"))


def diagnostic_score(capture: Column, markout: Column, adverse_rate: Column, inventory_stdev: Column, max_drawdown: Column, queue_ahead: Column, arrival_queue_ahead: Column) -> Column:
    """Rank of a run for inspection. The weights."""
    return capture + markout - 10.0 * adverse_rate - 0.25 * inventory_stdev - max_drawdown - 0.001 * queue_ahead - 0.0005 * arrival_queue_ahead


def _nearest(ticks: Column) -> Column:
    return F.floor(ticks + 0.5).cast("long")


def quote_ladder(center: Column, half: Column, wide: Column, bid_extra: Column, ask_extra: Column) -> tuple[Column, ...]:
    """Bid and ask ticks near and far: far ones at least a tick behind; all null where a pair would meet or cross."""
    bid, ask = _nearest(center - half - bid_extra), _nearest(center + half + ask_extra)
    far_bid, far_ask = F.least(_nearest(center - wide - bid_extra), bid - 1), F.greatest(_nearest(center + wide + ask_extra), ask + 1)
    fit = (bid < ask) & (far_bid < far_ask)
    return tuple(F.when(fit, c) for c in (bid, ask, far_bid, far_ask))


def layered_quotes(mid_ticks: Column, skew_ticks: Column, volatility: Column, gate_label: Column, gate_ticks: Column, *, inner_bps: float, outer_bps: float, volatility_factor: float) -> tuple[Column, ...]:
    """Inner and outer bid and ask ticks (bid, ask, outer bid, outer ask); the gate moves the side that pressure runs over."""
    scale = 1 + volatility * volatility_factor
    inner = F.greatest(F.lit(1.0), mid_ticks * inner_bps * scale / 10_000)
    outer = F.greatest(inner, mid_ticks * outer_bps * scale / 10_000)
    moved = lambda label: F.when(gate_label == label, gate_ticks).otherwise(0)
    return quote_ladder(mid_ticks - skew_ticks, inner, outer, moved("bearish"), moved("bullish"))


def research_quotes(
    mid_ticks: Column, skew_ticks: Column, volatility: Column, combined_imbalance: Column, gate_label: Column, gate_ticks: Column, *,
    half_bps: float, outer_bps: float, volatility_factor: float, toxicity_factor: float, floor_bps: float,
) -> tuple[Column, ...]:
    """Near and far bid and ask ticks around the reservation price: half a spread for volatility and toxicity, never below the fee floor."""
    half_spread = F.greatest(F.lit(0.0), half_bps * (1 + volatility * volatility_factor) + F.abs(combined_imbalance) * toxicity_factor, F.lit(floor_bps))
    half = F.greatest(F.lit(1.0), mid_ticks * half_spread / 10_000)
    wide = F.greatest(half + 1, mid_ticks * F.greatest(F.lit(outer_bps), half_spread * 2) / 10_000)
    moved = lambda label: F.when(gate_label == label, gate_ticks).otherwise(0)
    return quote_ladder(mid_ticks - skew_ticks, half, wide, moved("bearish"), moved("bullish"))


def baseline_quotes(mid_ticks: Column, inventory: Column, volatility: Column, *, half_spread_bps: float, skew_bps: float, volatility_factor: float) -> tuple[Column, Column]:
    """Bid and ask ticks: half spread scaled by volatility, at least a tick; inventory moves both away from the mid."""
    scale = 1 + volatility * volatility_factor
    half = F.greatest(F.lit(1.0), mid_ticks * F.lit(half_spread_bps) * scale / 10_000)
    skew = inventory * F.lit(skew_bps) / 10_000 * mid_ticks
    return F.floor(mid_ticks - half - skew + 0.5).cast("long"), F.floor(mid_ticks + half + skew + 0.5).cast("long")


def time_key(seconds: Column) -> Column:
    """Seconds as (ns, subns): whole nanoseconds, rounded down, and the billionths of one that are left; exact to 18 decimals. Null for what is no number or doesn't fit."""
    exact = decimal(seconds)
    whole = F.floor(exact).try_cast("long")
    atto = (F.pmod(exact, F.lit(1)).cast("decimal(19,18)") * F.lit(10**18).cast("decimal(19,0)")).cast("long")
    ns = F.try_add(F.try_multiply(whole, F.lit(1_000_000_000).cast("long")), F.call_function("div", atto, F.lit(1_000_000_000).cast("long")))
    return F.when(ns.isNotNull(), F.struct(ns.alias("ns"), (atto % 1_000_000_000).alias("subns")))


def whole_ns(seconds: Column) -> Column:
    """Nanoseconds of seconds from 0 on; null if they aren't whole."""
    key = time_key(seconds)
    return F.when((key["subns"] == 0) & (key["ns"] >= 0), key["ns"])


def time_of(ns: Column, subns: Column) -> Column:
    """A time key as one number of nanoseconds, by which :func:`tidemark.operators.asof.asof` can match."""
    return ns.cast("decimal(28,9)") + (subns.cast("decimal(10,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(28,9)")


def exchange_ns(value: Column) -> Column:
    """Nanoseconds of an exchange time in milliseconds (from 1e12 on) or seconds."""
    exact = value.cast("decimal(28,9)")
    return F.when(exact >= 1_000_000_000_000, exact * 1_000_000).otherwise(exact * 1_000_000_000).cast("long")


def evidence_id(capture: Column, seq: Column, checksum: Column, source_row: Column) -> Column:
    return F.when(capture.isNotNull() & seq.isNotNull(), F.concat_ws(":", capture, seq.cast("string"), checksum)).otherwise(F.concat(F.lit("row:"), source_row.cast("string")))


def horizon_label(horizon_ms: Column) -> Column:
    return F.when(horizon_ms % 1000 == 0, F.concat((horizon_ms / 1000).cast("long").cast("string"), F.lit("s"))).otherwise(F.concat(horizon_ms.cast("string"), F.lit("ms")))
