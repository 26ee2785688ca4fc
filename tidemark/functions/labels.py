"""Names of scenarios, comments on fills and details of records, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def scenario_id(profile: Column, trades: Column, depth: Column, netting: Column, window_seconds: Column) -> Column:
    """Which public signals consume a queue in a profile, and the netting window in microseconds, if both do and netting is on."""
    signal = F.when(trades & depth, "trade_and_depth").when(trades, "trade").when(depth, "depth").otherwise("none")
    window = F.when(netting & trades & depth, F.bround(window_seconds * 1_000_000).cast("long")).otherwise(0)
    return F.format_string("public_l2:%s:signal=%s:overlap_us=%d", profile, signal, window)


def comment(side: Column, markout: Column, toxic: Column, hedge_qty: Column) -> Column:
    """A maker's remark on a fill, by its markout, the flow's toxicity and the hedge."""
    base = F.when((markout < 0) & toxic, "picked off").when(markout < 0, "adverse selection").when(side == "buy", "good buy").otherwise("sold rich")
    hedge = F.when(hedge_qty > 0, "; hedged short delta").when(hedge_qty < 0, "; hedged long delta").otherwise("")
    return F.concat(base, hedge)


def economic_direction(customer_side: Column, delta: Column) -> Column:
    """1 if what the customer does gains from a higher spot, -1 if it loses, 0 without delta."""
    return F.signum(F.when(customer_side == "buy", delta).otherwise(-delta))


def contract_weight(spot: Column, strike: Column, years: Column) -> Column:
    """How much of the flow a contract draws: more near the money and near expiry."""
    return 1 / (0.2 + F.abs(F.log(strike / F.greatest(spot, F.lit(1e-9))))) * (1 / (0.05 + years))


def symbols(text: Column) -> Column:
    """Symbols of a comma-separated list: trimmed, upper-case, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")


def details(kind: Column, fields: Mapping[str, Mapping[str, Column]]) -> Column:
    """Details of a trace row as JSON: the fields that its kind has, {} for others."""
    found = F.lit(None).cast("string")
    for name, columns in fields.items():
        found = F.when(kind == name, F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))).otherwise(found)
    return F.coalesce(found, F.lit("{}"))
