"""Accounting over fills: positions, PnL, time-weighted inventory, drawdown, streaks, markouts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof
from .ordered import HOUR_NS, chunk_of, previous, running

DAY_NS = 24 * HOUR_NS


def position(fills: DataFrame) -> DataFrame:
    """Final (lots, cost, realized) of each symbol from fills (symbol, ns, seq, signed lots, tick).

    Integer cost basis: opening adds tick x lots; closing takes the share of the basis, rounded toward
    zero, and realizes the difference; a reversal closes all and opens the rest. Order matters, and the fold
    starts anew wherever a position is flat: a symbol's fills are cut there, each stretch is folded in a row of its own, and
    what stretches realize adds up. A stretch that is never flat is one row.
    """
    state = F.struct(F.lit(0).cast("long").alias("lots"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("realized"))

    def step(s: Column, f: Column) -> Column:
        lots, cost, realized, q, tick = s["lots"], s["cost"], s["realized"], f["lots"], f["tick"]
        closed = F.when(F.signum(lots) * F.signum(q) < 0, F.least(F.abs(lots), F.abs(q))).otherwise(F.lit(0))
        # basis of the closed part; truncation toward zero as in integer ledgers
        product, whole = F.abs(cost) * closed, F.greatest(F.abs(lots), F.lit(1))
        part = F.when(closed == F.abs(lots), cost).otherwise(((product - product % whole) / whole).cast("long") * F.signum(cost).cast("long"))
        opened = q + F.signum(lots).cast("long") * closed
        gain = F.signum(lots).cast("long") * closed * tick - part
        return F.struct((lots + q).cast("long").alias("lots"), (cost - part + opened * tick).cast("long").alias("cost"), (realized + gain).cast("long").alias("realized"))

    held = inventory(fills)
    keys = ["symbol", "_stretch"]
    cut = running(held, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"_stretch": ("sum", (F.col("position") == 0).cast("long"))}, before=True)
    ordered = F.sort_array(F.collect_list(F.struct("ns", "seq", "lots", "tick")))
    folded = cut.groupBy(*keys).agg(ordered.alias("f")).select(*keys, F.size("f").cast("long").alias("fills"), F.aggregate("f", state, step).alias("s"))
    last = F.max_by("s", "_stretch")
    return folded.groupBy("symbol").agg(F.sum("fills").alias("fills"), last["lots"].alias("lots"), last["cost"].alias("cost"), F.sum("s.realized").alias("realized"))


def position_path(fills: DataFrame) -> DataFrame:
    """Fills (symbol, ns, seq, signed lots, tick) with the position, its cost and what is realized up to and with each of them.

    The fold of :func:`position`, with every state it passes. It starts anew wherever a position is flat, so the stretches between are
    tasks' groups, streamed in order with one state; what a fill realizes is summed over stretches by a running sum. A
    stretch that is never flat is one task. Lots of zero change nothing. Null lots or ticks: left out.
    """
    sound = fills.where("lots IS NOT NULL AND tick IS NOT NULL").select("symbol", "ns", "seq", F.col("lots").cast("long").alias("lots"), F.col("tick").cast("long").alias("tick"))
    cut = running(inventory(sound), ["symbol"], chunk_of("ns"), ["ns", "seq"], {"_stretch": ("sum", (F.col("position") == 0).cast("long"))}, before=True)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, held, basis = None, 0, 0
        for rows in batches:
            costs, gains = [], []
            for symbol, number, q, tick in zip(rows["symbol"], rows["_stretch"], rows["lots"].tolist(), rows["tick"].tolist(), strict=True):
                if (symbol, number) != stretch:
                    stretch, held, basis = (symbol, number), 0, 0
                closed = min(abs(held), abs(q)) if held * q < 0 else 0
                sign = (held > 0) - (held < 0)
                part = basis if closed == abs(held) else abs(basis) * closed // abs(held) * ((basis > 0) - (basis < 0))
                gains.append(sign * closed * tick - part)
                basis += (q + sign * closed) * tick - part
                held += q
                costs.append(basis)
            yield rows.drop(columns="_stretch").assign(cost=costs, gain=gains)

    kind = fills.schema["symbol"].dataType.simpleString()
    dealt = cut.repartition("symbol", "_stretch").sortWithinPartitions("symbol", "_stretch", "ns", "seq")
    folded = dealt.mapInPandas(fold, f"symbol {kind}, ns long, seq long, lots long, tick long, position long, cost long, gain long")
    return running(folded, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"realized": ("sum", F.col("gain"))})


def equity_path(path: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks (symbol, ns, seq, mid) with the position that was held then, realized, unrealized and equity, its peak (at least 0) and the drop below it.

    ``path``: of :func:`position_path`; fills of a mark's own time count. Before the first fill all is 0. An open
    position without a mid has no unrealized value or equity; such a mark moves no peak.
    """
    held = asof(marks.select("symbol", "ns", "seq", "mid"), path, ["symbol"], F.col("ns"), F.col("ns"), ["position", "cost", "realized"])
    columns = {c: F.coalesce(f"{c}_asof", F.lit(0).cast("long")) for c in ("position", "cost", "realized")}
    valued = held.select("symbol", "ns", "seq", "mid", *[c.alias(k) for k, c in columns.items()])
    valued = valued.withColumn("unrealized", F.when(F.col("position") == 0, 0.0).otherwise(F.col("position") * F.col("mid") - F.col("cost")))
    valued = valued.withColumn("equity", F.col("realized") + F.col("unrealized"))
    peaks = running(valued, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"peak": ("max", F.greatest(F.col("equity"), F.lit(0.0)))})
    return peaks.withColumn("drawdown", F.col("peak") - F.col("equity"))


def pnl(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """Positions (symbol, lots, cost, realized) with mid, unrealized and total; both are null where an open position has no mark (symbol, mid)."""
    priced = positions.join(marks.select("symbol", "mid"), "symbol", "left")
    unrealized = F.when(F.col("lots") == 0, 0.0).otherwise(F.col("lots") * F.col("mid") - F.col("cost"))
    return priced.withColumn("unrealized", unrealized).withColumn("total", F.col("realized") + F.col("unrealized"))


def portfolio_pnl(valued: DataFrame) -> DataFrame:
    """Sums of :func:`pnl`: realized, and unrealized and total unless an open position is unpriced; and how many are."""
    missing = F.count_if(F.col("unrealized").isNull())
    whole = lambda c: F.when(missing == 0, F.sum(c))
    return valued.agg(F.sum("realized").alias("realized"), whole("unrealized").alias("unrealized"), whole("total").alias("total"), missing.alias("unpriced"))


def inventory_stats(series: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation (null for one row) and largest size of a value per symbol, a sample a row."""
    return series.groupBy("symbol").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.max(F.abs(value)).alias("largest"))


def inventory(fills: DataFrame) -> DataFrame:
    """Adds ``position``: signed lots of the symbol after the fill."""
    return running(fills, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"position": ("sum", F.col("lots"))})


def time_weighted(series: DataFrame, value: str) -> DataFrame:
    """Signed and absolute time-weighted mean of a value per symbol: each value counts until the next row."""
    steps = previous(series, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"_ns": F.col("ns"), "_v": F.col(value)}).where("_ns IS NOT NULL")
    span = (F.col("ns") - F.col("_ns")).cast("decimal(38,0)")
    sums = steps.groupBy("symbol").agg(F.sum(F.col("_v") * span).alias("area"), F.sum(F.abs("_v") * span).alias("absolute"), F.sum(span).alias("span"))
    mean = lambda c: F.when(F.col("span") > 0, F.col(c).cast("double") / F.col("span").cast("double"))
    return sums.select("symbol", mean("area").alias("mean"), mean("absolute").alias("mean_absolute"))


def drawdown(series: DataFrame, equity: str) -> DataFrame:
    """Peak (at least 0), final value and largest drop below the running peak of each symbol."""
    peaks = running(series, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"_peak": ("max", F.greatest(F.col(equity), F.lit(0)))})
    return peaks.groupBy("symbol").agg(F.max("_peak").alias("peak"), F.max_by(equity, F.struct("ns", "seq")).alias("final"), F.max(F.col("_peak") - F.col(equity)).alias("max_drawdown"))


def loss_streak(series: DataFrame, delta: str) -> DataFrame:
    """Longest run of losses per symbol; a zero or gain ends a run."""
    loss = F.col(delta) < 0
    islands = running(series, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"_island": ("sum", (~loss).cast("long"))})
    runs = islands.groupBy("symbol", "_island").agg(F.sum(loss.cast("long")).alias("run"))
    return runs.groupBy("symbol").agg(F.max("run").alias("max_loss_streak"))


def halts(series: DataFrame, equity: str, limit: int) -> DataFrame:
    """First row of each symbol whose drop below its running peak exceeds ``limit``: where a kill switch would act."""
    peaks = running(series, ["symbol"], chunk_of("ns"), ["ns", "seq"], {"_peak": ("max", F.greatest(F.col(equity), F.lit(0)))})
    return peaks.where(F.col("_peak") - F.col(equity) > limit).groupBy("symbol").agg(F.min(F.struct("ns", "seq")).alias("h")).select("symbol", F.col("h.ns").alias("halt_ns"), F.col("h.seq").alias("halt_seq"))


def markouts(fills: DataFrame, marks: DataFrame, horizons_ns: Sequence[int], last_epochs: DataFrame | None = None) -> DataFrame:
    """Fills x horizons with the first mark at or after ns + horizon: status, signed markout, lag.

    ``fills``: symbol, ns, seq, side, tick; ``marks``: symbol, ns, seq, mark. Bids gain when the mark is higher.
    With ``last_epochs`` (symbol, last_epoch) both sides have an epoch: a horizon takes a mark of its fill's epoch only, and
    one that is open when its epoch ends is invalidated.
    """
    by = ["symbol"] if last_epochs is None else ["symbol", "epoch"]
    due = fills.withColumn("horizon_ns", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons_ns])))
    found = asof(due, marks, by, F.col("ns") + F.col("horizon_ns"), F.col("ns"), ["mark"], forward=True)
    status = F.when(F.col("mark_asof").isNotNull(), "resolved")
    if last_epochs is not None:
        found = found.join(last_epochs, "symbol", "left")
        status = status.when(F.col("epoch") < F.col("last_epoch"), "invalidated")
    signed = F.when(F.col("side") == "bid", F.col("mark_asof") - F.col("tick")).otherwise(F.col("tick") - F.col("mark_asof"))
    return found.select(
        *by, "seq", "side", "lots", "horizon_ns", status.otherwise("unresolved").alias("status"),
        signed.alias("markout"), (signed < 0).alias("adverse"), (F.col("at_asof") - F.col("ns") - F.col("horizon_ns")).alias("lag_ns"),
    )


def zero_filled(df: DataFrame, key: str, values: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates for a fixed list of keys, 0 for those without rows."""
    names = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return names.join(df.groupBy(key).agg(*[c.alias(k) for k, c in aggregates.items()]), key, "left").select(key, *[F.coalesce(k, F.lit(0)).alias(k) for k in aggregates])


def weighted(x: Column, q: Column) -> Column:
    """Quantity-weighted average, 0 if there is no quantity."""
    return F.when(F.sum(q) > 0, F.sum(x * q).cast("double") / F.sum(q).cast("double")).otherwise(0.0)


def pending_markouts(fills: DataFrame, horizons_ns: Sequence[int], capacity: int) -> DataFrame:
    """Adds pending, the markouts that earlier fills still wait for, and refused: with its own the fill would exceed ``capacity`` (symbol, ns, seq).

    Markouts that fall due at a fill's time are resolved before it. A run stops at its first refusal, so what comes after one is only counted.
    """
    each = len(horizons_ns)
    due = fills.select("symbol", F.explode(F.array(*[F.col("ns") + h for h in horizons_ns])).alias("ns"), F.lit(0).alias("_kind"), "seq", F.lit(-1).alias("_change"))
    rows = fills.select("symbol", "ns", F.lit(1).alias("_kind"), "seq", F.lit(each).alias("_change"))
    both = running(rows.unionByName(due), ["symbol"], chunk_of("ns", 24 * HOUR_NS), ["ns", "_kind", "seq"], {"pending": ("sum", F.col("_change").cast("long"))})
    own = both.where("_kind = 1").select("symbol", "seq", (F.col("pending") - each).alias("pending"))
    return fills.join(own, ["symbol", "seq"]).select(*fills.columns, "pending", (F.col("pending") + each > capacity).alias("refused"))
