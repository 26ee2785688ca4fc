"""Option prices and Greeks as column expressions, with a normal distribution function from built-in functions."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the rational form of the normal tail up to 7.07 deviations, from the highest power down.
TAIL_OVER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function to about 1e-15: a ratio of polynomials times the density near the middle, a continued fraction beyond; plain arithmetic, so it is compiled with its stage."""
    y = F.abs(x)
    horner = lambda c: functools.reduce(lambda total, next_: total * y + next_, c[1:], F.lit(c[0]))
    fraction = functools.reduce(lambda below, k: y + k / below, (4.0, 3.0, 2.0, 1.0), y + 0.65)
    tail = F.exp(-y * y / 2) * F.when(y < 7.07106781186547, horner(TAIL_OVER) / horner(TAIL_UNDER)).otherwise(1 / (fraction * math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def implied_vol(spot: Column, strike: Column, years: Column, *, atm: float, skew: float, convexity: float, term: float, floor: float) -> Column:
    """Surface: at-the-money level, linear and quadratic in log moneyness, with a term slope, floored."""
    k = F.log(strike / spot)
    return F.greatest(F.lit(floor), atm + skew * k + convexity * k * k + term * F.sqrt(years))


def with_greeks(df: DataFrame, *, spot: str = "spot", strike: str = "strike", years: str = "years", rate: str = "rate", vol: str = "vol", kind: str = "option_type") -> DataFrame:
    """Adds fair, delta, gamma, vega and theta (a year) of European options; at expiry the intrinsic value."""
    s, k, t, r, v = (F.col(c) for c in (spot, strike, years, rate, vol))
    live, call = (t > 0) & (v > 0), F.col(kind) == "call"
    df = df.withColumn("_d1", F.when(live, (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))))
    df = df.withColumns({"_n1": normal_cdf(F.col("_d1")), "_n2": normal_cdf(F.col("_d1") - v * F.sqrt(t)), "_pdf": normal_pdf(F.col("_d1"))})
    df = df.withColumn("_df", F.exp(-r * t))
    n1, n2, pdf, discount = (F.col(c) for c in ("_n1", "_n2", "_pdf", "_df"))
    intrinsic = F.greatest(F.lit(0.0), F.when(call, s - k).otherwise(k - s))
    decay = -s * pdf * v / (2 * F.sqrt(t))
    return df.withColumns(
        {
            "fair": F.when(~live, intrinsic).when(call, s * n1 - k * discount * n2).otherwise(k * discount * (1 - n2) - s * (1 - n1)),
            "delta": F.when(~live, F.when(intrinsic > 0, F.when(call, 1.0).otherwise(-1.0)).otherwise(0.0)).when(call, n1).otherwise(n1 - 1),
            "gamma": F.when(live, pdf / (s * v * F.sqrt(t))).otherwise(0.0),
            "vega": F.when(live, s * pdf * F.sqrt(t)).otherwise(0.0),
            "theta": F.when(~live, 0.0).when(call, decay - r * k * discount * n2).otherwise(decay + r * k * discount * (1 - n2)),
        }
    ).drop("_d1", "_n1", "_n2", "_pdf", "_df")


def quotes(fair: Column, delta: Column, vega: Column, book_delta: Column, book_vega: Column, book_gamma: Column, realized_vol: Column, *, delta_weight: float, vega_weight: float, base: float, vol_weight: float, gamma_weight: float, least: float) -> tuple[Column, Column]:
    """A dealer's bid and ask: fair value less a reservation for the book's risk, half a spread that widens with volatility and gamma; at least a cent each and apart."""
    reservation = book_delta * delta * delta_weight + book_vega * vega * vega_weight
    half = F.greatest(F.lit(least), base + realized_vol * vol_weight + F.abs(book_gamma) * gamma_weight)
    bid = F.greatest(F.lit(0.01), fair - half - reservation)
    return bid, F.greatest(bid + 0.01, fair + half - reservation)


def portfolio(positions: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Sums of positions x Greeks (after :func:`with_greeks`) and of their value, per key."""
    return positions.groupBy(*by).agg(*[F.sum(F.col(size) * F.col(g)).alias(g) for g in ("delta", "gamma", "vega", "theta")], F.sum(F.col(size) * F.col("fair")).alias("value"))


def positions(contracts: DataFrame, underlying: DataFrame, multiplier: int) -> DataFrame:
    """What is held, marked: contracts (symbol, contract, quantity, price, delta, vega) times ``multiplier``, and the underlying (symbol, quantity, price).

    Quantities of zero or null are left out. The underlying has a delta of one and no vega.
    """
    held = contracts.where("quantity <> 0").withColumn("_tm_size", F.col("quantity") * multiplier)
    marked = held.select(
        "symbol", F.lit("option").alias("instrument"), "contract", "quantity", "price",
        *[(F.col("_tm_size") * F.col(c)).alias(n) for c, n in (("price", "mark_value"), ("delta", "net_delta"), ("vega", "net_vega"))],
    )
    stock = underlying.where("quantity <> 0").select(
        "symbol", F.lit("underlying").alias("instrument"), F.lit(None).cast("string").alias("contract"), "quantity", "price",
        (F.col("quantity") * F.col("price")).alias("mark_value"), F.col("quantity").alias("net_delta"), F.lit(0).alias("net_vega"),
    )
    return marked.unionByName(stock)
