"""Parameter grids, rankings, day splits, block bootstraps and step markouts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import numbered, running

#: SplitMix64.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def grid(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the parameters, a row each."""
    first = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(k) for k, vs in values.items()])
    return reduce(lambda df, k: df.withColumn(k, F.explode(k)), values, first)


def rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``rank`` 1..n over a sweep's few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def day_split(days: DataFrame, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """Distinct days in order as train, validation and test: floors of the shares, at least a day each."""
    numbered = days.select("day").distinct().withColumns({"_i": F.row_number().over(Window.orderBy("day")), "_n": F.count("*").over(Window.partitionBy())})
    train, validation = (F.greatest(F.lit(1), F.floor(F.col("_n") * s)) for s in shares)
    return numbered.select("day", F.when(F.col("_i") <= train, "train").when(F.col("_i") <= train + validation, "validation").otherwise("test").alias("split"))


def splitmix64(states: np.ndarray) -> np.ndarray:
    """Outputs for given states; draw k of a seed has the state seed + (k + 1) * GAMMA, so draws are independent of each other."""
    z = states.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def bootstrap(df: DataFrame, order: str, value: str, *, block: int, replicates: int, seed: int, confidence: float = 0.95, largest: int = 100_000) -> DataFrame:
    """Mean with a moving-block bootstrap interval of an ordered sample (a day's or a run's statistics: few rows).

    Replicates are spread over tasks; each computes its own draws of the one SplitMix64 stream. Their means
    are ordered by Spark, whose exact percentile interpolates linearly. The sample goes to every task, so it must be of ``largest``
    rows at most; more raise an error.
    """
    spark = df.sparkSession
    if df.limit(largest + 1).count() > largest:
        raise ValueError(f"a bootstrap takes statistics of days or runs, {largest} rows at most")
    sample = np.array([r[0] for r in df.select(order, value).orderBy(order).select(value).collect()], dtype=float)
    if not len(sample) or not np.isfinite(sample).all() or block > len(sample):
        raise ValueError("a bootstrap needs finite values, at least a block of them")
    blocks = -(-len(sample) // block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            draws = rows["id"].to_numpy().astype(np.uint64)[:, None] * np.uint64(blocks) + np.arange(1, blocks + 1, dtype=np.uint64)
            starts = (splitmix64(np.uint64(seed) + draws * np.uint64(GAMMA)) % np.uint64(len(sample) - block + 1)).astype(np.int64)
            picked = sample[(starts[:, :, None] + np.arange(block)).reshape(len(rows), -1)[:, : len(sample)]]
            yield pd.DataFrame({"mean": picked.mean(axis=1)})

    means = spark.range(replicates).mapInPandas(run, "mean double")
    tail = (1 - confidence) / 2
    return means.agg(F.lit(float(sample.mean())).alias("estimate"), F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"), F.count("*").alias("replicates"))


def paired_bootstrap(df: DataFrame, order: str, left: str, right: str, **options) -> DataFrame:
    """Mean difference of two series that belong together row by row, with the interval of :func:`bootstrap`: both are drawn in the same blocks. A row that lacks one of them is refused."""
    if not df.where(F.col(left).isNull() | F.col(right).isNull()).limit(1).isEmpty():
        raise ValueError("a pair lacks one of its values")
    return bootstrap(df.select(order, (F.col(left) - F.col(right)).alias("difference")), order, "difference", **options)


def step_markouts(fills: DataFrame, horizon: int, block: int = 50_000) -> DataFrame:
    """Markout of each fill against its symbol's row ``horizon`` steps on, or the last one, and the running sum."""
    last = fills.groupBy("symbol").agg(F.max("step").alias("_last"))
    due = fills.join(last, "symbol").select("symbol", "step", "tick", "lots", F.least(F.col("step") + horizon, F.col("_last")).alias("due"))
    later = fills.select("symbol", F.col("step").alias("due"), F.col("tick").alias("later"))
    marked = due.join(later, ["symbol", "due"]).select("symbol", "step", ((F.col("later") - F.col("tick")) * F.col("lots")).alias("markout"))
    return running(marked, ["symbol"], F.floor(F.col("step") / block).cast("long"), ["step"], {"cumulative": ("sum", F.col("markout"))})


def profile_pivot(runs: DataFrame, metrics: Sequence[str], baseline: str, candidate: str) -> DataFrame:
    """A row per metric of a baseline's and a candidate's run (profile and metrics), and the candidate's less the baseline's; null where a run is missing."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("c")
    long = runs.select("profile", cells).select("profile", "c.*")
    wide = long.groupBy("metric").pivot("profile", [baseline, candidate]).agg(F.first("value"))
    return wide.withColumn("difference", F.col(candidate) - F.col(baseline))


def run_id(input_sha256: Column, config: Column, adapter: Column, version: str) -> Column:
    """Content address of a run: 16 digits of the SHA-256 of its input's digest, its configuration and feed adapter (structs with fields in order of name) and a version, as JSON."""
    told = F.struct(config.alias("config"), adapter.alias("feed_adapter"), input_sha256.alias("input_sha256"), F.lit(version).alias("version"))
    return F.substring(F.sha2(F.to_json(told).cast("binary"), 256), 1, 16)


def capture_id(path: Column) -> Column:
    """Name of a capture by its path alone: 16 digits of the path's SHA-256."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def variant_id(name: Column, config: Column) -> Column:
    """Content address of a variant: 16 digits of the SHA-256 of its name and configuration (a struct with fields in order of name) as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(config.alias("config"), name.alias("name"))).cast("binary"), 256), 1, 16)


def registry_issues(rows: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """What keeps results from being one to one with the registered variants: key, rows, variants and issue (unregistered, missing, duplicate)."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((rows, "rows"), (variants, "variants")))
    both = a.join(b, key, "full_outer").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("rows", "variants")})
    issue = F.when(F.col("variants") == 0, "unregistered").when(F.col("rows") == 0, "missing").when((F.col("rows") > 1) | (F.col("variants") > 1), "duplicate")
    return both.withColumn("issue", issue).where("issue IS NOT NULL")


def paired(left: DataFrame, right: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str], value: str) -> DataFrame:
    """Two series side by side by position: by, position, left, right and delta; null where one series has ended."""
    a, b = (numbered(df, by, chunk, order, "position").select(*by, "position", F.col(value).alias(n)) for df, n in ((left, "left"), (right, "right")))
    return a.join(b, [*by, "position"], "full_outer").withColumn("delta", F.col("left") - F.col("right"))


def checkpoint_sums(rows: DataFrame, checkpoints: DataFrame, by: Sequence[str], value: str, block: int = 50_000) -> DataFrame:
    """Adds ``total`` to checkpoints (by, step): the sum of the rows' values up to that step, 0 before the first."""
    steps = rows.groupBy(*by, "step").agg(F.sum(value).alias("_tm_value")).withColumn("_tm_at", F.lit(None).cast("struct<step:long>"))
    marks = checkpoints.select(*by, "step", F.lit(None).cast(steps.schema["_tm_value"].dataType).alias("_tm_value"), F.struct(F.col("step").cast("long").alias("step")).alias("_tm_at"))
    both = running(steps.unionByName(marks), by, F.floor(F.col("step") / block).cast("long"), ["step", F.col("_tm_at").isNotNull()], {"total": ("sum", F.col("_tm_value"))})
    return both.where("_tm_at IS NOT NULL").select(*by, "step", "total")


def worked_examples(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """A representative and a stress fill of each key, of those that were hedged (step, contract, markout, toxic, hedge_qty).

    Representative: its markout's size is nearest the median size; stress: the worst markout among the toxic ones, among all if none is.
    Ties: the lowest step, then contract, then markout (two sizes may lie as far on either side of the median). Null if nothing was hedged.
    """
    hedged = fills.where(F.abs("hedge_qty") > 0).withColumn("_tm_size", F.abs("markout"))
    pick = F.struct("step", "contract", "markout")
    middle = hedged.groupBy(*by).agg(F.percentile("_tm_size", F.lit(0.5)).alias("_tm_median"))
    chosen = hedged.join(middle, list(by)).groupBy(*by).agg(
        F.min_by(pick, F.struct(F.abs(F.col("_tm_size") - F.col("_tm_median")), "step", "contract", "markout")).alias("representative"),
        F.min_by(pick, F.struct(~F.col("toxic"), "markout", "step", "contract")).alias("stress"),
    )
    return fills.select(*by).distinct().join(chosen, list(by), "left")


def markout_summary(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums, counts, adverse share, best and worst of markouts, in all and by toxicity (markout, toxic)."""
    m, toxic = F.col("markout"), F.col("toxic")
    of = lambda which: F.coalesce(F.sum(F.when(which, m)), F.lit(0))
    return fills.groupBy(*by).agg(
        F.count("*").alias("fills"), F.sum(m).alias("markout"), of(toxic).alias("toxic_markout"), of(~toxic).alias("other_markout"), F.count_if(toxic).alias("toxic_fills"),
        (F.count_if(m < 0) / F.count("*")).alias("adverse_rate"), F.max(m).alias("best"), F.min(m).alias("worst"),
    )


def markout_path(path: DataFrame, fills: DataFrame, by: Sequence[str], block: int = 50_000) -> DataFrame:
    """Each step of a path (by, step) with the markouts of its fills (by, step, markout, toxic), and their sums so far; 0 where none are.

    Fills at steps that the path doesn't have count nowhere. A path is summed in blocks of ``block`` steps.
    """
    toxic = F.when(F.col("toxic"), F.col("markout")).otherwise(0)
    sums = fills.groupBy(*by, "step").agg(F.sum("markout").alias("_tm_all"), F.sum(toxic).alias("_tm_toxic"))
    met = path.select(*by, "step").join(sums, [*by, "step"], "left")
    met = met.select(*by, "step", F.coalesce("_tm_all", F.lit(0)).alias("markout"), F.coalesce("_tm_toxic", F.lit(0)).alias("toxic_markout"))
    return running(met, by, F.floor(F.col("step") / block).cast("long"), ["step"], {"total": ("sum", F.col("markout")), "toxic_total": ("sum", F.col("toxic_markout"))})


def split_verdict(days: DataFrame, by: Sequence[str], minimum: int = 10) -> DataFrame:
    """Whether each key has days enough for claims: distinct ``day`` values, ``claim_ready`` from ``minimum`` on, and the reason if not."""
    if minimum < 3:
        raise ValueError("a split needs three days")
    out = days.groupBy(*by).agg(F.countDistinct("day").alias("days"))
    few = F.when(F.col("days") < 3, "three days are needed to split").when(F.col("days") < minimum, F.concat(F.lit("only "), "days", F.lit(f" days; need {minimum}")))
    return out.select(*by, "days", (F.col("days") >= minimum).alias("claim_ready"), few.alias("reason"))
