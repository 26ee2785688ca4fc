"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here, [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WS_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; a folder of our own only where none is named and everything runs in one process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a materialized side of at most ``limit`` rows; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once, also where body's lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_rank(df: DataFrame, parts: list[str], spread: Column, order: list[str], out: str, buckets: int = 1024, amount: Column | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """``out``: running count (or running sum of ``amount``), this row included, within ``parts``.

    The same numbers as one ordered window over each of ``parts``, by bucket of ``spread`` and then by
    ``order``, but no task orders more than a bucket: buckets are summed first, and each starts where
    the ones before it end. There are ``buckets`` of them, or more so that each has ``rows_per_bucket`` rows at most on average.
    ``df`` must be materialized, for it is read several times.
    """
    buckets = max(buckets, df.count() // rows_per_bucket)
    amount = F.lit(1).cast("long") if amount is None else amount
    rows = df.withColumns({"_tm_b": F.pmod(spread, F.lit(buckets)).cast("int"), "_tm_a": amount})
    keys = [*parts, "_tm_b"]
    before = Window.partitionBy(*parts).orderBy("_tm_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.sum("_tm_a").alias("_tm_s")).select(*keys, F.coalesce(F.sum("_tm_s").over(before), F.lit(0)).alias("_tm_s"))
    within = F.sum("_tm_a").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_tm_n", within).join(starts, keys).withColumn(out, F.col("_tm_s") + F.col("_tm_n")).drop("_tm_b", "_tm_a", "_tm_s", "_tm_n")
