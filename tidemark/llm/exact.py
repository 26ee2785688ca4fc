"""Exact dedup by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_RUN, bind, materialize, shuffle_partitions, small, text_of

LOWEST = -(2**63)


def _bucket(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below ``key``, found in two steps of about sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]

    def below(values, k):
        return F.size(F.filter(values, lambda s: s <= k))

    def find(k):
        return bind(below(F.lit([g[0] for g in groups]), k), lambda g: F.when(g == 0, 0).otherwise((g - 1) * step + below(F.element_at(F.lit(groups), F.greatest(g, F.lit(1))), k)))

    return bind(key, find)


def content_sort(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets_per_partition: int = 4, samples_per_bucket: int = 8, prefix: int = 64, seed: int = 11) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one space. Splitters sampled
    from all rows cut them into ranges; a range is sorted by the bytes of its texts and then by id (Spark's
    external sort), so equal texts lie side by side, and every text is compared in full with its neighbour.

    Splitters are bounded keys: the first ``prefix`` characters of a text, its digest for texts that begin
    alike, and the id, so that a text that a third of all rows share spans many ranges. A text that is cut by a
    splitter is recognized by that splitter's prefix and digest; the parts of its run, one row a range, are brought
    together by comparing the texts themselves. Only the sample reaches the driver: ``samples_per_bucket`` keys a range, of
    ``prefix`` characters and 81 more.

    Null text counts as empty. Null ids come last: they are kept only if no copy has an id. Repeated
    rows: one of them is kept. Empty table: empty result. Other columns are not read.
    """
    norm = F.regexp_replace(text_of(text_col), WS_RUN, " ")
    rank = F.coalesce(F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(LOWEST))), 16, "0"), F.lit("~"))

    def with_keys(rows: DataFrame) -> DataFrame:
        source = rows.select(F.col(id_col).alias("id"), norm.alias("norm"), rank.alias("rank")).withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256))
        return source.withColumn("head", F.concat(F.substring("norm", 1, prefix), F.lit("\x01"), "sha")).withColumn("key", F.concat("head", "rank"))

    buckets = buckets_per_partition * shuffle_partitions(docs.sparkSession)
    fraction = min(1.0, buckets * samples_per_bucket / max(1, docs.count()))
    sample = sorted(((r.key, r.head) for r in with_keys(docs.select(id_col, text_col).sample(False, fraction, seed)).select("key", "head").collect()), key=lambda k: k[0].encode())
    chosen = {sample[len(sample) * i // buckets] for i in range(1, buckets)} if sample else set()
    cuts = sorted((key for key, _ in chosen), key=lambda k: k.encode())
    spans = F.col("head").isin(sorted({head for _, head in chosen}))

    order = Window.partitionBy("bucket").orderBy("norm", "rank")
    seen = with_keys(docs).select("id", "norm", "rank", "sha", _bucket(F.col("key"), cuts).alias("bucket"), spans.alias("spans"))
    new = F.coalesce(F.lag("norm").over(order) != F.col("norm"), F.lit(True))
    sorted_rows = seen.select("bucket", "id", "sha", "rank", "norm", new.alias("new"), F.when(new & F.col("spans"), F.col("norm")).alias("edge"))
    rows = materialize(sorted_rows.select("bucket", "id", "sha", "new", "edge", F.sum(F.col("new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run")))

    run = Window.partitionBy("bucket", "run")
    counted = materialize(rows.select("bucket", "run", "id", "sha", "new", "edge", F.count("*").over(run).alias("n"), F.min("id").over(run).alias("least")))
    # of the texts that splitters cut, a row per range that has some: their sums replace the local ones
    parts = counted.where("edge IS NOT NULL").select("bucket", "run", "edge", "n", "least")
    whole = parts.groupBy("edge").agg(F.sum("n").alias("n_all"), F.min("least").alias("least_all"), F.min("bucket").alias("home"))
    sums = materialize(parts.join(whole, "edge").select("bucket", "run", "n_all", "least_all", "home"))
    return counted.join(small(sums), ["bucket", "run"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("least_all", "least").alias("keep_id"),
        F.coalesce("n_all", "n").alias("group_size"),
        (F.col("new") & F.coalesce(F.col("home") == F.col("bucket"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
