"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small, word_count

#: Size classes (upper bound in words, preference): a document of fewer words is wanted less often.
PREFERENCE = ((64, 2), (512, 3), (None, 4))
BUCKETS, ROWS_PER_BUCKET = 4096, 20_000


def waterfill(parts: DataFrame, by: Sequence[str], total: Column, weight: Column, cap: Column, out: str) -> DataFrame:
    """Share ``total`` by ``weight`` within each ``by``, no share above ``cap``; what a cap cuts off is reshared.

    Closed form of the repeated resharing: parts in the order in which their caps bind.
    """
    d = lambda c: c.cast("double")
    parts = parts.withColumns({"_tm_t": d(total), "_tm_w": d(weight), "_tm_c": d(cap)})
    whole = Window.partitionBy(*by)
    before = whole.orderBy(F.try_divide("_tm_c", "_tm_w").asc_nulls_first(), "_tm_w", "_tm_c").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = F.try_divide(F.col("_tm_t") - F.coalesce(F.sum("_tm_c").over(before), zero), F.sum("_tm_w").over(whole) - F.coalesce(F.sum("_tm_w").over(before), zero))
    parts = parts.withColumn("_tm_capped", F.coalesce(level * F.col("_tm_w") >= F.col("_tm_c"), F.lit(True)))
    used = lambda c: F.sum(F.when(F.col("_tm_capped"), F.col(c)).otherwise(0.0)).over(whole)
    share = F.try_divide((F.col("_tm_t") - used("_tm_c")) * F.col("_tm_w"), F.sum("_tm_w").over(whole) - used("_tm_w"))
    return parts.withColumn(out, F.when(F.col("_tm_capped"), F.col("_tm_c")).otherwise(share)).drop("_tm_t", "_tm_w", "_tm_c", "_tm_capped")


def decide(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_copies: int = 3, weights: Sequence[int] = (1, 2, 3), preference=PREFERENCE, seed: str = "mix-1") -> DataFrame:
    """One row per document: id, draw (its row's hash), size, source, source_size, target, whole (copies), taken (words).

    Sources in code point order (null last) weigh ``weights``, repeating, and share all words; no
    source gets more than ``max_copies`` times its own words. Within a source a document's expected
    copies follow the preference of its size class; their whole part is certain, the rest is the
    inclusion probability p. Documents are ranked by u / (1 - u) over p / (1 - p), u a hash of id
    and text, and taken in that order until the source's words are reached; the document at which
    they are reached is cut to the words still wanted, so every source meets its target rounded to
    a word. No order of all rows of a source is needed: ranks are summed in ``BUCKETS`` equal parts
    of (0, 1), and rows are ordered only within a part.

    Null text or no words: size 0, nothing taken. Null source: a source of its own. Null ids and
    repeated rows: documents like others (equal rows get equal ranks, one may be cut). Empty table:
    empty result.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))).alias("draw"),
        )
    )
    kind = F.when(F.col("size") < preference[0][0], 0)
    for i, (bound, _) in enumerate(preference[1:-1], 1):
        kind = kind.when(F.col("size") < bound, i)
    rows = rows.withColumn("kind", kind.otherwise(len(preference) - 1))
    wanted = F.element_at(F.array(*[F.lit(p) for _, p in preference]), F.col("kind") + 1)

    kinds = rows.groupBy("source", "kind").agg(F.sum("size").alias("kind_size"))
    sources = kinds.groupBy("source").agg(F.sum("kind_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)) + 1)
    sources = waterfill(sources.withColumn("weight", weight).withColumn("all", F.sum("source_size").over(Window.partitionBy())), [], F.col("all"), F.col("weight"), max_copies * F.col("source_size"), "target")
    kinds = kinds.join(sources.drop("weight", "all").withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
    kinds = waterfill(kinds, ["source"], F.col("target"), wanted * F.col("kind_size"), max_copies * F.col("kind_size"), "share")
    copies = F.coalesce(F.try_divide("share", "kind_size"), F.lit(0.0))
    kinds = kinds.withColumns({"whole": F.floor(copies).cast("long"), "p": copies - F.floor(copies)})
    rest = F.round("target").cast("long") - F.sum(F.col("whole") * F.col("kind_size")).over(Window.partitionBy("source"))
    plan = materialize(kinds.select(F.col("source").alias("source2"), F.col("kind").alias("kind2"), "source_size", "target", "whole", "p", F.greatest(rest, F.lit(0)).alias("rest")))

    u = (F.conv(F.substring("draw", 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.join(small(plan), F.col("source").eqNullSafe(F.col("source2")) & (F.col("kind") == F.col("kind2"))).drop("source2", "kind2")
    buckets = max(BUCKETS, rows.count() // ROWS_PER_BUCKET)
    certain, drawn = ranked.where("p <= 0").withColumn("more", F.lit(0).cast("long")), ranked.where("p > 0")
    drawn = drawn.withColumn("rank", odds / (1 + odds)).withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)))
    filled = drawn.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # a row per source: the bucket in which its words are reached, and the words before it
    reached = filled.select("source", "bucket", "rest", "words", upto.alias("upto")).where("upto >= rest").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("at"))
    reached = materialize(reached.select(F.col("source").alias("source2"), F.col("at.bucket").alias("last"), F.col("at.before").alias("before")))
    drawn = drawn.join(small(reached), F.col("source").eqNullSafe(F.col("source2")), "left")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("rank", "id", "draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - inside))
    more = F.when(F.col("last").isNull() | (F.col("bucket") < F.col("last")), F.col("size")).when(F.col("bucket") > F.col("last"), 0).otherwise(part)
    columns = ["id", "draw", "size", "source", "source_size", "target", "whole", "more"]
    both = drawn.withColumn("more", more).select(*columns).unionByName(certain.select(*columns))
    return both.select(*columns[:-1], (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", **options) -> DataFrame:
    """The mix itself: columns of ``docs``, a row per copy; a cut document keeps its first words.

    See :func:`decide`, also for nulls, ties and empty tables; documents of which nothing is taken are
    left out. Rows that are equal in id, text and source are numbered: the first ones take theirs whole, one
    may be cut, and the others get no more than their whole copies.
    """
    who = lambda draw, source: F.concat(draw, F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))))
    twin = F.row_number().over(Window.partitionBy("_tm_who").orderBy(F.lit(1)))  # equal rows only
    plan = decide(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options).where("taken > 0")
    plan = plan.select(who(F.col("draw"), F.col("source")).alias("_tm_who"), "size", F.col("whole").cast("int").alias("whole"), (F.col("taken") - F.col("whole") * F.col("size")).alias("more"))
    # equal rows are of one size and have the same whole copies; at most one of them is cut
    plan = plan.groupBy("_tm_who").agg(F.first("size").alias("_tm_size"), F.first("whole").alias("_tm_whole"), F.count_if(F.col("more") == F.col("size")).alias("_tm_full"), F.max(F.when(F.col("more") < F.col("size"), F.col("more"))).alias("_tm_part"))
    # one shuffle of the texts, by who they are: it serves the numbering of equal rows and the join
    joined = docs.withColumn("_tm_who", who(draw, F.col(source_col).cast("string"))).withColumn("_tm_twin", twin).join(plan, "_tm_who")
    more = F.when(F.col("_tm_twin") <= F.col("_tm_full"), F.col("_tm_size")).when(F.col("_tm_twin") == F.col("_tm_full") + 1, F.coalesce("_tm_part", F.lit(0).cast("long"))).otherwise(0)
    parts = F.concat(F.array_repeat("_tm_size", F.col("_tm_whole")), F.array(more))
    copies = joined.withColumn("_tm_words", F.explode(F.filter(parts, lambda n: n > 0)))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_tm_words").cast("int")), "")
    return copies.withColumn(text_col, F.when(F.col("_tm_words") < F.col("_tm_size"), cut).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
