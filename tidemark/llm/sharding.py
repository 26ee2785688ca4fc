"""Sharding by balanced label propagation over links between equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread_rank, text_of

GROUP = ["g1", "g2"]


def grants(wished: list[tuple[int, int, int, int]], free: list[int]) -> dict[tuple[int, int], float]:
    """Part granted of the wishes for each (shard, class), given (from, to, class, n) and each shard's free room.

    What leaves a shard makes room in it. All wishes are granted at first and parts are taken back until no shard
    gets more than its room and what leaves it, so moves in a circle stay. Within a shard classes are served from small to large.
    """
    sums: dict[tuple[int, int], int] = {}
    for _, to, kind, n in wished:
        sums[to, kind] = sums.get((to, kind), 0) + n
    part = dict.fromkeys(sums, 1.0)
    while True:
        left = [float(x) for x in free]
        for start, to, kind, n in wished:
            left[start] += n * part[to, kind]
        after = {}
        for to, kind in sorted(sums):
            after[to, kind] = max(0.0, min(part[to, kind], left[to] / sums[to, kind]))
            left[to] -= sums[to, kind] * after[to, kind]
        moved = sum((part[k] - after[k]) * sums[k] for k in sums)
        part = after
        if moved < 0.5:
            return part


def propagate(state: DataFrame, room: dict[int, int]) -> DataFrame:
    """Move linked documents towards the shard that most of their neighbours are in, until none moves.

    ``state`` has a row (g1, g2, shard, n) for the n documents of a link group in a shard: they have
    the same neighbours, so they have the same wish. ``room`` is each shard's capacity. A round joins
    the groups with their fullest shards, sums the wishes from and for each shard by size class, and :func:`grants`
    them as far as the shards' room and what leaves them reach; a class in which it runs out is
    granted in proportion. A group too large for a shard fills it and stays spread otherwise. Each move is to the
    fullest shard of its group, so every round leaves fewer documents apart; ties are drawn anew in each round.
    """
    turn, shards = 0, len(room)
    while True:
        counts = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most a row per shard
        best = state.groupBy(*GROUP).agg(F.max_by("shard", F.struct("n", F.xxhash64("g1", "g2", "shard", F.lit(turn)))).alias("to"))
        wishes = state.join(best, GROUP).where("shard <> to").withColumn("class", F.floor(F.log2("n")).cast("int"))
        wished = [(r.shard, r.to, r["class"], r.n) for r in wishes.groupBy("shard", "to", "class").agg(F.sum("n").alias("n")).collect()]  # at most shards x shards x 64 rows
        granted = {k: p for k, p in grants(wished, [room[s] - counts.get(s, 0) for s in range(shards)]).items() if p > 0}
        if sum(n * granted.get((to, kind), 0.0) for _, to, kind, n in wished) < 1:
            return state
        part = F.create_map(*[F.lit(x) for (to, kind), p in granted.items() for x in (to * 64 + kind, p)])[F.col("to") * 64 + F.col("class")]
        chance = F.pmod(F.xxhash64("g1", "g2", "shard", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moves = wishes.select(*GROUP, "shard", "to", F.least(F.col("n"), F.floor(F.col("n") * part + chance)).cast("long").alias("m")).where("m > 0")
        changes = moves.select(*GROUP, "shard", (-F.col("m")).alias("n")).union(moves.select(*GROUP, F.col("to").alias("shard"), F.col("m").alias("n")))
        state = materialize(state.select(*GROUP, "shard", "n").union(changes).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        turn += 1


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """One row per document: id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Documents of equal text are linked and start in the shard of their id's hash; :func:`propagate`
    brings them together. Shard sizes in rows differ by one at most: what a shard holds beyond its
    quota goes to a pool with the documents that have no link, and the pool fills the quotas exactly.
    Slots run from 0 without gaps. All ranks are summed over hash buckets, so no task orders a whole
    shard or a whole group of copies.

    Null text: size 8, an empty text's checksum, and linked with empty texts. Null ids and repeated
    rows: documents like others. Empty table: empty result. Fewer documents than shards: some
    shards stay empty. Other columns are not read.
    """
    text = text_of(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("text"), text).alias("g2"),
        ).withColumn("u", F.xxhash64(F.lit("row"), "id", "g1"))
    )
    total = rows.count()
    room = {s: total // shards + (s < total % shards) for s in range(shards)}

    start = rows.groupBy(*GROUP, F.pmod("u", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    linked = start.withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP))).where("all > 1").drop("all")
    state = propagate(materialize(linked), room)

    # which of a group's documents is in which shard: by rank in the group
    upto = F.sum("n").over(Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    homes = state.select(*GROUP, F.struct(upto.alias("upto"), "shard").alias("part")).groupBy(*GROUP).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    placed = materialize(rows.join(homes, GROUP, "left"))
    ranked = spread_rank(placed.where("parts IS NOT NULL"), GROUP, F.col("u"), ["id", "u"], "rank")
    in_shard = materialize(ranked.select("id", "size", "crc", "g1", "u", F.element_at(F.filter("parts", lambda p: p["upto"] >= F.col("rank")), 1)["shard"].alias("shard")))
    quota = F.element_at(F.array(*[F.lit(room[s]) for s in range(shards)]), F.col("shard") + 1)
    seated = materialize(spread_rank(in_shard, ["shard"], F.xxhash64("u"), ["id", "u", "g1"], "place").withColumn("stays", F.col("place") <= quota))
    held = {r.shard: r.n for r in seated.where("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # at most a row per shard

    pool = materialize(placed.where("parts IS NULL").select("id", "size", "crc", "u", "g1").union(seated.where("NOT stays").select("id", "size", "crc", "u", "g1")))
    ends, at = [], 0
    for s in range(shards):
        at += room[s] - held.get(s, 0)
        ends.append(at)
    fill = spread_rank(pool, [], F.xxhash64("u"), ["id", "u", "g1"], "place", buckets=4096)
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("place")))
    shift = F.element_at(F.array(*[F.lit(held.get(s, 0) - (ends[s - 1] if s else 0)) for s in range(shards)]), F.col("shard") + 1)
    fill = fill.withColumn("shard", to.cast("int")).withColumn("slot", F.col("place") + shift - 1)
    columns = [F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return seated.where("stays").withColumn("slot", F.col("place") - 1).select(*columns).unionByName(fill.select(*columns))
