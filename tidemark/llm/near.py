"""MinHash near-dedup with tensored banding, verified on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, text_of

#: Ids that stand in for null ones start here.
STAND_IN = 1 << 62
BANDS = 2  # minhashes in a key of one collection


def collection_size(similarity: float, miss: float) -> int:
    """Keys of each of the two collections so that a pair at ``similarity`` shares no table with probability ``miss`` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - similarity**BANDS))


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes; words A-Z lower-cased, cut at ASCII white space."""

    def __init__(self, words: int, cache: int = 1 << 17) -> None:
        self.words, self.cache, self.known = words, cache, {}

    def __call__(self, text: str) -> np.ndarray:
        known, words = self.known, text.encode().lower().split()
        if len(known) > self.cache:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        ids = np.array([known[w] for w in words], dtype=np.uint64)
        k = min(self.words, len(ids))
        if not k:
            return ids
        out = np.full(len(ids) - k + 1, k, dtype=np.uint64)
        for i in range(k):  # mixed at each step, so that order matters
            out = (out ^ ids[i : len(ids) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def minhashes(shingles: np.ndarray, factors: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), block):
        least = np.minimum(least, (shingles[i : i + block] * factors[:, :1] + factors[:, 1:]).min(axis=1))
    return least


def signatures(docs: DataFrame, *, words: int, keys: int, seed: int = 7) -> DataFrame:
    """(doc_id, rid, mark, text) to (doc_id, rid, mark, n, d1, d2, a, b): size and digest of the shingle set, and both collections of ``keys`` keys.

    2 * keys * BANDS minhashes stand for keys * keys tables.
    """
    schema = "doc_id long, rid long, mark long, n long, d1 long, d2 long, a array<long>, b array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        factors = rng.integers(0, 2**64, (2 * keys * BANDS, 2), dtype=np.uint64)
        factors[:, 0] |= np.uint64(1)
        shingle = Shingler(words)
        for batch in batches:
            sizes, digests, sides = [], [], ([], [])
            for text in batch.column(3):
                s = shingle(text.as_py())
                sizes.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8"))
                least = minhashes(s, factors).reshape(2, keys, BANDS) if len(s) else np.zeros((2, 0, BANDS), np.uint64)
                mixed = least[:, :, 0]
                for i in range(1, BANDS):
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + least[:, :, i]
                for side, values in zip(sides, mixed.astype(np.int64), strict=True):
                    side.append(values)
            digests = np.array(digests, dtype=np.int64).reshape(-1, 2)
            lists = [pa.array(side, pa.list_(pa.int64())) for side in sides]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *lists], names=["doc_id", "rid", "mark", "n", "d1", "d2", "a", "b"])

    return docs.select("doc_id", "rid", "mark", "text").mapInArrow(run, schema)


def tables(nodes: DataFrame) -> DataFrame:
    """(node, n, key): a row for each pair of keys, one of each collection."""
    pairs = nodes.select("node", "n", F.posexplode("a").alias("i", "x"), "b").select("node", "n", "i", "x", F.posexplode("b").alias("j", "y"))
    return pairs.select("node", "n", F.xxhash64("i", "j", "x", "y").alias("key"))


def shingle_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(rid, shingles) of the needed documents, the set as bytes of sorted 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):  # sets are larger than texts: small batches of them
                part = batch.slice(i, 512)
                found = [shingle(text.as_py()).tobytes() for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["rid", "shingles"])

    return docs.join(small(needed), "rid", "left_semi").select("rid", "text").mapInArrow(sets, "rid long, shingles binary")


def confirm(pairs: DataFrame, docs: DataFrame, *, words: int, percent: int) -> DataFrame:
    """Those (x, y) whose full shingle sets meet 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
                hits.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(hits, pa.bool_()))

    needed = compact(pairs.select(F.explode(F.array("x", "y")).alias("rid")).distinct())
    full = materialize(shingle_sets(docs, needed, words))
    first, second = full.toDF("x", "s"), full.toDF("y", "t")
    return pairs.select("x", "y").join(first, "x").join(second, "y").select("x", "y", "s", "t").mapInArrow(compare, "x long, y long").distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, share, prefix) of sets (rid, shingles): the first shingles in the order of how many of the sets have them.

    Two sets of that similarity have a shingle in common among their first n - ceil(percent * n / 100) + 1.
    ``share`` is the mean logarithm of these counts: largest for a text that many others are copies of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            for i in range(0, len(found), 256):  # bounded batches, whatever the sets' sizes
                part = found[i : i + 256]
                nodes = np.repeat(batch.column(0).to_numpy()[i : i + 256], [len(s) for s in part])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(part))], names=["node", "token"])

    rows = sets.mapInArrow(run, "node long, token long")
    counted = rows.join(rows.groupBy("token").agg(F.count("*").alias("df")), "token")
    grouped = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"), F.avg(F.log("df")).alias("share"))
    n = F.size("tokens")
    first = F.slice("tokens", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return grouped.select("node", n.cast("long").alias("n"), "share", F.transform(first, lambda t: t["token"]).alias("prefix"))


def apart_pairs(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different labels that may link: prefix and positional filter over all of ``nodes``, exact.

    At the first shingle that two sets share, what they share is at most the shorter of what follows in each.
    Members whose position no class (size, position) of their token can match are settled before pairs are formed.
    """
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = materialize(named.select(F.posexplode("prefix").alias("pos", "token"), "node", "n", "label").select("token", "node", "n", "pos", "label"))

    def fits(n2, pos2):
        return (100 + percent) * F.least(F.col("n") - F.col("pos"), n2 - pos2) >= percent * (F.col("n") + n2)

    kinds = rows.groupBy("token", "n", "pos").agg(F.min("label").alias("low"), F.max("label").alias("high")).toDF("token2", "n2", "pos2", "low", "high")
    other = (F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))
    left = materialize(rows.join(kinds, (F.col("token") == F.col("token2")) & fits(F.col("n2"), F.col("pos2")) & other, "left_semi"))
    right = left.toDF(*[f"{c}2" for c in left.columns])
    met = left.join(right, (F.col("token") == F.col("token2")) & fits(F.col("n2"), F.col("pos2")) & (F.col("label") != F.col("label2")) & (F.col("node") < F.col("node2")))
    return met.select(F.col("node").alias("x"), F.col("node2").alias("y")).distinct()


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Materialized, in a partition per ``rows`` rows: small frames don't keep a task and a file for each shuffle partition."""
    done = materialize(df)
    return done.coalesce(max(1, min(done.rdd.getNumPartitions(), -(-done.count() // rows))))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge, label the smallest node it is connected with: alternating large and small stars, until a round changes nothing.

    That takes a number of rounds of the order of the squared logarithm of the nodes at most, whatever the components' shapes; chains of copies of copies
    are what takes most. A round is two joins on narrow rows and one checkpoint.
    """
    state, edges = None, compact(edges)
    parts = edges.rdd.getNumPartitions()
    while True:
        both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select("y", "x"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small_star = large.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        edges = materialize(small_star.union(low).where("x <> y").distinct().coalesce(parts))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    labels = edges.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return labels.union(edges.select("y", "y").distinct().coalesce(parts))


def rows_read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rid, mark, text): the id, a stand-in for null ids by their text, and the text with its hash."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    return read.withColumn("rid", F.coalesce("doc_id", F.pmod("mark", F.lit(1 << 61)) + F.lit(STAND_IN)))


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """(doc_id, rid, mark, n, label) of each row: its set's size and the smallest rid that it is connected with, its own if it has no words; see :func:`link`."""
    keys = collection_size(percent / 100, miss)
    read = rows_read(docs, id_col, text_col)
    sigs = materialize(signatures(read, words=words, keys=keys))
    sets = sigs.where("n > 0")
    nodes = materialize(sets.groupBy("d1", "d2").agg(F.min("rid").alias("node"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")))

    # who shares no key of the first collection is in no table with another
    singles = nodes.select("node", F.posexplode("a").alias("i", "x")).select("node", F.xxhash64("i", "x").alias("single"))
    shared = compact(singles.groupBy("single").agg(F.count("*").alias("members")).where("members > 1").select("single"))
    alive = compact(singles.join(small(shared), "single", "left_semi").select("node").distinct())
    rows = tables(nodes.join(small(alive), "node", "left_semi"))
    shared = compact(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"))
    members = compact(rows.join(small(shared), "key", "left_semi").select("key", "node", "n"))
    spark = docs.sparkSession
    links, tested, labels = spark.createDataFrame([], "x long, y long"), spark.createDataFrame([], "x long, y long"), spark.createDataFrame([], "node long, label long")
    apart = members.select("key", "node", "n", F.col("node").alias("label"), F.lit(0.0).alias("share"))
    for turn in ("any", "typical", "rest"):
        if turn == "rest":
            pairs = apart_pairs(ordered.join(apart.select("node").distinct(), "node", "left_semi"), labels, percent)
        else:
            pivots = compact(apart.groupBy("key").agg(F.max_by(F.struct("node", "n", "label"), F.struct("share", F.xxhash64("node"))).alias("p")))
            near_size = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
            met = apart.join(pivots, "key").where((F.col("label") != F.col("p.label")) & near_size)
            pairs = met.select(F.least("node", "p.node").alias("x"), F.greatest("node", "p.node").alias("y")).distinct()
        pairs = compact(pairs.join(tested, ["x", "y"], "left_anti") if turn != "any" else pairs)
        if not pairs.isEmpty():
            links = links.union(compact(confirm(pairs, read, words=words, percent=percent)))
            tested = tested.union(pairs)
            labels = compact(components(links))
        if turn == "rest":
            break
        named = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
        split = compact(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
        apart = compact(named.join(small(split), "key", "left_semi"))
        if apart.isEmpty():
            break
        if turn == "any":
            left = compact(apart.select(F.col("node").alias("rid")).distinct())
            ordered = compact(prefixes(materialize(shingle_sets(read, left, words)), percent))
        apart = compact(apart.join(ordered.select("node", "share"), "node", "left").select("key", "node", "n", "label", F.coalesce("share", F.lit(0.0)).alias("share")))

    homes = nodes.select("d1", "d2", "node").join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("node"))
    out = sigs.select("doc_id", "rid", "mark", "n", "d1", "d2").join(homes, ["d1", "d2"], "left")
    return out.select("doc_id", "rid", "mark", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("rid")).alias("label"))


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 times the intersection of their shingle sets is at least ``percent``
    times the union; a component's id is the smallest doc_id in it, and that document is kept. A
    document of fewer than ``words`` words is one shingle; one without words is linked with nothing.

    Equal sets are collapsed first. The others meet in tables whose keys combine one key of each of
    two collections of minhashes; a pair at the threshold is missed with probability ``miss``. A table
    is settled without emitting all its pairs: its members are compared with a pivot, and what that
    connects needs no comparisons among itself. Where members stay apart, the one whose shingles
    most others have, as a text has that others are copies of, is the next pivot. All that are apart still are joined exactly, by prefix and positional filters over their
    full sets, so every link between two components has been looked at.

    Null text: no words. Null ids: linked like others; component_id is null if no document with an
    id is in reach, and they are kept then, each of them (:func:`near_filter` keeps one row of a component). Rows that share an id are one document, linked by any of its
    texts. Empty table: empty result. Very long texts: one array of hashes in a task. Other columns are
    not read.
    """
    out = grouped(docs, id_col=id_col, text_col=text_col, words=words, percent=percent, miss=miss)
    component = F.when(F.col("label") < STAND_IN, F.col("label"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_filter(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component of :func:`link`, and all rows without words; all columns as they are.

    The row that stays has the smallest id of its component; null ids come after all others, in the
    order of their texts' hashes. Rows that share that id: the one whose text has the smallest hash, and
    of repeated rows any one. Null text: no words. Empty table: empty result. Extra columns pass through, whatever their names.
    """
    rows = materialize(grouped(docs, id_col=id_col, text_col=text_col, **options))
    own = rows.where((F.col("n") > 0) & (F.col("rid") == F.col("label"))).groupBy("rid", "mark").agg(F.count("*").alias("n"))
    least = own.groupBy("rid").agg(F.min_by(F.struct("mark", "n"), "mark").alias("k")).select("rid", "k.mark", F.col("k.n").alias("rows"))
    wordless = rows.where("n = 0").select("rid", "mark", F.lit(1).cast("long").alias("rows")).distinct()
    kept = materialize(least.unionByName(wordless).toDF("_tm_rid", "_tm_mark", "_tm_rows"))
    mark = F.xxhash64(text_of(text_col))
    rid = F.coalesce(F.col(id_col).cast("long"), F.pmod(mark, F.lit(1 << 61)) + F.lit(STAND_IN))
    met = lambda which: docs.join(kept.where(which), (rid == F.col("_tm_rid")) & (mark == F.col("_tm_mark")), "left_semi")
    out = met("_tm_rows = 1")
    repeated = kept.where("_tm_rows > 1")
    return out if repeated.isEmpty() else out.unionByName(met("_tm_rows > 1").dropDuplicates([id_col, text_col]))
