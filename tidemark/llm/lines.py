"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, bind, lower_ascii, materialize, small, text_of

ID, MARK, POS, H1, H2, KEEP, DROPS, COUNT = "_tm_id", "_tm_mark", "_tm_pos", "_tm_h1", "_tm_h2", "_tm_keep", "_tm_drops", "_tm_count"


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return lower_ascii(F.btrim(line, F.lit(WS)))


def _hashes(key):
    """128 bits: two chained 64-bit hashes with different seeds."""
    return F.xxhash64(key).alias(H1), F.xxhash64(F.lit("line"), key).alias(H2)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with lines found in ``min_docs`` documents or more removed from all but the largest id.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys shorter than
    ``min_chars`` are never dropped. Adds ``n_lines`` (before) and ``n_dropped``; columns of these
    names are replaced, all others pass through.

    Null or empty text: one empty line, which stays, so the text becomes empty. Null id: a document
    like any other, but never the one that keeps a line. Repeated rows: each row counts as a document,
    and rows that share the largest id all keep their lines. Empty table: empty result.

    Two narrow shuffles of hashes (counted after partial aggregation, so a line of a third of all
    documents is one row per task) and one of the texts. The common lines are broadcast if they are few;
    else both sides of the join back are plain exchanges, whose hot keys adaptive execution splits.
    """
    text = text_of(text_col)
    # who a row is, also where ids repeat: the id and a hash of its text
    keyed = docs.select(F.col(id_col).alias(ID), F.xxhash64(text).alias(MARK), _lines(text).alias("lines"))
    per_doc = keyed.select(ID, F.explode(F.array_distinct(F.filter(F.transform("lines", _key), lambda k: F.length(k) >= min_chars))).alias("key"))
    counted = per_doc.select(ID, *_hashes(F.col("key"))).groupBy(H1, H2).agg(F.count("*").alias(COUNT), F.max(ID).alias(KEEP))
    common = materialize(counted.where(F.col(COUNT) >= min_docs).select(H1, H2, KEEP))

    at = keyed.select(ID, MARK, F.posexplode("lines").alias(POS, "line")).select(ID, MARK, POS, _key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    drops = (
        at.select(ID, MARK, POS, *_hashes(F.col("key")))
        .join(small(common), [H1, H2])
        .where(~F.col(ID).eqNullSafe(F.col(KEEP)))
        .groupBy(ID, MARK)
        .agg(F.array_sort(F.collect_set(POS)).alias(DROPS))
    )

    # kept lines are the slices between dropped positions: linear in the lines
    def rest(lines):
        ends = F.concat(F.col(DROPS), F.array(F.size(lines)))
        starts = F.concat(F.array(F.lit(0)), F.transform(DROPS, lambda p: p + 1))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    marked = docs.withColumn(MARK, F.xxhash64(text))
    joined = marked.join(drops.withColumnRenamed(MARK, "_tm_mark2"), (F.col(MARK) == F.col("_tm_mark2")) & F.col(id_col).eqNullSafe(F.col(ID)), "left")
    return joined.withColumns(
        {
            "n_lines": F.size(_lines(text)).cast("long"),
            "n_dropped": F.when(F.col(DROPS).isNull(), 0).otherwise(F.size(DROPS)).cast("long"),
            text_col: F.when(F.col(DROPS).isNull(), text).otherwise(bind(_lines(text), rest)),
        }
    ).drop(ID, MARK, "_tm_mark2", DROPS)
