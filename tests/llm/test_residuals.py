"""What combinations leave over is packed greedily, and rows are judged by all that their verdict depends on."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import mixing, packing, quality


def test_greedy_windows_use_every_length_and_fill_or_cut(spark):
    rng = np.random.default_rng(4)
    for size in (1, 7, 300, 5000):
        lengths = np.bincount(np.minimum(2047, rng.lognormal(5.5, 1.2, size).astype(int) + 1), minlength=2049)
        greedy = packing.first_fit(lengths.tolist(), 2048)
        used = np.zeros(2049, int)
        for w in greedy:
            assert sum(w.docs) <= 2048 and w.uses > 0
            for n in w.docs:
                used[n] += w.uses
        assert (used == lengths).all()
        done = packing.filled(greedy, 2048)
        whole, pieces = np.zeros(2049, int), np.zeros(2049, int)
        for w in done:
            assert sum(w.docs) + sum(w.pieces) == 2048
            for n in w.docs:
                whole[n] += w.uses
            for n in w.pieces:
                pieces[n] += w.uses
        supply = np.zeros(2049, int)
        for n in np.nonzero(lengths - whole)[0]:
            for bit in packing.bit_sizes(int(n)):
                supply[bit] += (lengths - whole)[n]
        assert (whole <= lengths).all() and (pieces <= supply).all()
        if size == 5000:
            assert (lengths - whole).sum() < 0.1 * size


def test_few_documents_are_cut(spark):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    short = rows[rows.length < 2048]
    n_cut = (short.groupby("doc_id").size() > 1).sum()
    assert n_cut < 0.2 * rows.doc_id.nunique()
    sizes = rows.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | ((sizes & (sizes - 1)) == 0)).all()


def test_rows_of_other_languages_and_sources_are_judged_on_their_own(spark):
    plain = pd.read_parquet(f"{SF}/documents.parquet")
    own = plain[(plain.lang == "en")]
    text = " ".join(f"word{i} #" for i in range(60))
    rows = [(int(i), t, lang, s) for i, t, lang, s in zip(plain.doc_id, plain.text, plain.lang, plain.source)]
    # texts full of signs are usual in one source and not in the other
    rows += [(10_000 + i, " ".join(f"w{i}x{j} #" for j in range(60)), "en", "signs") for i in range(60)]
    rows += [(5000, text, "en", "signs"), (5000, text, "en", own.source.iloc[0]), (5000, text, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdicts = sorted(r.kept for r in quality.judge(docs).where("id = 5000").collect())
    kept = quality.quality_filter(docs).where("doc_id = 5000").collect()
    assert verdicts.count(True) == len(kept)
    assert ("en", "signs") in {(r.lang, r.source) for r in kept} and ("en", own.source.iloc[0]) not in {(r.lang, r.source) for r in kept}
    assert quality.quality_filter(docs.withColumn("mark", F.lit(1))).columns == ["doc_id", "text", "lang", "source", "mark"]


def test_mixing_rows_that_differ_in_source_alone(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text, source) for source in ("a", "b", "c", None, "a")] + [(None, text, "a"), (None, text, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {(r.source,): r.n for r in mixing.decide(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    mixed = mixing.mix(docs).withColumn("n", F.size(F.split("text", " "))).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {(r.source,): r.n for r in mixed} == {k: n for k, n in taken.items() if n}
    assert {r.source for r in mixed} >= {"a", "b", "c"}
