"""The pipeline, stage by stage, against plain Python over the same rows."""

import collections
import math

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import WORD, components, ids_of, statistics
from tidemark.llm import quality, sql


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, each written and read again as a run would."""
    import tempfile

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tempfile.mkdtemp()}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.toPandas(), after.toPandas()
        docs = after
    return out


def kept_by_quality(docs):
    rows = [statistics(t) for t in docs.text]

    def vector(s):
        n, chars, symbols, dups, repeats, _ = s
        rates = [math.log((chars + 250) / (n + 50)), *(math.log1p(100 * c / (n + 50)) for c in (symbols, dups, repeats))]
        return [math.floor(1000 * v + 0.5) for v in rates]

    x = np.array([vector(s) for s in rows], dtype=float)
    groups = collections.defaultdict(list)
    for i, (lang, source) in enumerate(zip(docs.lang, docs.source)):
        if not rows[i][5]:
            groups[lang, source].append(i)
    for level in (lambda k: (k[0], "*"), lambda k: ("*", "*")):
        pooled = collections.defaultdict(list)
        for key, members in groups.items():
            pooled[key if len(members) >= 30 else level(key)] += members
        groups = pooled
    floors = np.array(quality.FLOORS)
    kept = {i for i, s in enumerate(rows) if not s[5]}
    for members in groups.values():
        if len(members) < 30:
            continue
        own = x[members] / 1000
        mean, cov = np.median(own, axis=0), np.diag(floors**2)
        for step in range(4):
            d2 = np.einsum("ij,jk,ik->i", own - mean, np.linalg.inv(cov), own - mean)
            near = np.floor(np.log2(1 + d2) * 64)
            cut = next(v for v in np.unique(near) if (near <= v).sum() >= 0.75 * len(members))
            inner = own[near <= cut]
            mean = inner.mean(axis=0)
            cov = np.cov(inner.T, bias=True) * (quality.consistency(0.75) if step == 3 else 1.0) + np.diag(floors**2)
        d2 = np.einsum("ij,jk,ik->i", own - mean, np.linalg.inv(cov), own - mean)
        kept -= {members[i] for i in np.flatnonzero(d2 > quality.chi2_quantile(1 - 1e-6))}
    return kept


def test_quality(stages):
    before, after = stages["filter_quality"]
    wanted = before.iloc[sorted(kept_by_quality(before))]
    assert 0 < len(after) < len(before)
    assert sorted(map(tuple, after.to_numpy())) == sorted(map(tuple, wanted[list(after.columns)].to_numpy()))


def test_lines(stages):
    before, after = stages["dedup_lines"]
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, text in zip(before.doc_id, before.text):
        for line in text.split("\n"):
            where[key(line)].add(i)
    drop = {k: max(v) for k, v in where.items() if len(k) >= 40 and len(v) >= 5}
    wanted = {i: "\n".join(x for x in text.split("\n") if drop.get(key(x), i) == i) for i, text in zip(before.doc_id, before.text)}
    assert dict(zip(after.doc_id, after.text)) == wanted and (after.n_chars == after.text.str.len()).all()


def test_near(stages):
    before, after = stages["dedup_near"]
    before = before.sort_values("doc_id").reset_index(drop=True)
    labels, _ = components(before.text, 5, 80)
    wanted = before[[labels[i] == i for i in range(len(before))]]
    assert sorted(after.doc_id) == sorted(wanted.doc_id) and len(after) < len(before)


def test_mix(stages):
    import duckdb

    before, after = stages["mix_sources"]
    con = duckdb.connect()
    con.register("documents", before)
    taken = con.execute(sql.OP4).df()
    texts = dict(zip(before.doc_id, before.text))
    written = collections.defaultdict(list)
    for i, text in zip(after.doc_id, after.text):
        written[i].append(text)
    for i, size, n in zip(taken.doc_id, taken["size"], taken.taken):
        found = written.pop(i, [])
        assert sum(len(WORD.findall(t)) for t in found) == n
        assert sum(t == texts[i] for t in found) == (n // size if size else 0)
        assert all(texts[i].startswith(t) for t in found)
    assert not written


def test_pack(stages):
    before, pieces = stages["pack_windows"]
    assert pieces.groupby("doc_id").length.sum().to_dict() == pd.Series([len(x) for x in ids_of(before.text)]).groupby(before.doc_id).sum().to_dict()
    sizes = pieces.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | ((sizes & (sizes - 1)) == 0)).all()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["pack_windows"][1])


def test_stages_take_edge_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names: each stage's result is defined."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    same, long = prose(60), prose(50_000)
    rows = [(1, same, "en", "a", 9), (1, same, "en", "a", 9), (None, same, "en", None, None), (None, prose(40), None, None, None), (None, None, "en", "a", None), (2, "", "en", "a", 0), (3, long, None, "b", 1), (4, prose(80), "de", None, 2), (4, prose(80), "de", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = df.select("*", *[clashing(c) for c in ("id", "label", "kept", "size", "bucket", "n", "mark", "tokens")])
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, clash if name == "filter_quality" else docs, SF)  # noqa: F821
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[:2] == [7, 7], "short and empty texts go, lines stay"
    assert sizes[2] == 4, "one row of the copies of id 1, one text of id 4"
    assert {r.doc_id for r in docs.collect()} == {None, 1, 3, 4}


def clashing(name):
    from pyspark.sql import functions as F

    return F.lit("x").alias(name)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == 0
