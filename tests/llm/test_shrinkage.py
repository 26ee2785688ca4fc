"""Quality rules over groups of all sizes: verdicts against a plain model of starts, stopping and shrinking."""

import collections

import numpy as np
import pytest

from tests.llm.test_operators import statistics
from tidemark.llm import quality

FLOORS, CUT = np.diag(np.array(quality.FLOORS) ** 2), quality.chi2_quantile(1 - 1e-6)


def vectors(rows):
    out = []
    for n, chars, symbols, dups, repeats, _ in rows:
        rates = [np.log((chars + 250) / (n + 50)), *(np.log1p(100 * c / (n + 50)) for c in (symbols, dups, repeats))]
        out.append([np.floor(1000 * v + 0.5) / 1000 for v in rates])
    return np.array(out)


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + FLOORS), x - mean)


def concentrated(x, mean, cov):
    near = np.floor(np.log2(1 + distances(x, mean, cov)) * 64)
    inner = x[near <= next(v for v in np.unique(near) if (near <= v).sum() >= 0.75 * len(x))]
    mean = inner.mean(axis=0)
    cov = (inner - mean).T @ (inner - mean) / len(inner)
    return mean, cov, np.linalg.slogdet(cov + FLOORS)[1]


def determinant(x):
    """Location and consistent covariance: two steps from three starts, the best of them until its determinant doesn't fall."""
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    mean = x.mean(axis=0)
    starts = [(middle, np.zeros((4, 4))), (middle, np.diag(((high - low) / 1.349) ** 2)), (mean, (x - mean).T @ (x - mean) / len(x))]
    tried = []
    for i, (m, c) in enumerate(starts):
        for _ in range(2):
            m, c, logdet = concentrated(x, m, c)
        tried.append((logdet, i, m, c))
    logdet, _, m, c = min(tried, key=lambda t: t[:2])
    while True:
        after = concentrated(x, m, c)
        if after[2] >= logdet - 1e-6:
            return m, c * quality.consistency(0.75)
        m, c, logdet = after


def model(docs):
    """Squared distance by place in ``docs``, for those that pass the base rules."""
    rows = [statistics(t) for t in docs.text]
    x = vectors(rows)
    groups = collections.defaultdict(list)
    for i, (lang, source) in enumerate(zip(docs.lang, docs.source)):
        if not rows[i][5]:
            for key in ((), (lang,), (lang, source)):
                groups[key].append(i)
    out, found = {}, {}
    for key in sorted(groups, key=len):
        m, c = determinant(x[groups[key]])
        if key:
            own = len(groups[key]) / (len(groups[key]) + quality.PRIOR_ROWS)
            m, c = (own * a + (1 - own) * b for a, b in zip((m, c), found[key[:-1]]))
        found[key] = m, c
        if len(key) == 2:
            out |= dict(zip(groups[key], distances(x[groups[key]], m, c)))
    return out


def test_verdicts_of_small_groups_follow_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r for r in quality.judge(docs).collect()}
    plain = docs.toPandas()
    wanted = {int(plain.doc_id[i]): d for i, d in model(plain).items()}
    assert {i for i, r in got.items() if not r.base_failed} == set(wanted)
    assert plain.groupby(["lang", "source"]).size().min() < 5, "groups of a few documents are what this is about"
    assert {i for i, r in got.items() if r.kept} == {i for i, d in wanted.items() if d <= CUT}
    assert all(got[i].distance2 == pytest.approx(d, rel=0.02, abs=0.02) for i, d in wanted.items())


def text(rng, n=120, symbols=0):
    """Words that hardly repeat, each followed by so many symbols."""
    return " ".join(f"{rng.choice(list('abcdefgh'))}{x}" + "$" * symbols for x in rng.integers(0, 5000, n))


def test_no_group_is_too_small_and_no_size_is_a_step(spark):
    """A document far from all others goes though it is alone in its source; verdicts of 29, 30 and 31 documents are alike."""
    rng = np.random.default_rng(5)
    rows = [(i, text(rng), "en", "a") for i in range(200)]
    rows += [(1000, text(rng, symbols=9), "en", "alone"), (1001, text(rng), "en", "other"), (1002, text(rng, symbols=9), "xx", "alone"), (1003, text(rng), None, None)]
    far, normal = text(rng, symbols=9), [text(rng) for _ in range(30)]
    for size in (29, 30, 31):
        rows += [(size * 10_000 + i, t, "en", f"s{size}") for i, t in enumerate([far, *normal[: size - 1]])]
    schema = "doc_id long, text string, lang string, source string"
    got = {r.id: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[1000].kept and not got[1002].kept and got[1001].kept and got[1003].kept
    assert all(r.distance2 is not None for r in got.values())
    of_far = [got[size * 10_000].distance2 for size in (29, 30, 31)]
    assert not any(got[size * 10_000].kept for size in (29, 30, 31)) and max(of_far) < 1.1 * min(of_far)
    assert all(got[size * 10_000 + i].kept for size in (29, 30, 31) for i in range(1, size))


def test_tables_of_one_row_and_of_none(spark):
    schema = "doc_id long, text string, lang string, source string"
    one = [(1, text(np.random.default_rng(1)), None, "a")]
    assert [r.kept for r in quality.judge(spark.createDataFrame(one, schema)).collect()] == [True]
    assert quality.judge(spark.createDataFrame([], schema)).count() == 0
