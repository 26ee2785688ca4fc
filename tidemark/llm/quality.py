"""Quality rules: fixed base rules, and robust multivariate outliers by language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_RUN, materialize, small, text_of, word_count

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Standard deviations below which no dimension's spread is trusted, in the order of ``vector``; small enough that each dimension alone can reject.
FLOORS = (0.04, 0.35, 0.5, 0.5)
DIMS = range(len(FLOORS))
SCALE = 1000  # statistics are kept as integers of 1/1000, so that sums are exact in any order
STEPS_PER_OCTAVE = 64
LEAST_FALL = 1e-6  # of a logarithm of a determinant
#: Rows that the estimate above a group counts for: five for each of the 4 means and 10 covariances that are estimated.
PRIOR_ROWS = 70.0
KEYS = ["lang_key", "source_key"]
MEANS, COVARIANCES, WEIGHTS = [f"m{i}" for i in DIMS], *([f"{c}{i}{j}" for i in DIMS for j in range(i + 1)] for c in "cw")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Replaces the column ``text`` (not null) by the base statistics.

    Words in repeated windows are found in steps, a column each: hashes of the words, of the windows,
    the windows in order of their hashes (only where two are equal), places of those that have a
    neighbour of the same hash, and the words that these places cover.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(WS))) > 0)
    words = docs.withColumns(
        {
            "n_words": word_count(text),
            "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_tm_lines": lines,
            "_tm_w": F.transform(F.split(F.btrim(text, F.lit(WS)), WS_RUN, -1), lambda w: F.xxhash64(w)),
        }
    ).drop("text")
    windows = F.transform(F.sequence(F.lit(1), F.size("_tm_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_tm_w", i, F.lit(WINDOW))))
    steps = words.withColumns({"n_dup_lines": (F.size("_tm_lines") - F.size(F.array_distinct("_tm_lines"))).cast("long"), "_tm_h": F.when(F.size("_tm_w") > WINDOW, windows)}).drop("_tm_lines", "_tm_w")
    ordered = F.sort_array(F.transform("_tm_h", lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    steps = steps.withColumn("_tm_p", F.when(F.size(F.array_distinct("_tm_h")) < F.size("_tm_h"), ordered)).drop("_tm_h")
    beside = lambda x, i: F.coalesce(F.get("_tm_p", i)["h"] == x["h"], F.lit(False))
    steps = steps.withColumn("_tm_i", F.sort_array(F.transform(F.filter("_tm_p", lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x["i"]))).drop("_tm_p")
    covered = F.transform("_tm_i", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_tm_i", i + 1) - p, F.lit(WINDOW))))
    return steps.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")).drop("_tm_i")


def vector() -> list[Column]:
    """Transformed statistics, in thousandths: logarithms of rates, with pseudo-counts so that short texts don't stand out."""
    rate = lambda c, n, more: F.log1p(100 * F.col(c) / (F.col(n) + more))
    dims = [
        F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        rate("n_symbols", "n_words", 50),
        rate("n_dup_lines", "n_words", 50),
        rate("n_repeat_words", "n_words", 50),
    ]
    return [F.round(d * SCALE).cast("long") for d in dims]


def chi2_quantile(p: float) -> float:
    """Quantile of chi-square with four degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        y = (low + high) / 4
        low, high = ((low + high) / 2, high) if 1 - math.exp(-y) * (1 + y) < p else (low, (low + high) / 2)
    return low


def consistency(share: float) -> float:
    """Factor by which the covariance of the ``share`` nearest points falls short under normality, four dimensions."""
    y = chi2_quantile(share) / 2
    return share / (1 - math.exp(-y) * (1 + y + y * y / 2))


def _whitener(params: DataFrame, factor: float = 1.0) -> DataFrame:
    """Adds, for ``factor`` times the covariance c00 .. c33 with the floors on its diagonal, the inverse of its Cholesky factor, w00 .. w33, and the logarithm of its determinant, ``logdet``."""
    for i in DIMS:
        for j in range(i + 1):
            entry = factor * F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            rest = entry - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            params = params.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in DIMS:
        for i in range(j, len(DIMS)):
            part = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            params = params.withColumn(f"w{i}{j}", part / F.col(f"l{i}{i}"))
    logdet = 2 * sum((F.log(f"l{i}{i}") for i in DIMS), F.lit(0.0))
    return params.withColumn("logdet", logdet).select(*KEYS, "start", *MEANS, *COVARIANCES, *WEIGHTS, "logdet")


def _distance2() -> Column:
    """Squared Mahalanobis distance, given the columns of a _whitener."""
    off = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in DIMS]
    return sum((F.pow(sum((F.col(f"w{i}{j}") * off[j] for j in range(i + 1)), F.lit(0.0)), 2) for i in DIMS), F.lit(0.0))


def _moments() -> tuple[dict[str, Column], dict[str, Column]]:
    """Means and covariances from n, s0 .. s3 and p00 .. p33: sums of integers, so they don't depend on the order of rows."""
    mean = lambda i: F.col(f"s{i}") / F.col("n") / SCALE
    return {f"m{i}": mean(i) for i in DIMS}, {f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") / SCALE**2 - mean(i) * mean(j) for i in DIMS for j in range(i + 1)}


def _starts(rows: DataFrame) -> DataFrame:
    """Three deterministic starts for each group: medians with the floors alone, medians with the spreads of the middle halves, and means with the whole covariance."""
    half = lambda i, at: F.element_at(f"q{i}", at) / SCALE
    n, sums = F.count("*"), [F.sum(f"x{i}").alias(f"s{i}") for i in DIMS]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in DIMS for j in range(i + 1)]
    seen = rows.groupBy(*KEYS).agg(*[F.percentile(f"x{i}", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias(f"q{i}") for i in DIMS], n.alias("n"), *sums, *products)
    medians = {f"m{i}": half(i, 2) for i in DIMS}
    diagonal = lambda entry: {f"c{i}{j}": entry(i) if i == j else F.lit(0.0) for i in DIMS for j in range(i + 1)}
    flat = diagonal(lambda i: F.lit(0.0))
    spread = diagonal(lambda i: F.pow((half(i, 3) - half(i, 1)) / 1.349, 2))  # the middle half of a normal distribution is 1.349 deviations wide
    each = [(medians, flat), (medians, spread), _moments()]
    made = [seen.select(*KEYS, F.lit(n).alias("start"), *[c.alias(k) for k, c in (means | covariances).items()]) for n, (means, covariances) in enumerate(each)]
    return _whitener(made[0].unionByName(made[1]).unionByName(made[2]))


def _concentrate(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """A concentration step of every start: mean and covariance of the ``share`` of its group's rows nearest in Mahalanobis distance.

    Distances are cut into fine logarithmic steps; a step's counts and sums are aggregated, and the nearest rows'
    sums are running sums over these: one pass over the rows, no order of a group's rows.
    """
    keys = [*KEYS, "start"]
    sums = {f"s{i}": F.col(f"x{i}") for i in DIMS} | {f"p{i}{j}": F.col(f"x{i}") * F.col(f"x{j}") for i in DIMS for j in range(i + 1)}
    near = F.floor(F.log2(1 + _distance2()) * STEPS_PER_OCTAVE).cast("int")
    cut = rows.join(small(params), KEYS).groupBy(*keys, near.alias("near")).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    upto = Window.partitionBy(*keys).orderBy("near").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*keys))
    runs = cut.select(*keys, "near", total.alias("all"), *[F.sum(k).over(upto).alias(k) for k in ("n", *sums)])
    best = runs.where(F.col("n") >= share * F.col("all")).groupBy(*keys).agg(F.min_by(F.struct("n", *sums), "near").alias("t")).select(*keys, "t.*")
    means, covariances = _moments()
    return _whitener(best.withColumns(means | covariances))


def robust(rows: DataFrame, *, share: float = 0.75, trial_steps: int = 2) -> DataFrame:
    """Minimum-covariance-determinant location m0 .. m3 and covariance c00 .. c33 (consistent, without floors) of x0 .. x3 and number of rows n for each (lang_key, source_key).

    ``trial_steps`` concentration steps from each of the starts; of each group the start whose determinant is least
    then goes on until no group's determinant falls any more. The floors are part of every covariance, so
    determinants are those that distances are measured with, and none is 0. A step is one pass over the rows, and a row
    a group and start is all that is kept of it.
    """
    params = _starts(rows)
    for _ in range(trial_steps):
        params = materialize(_concentrate(rows, materialize(params), share))
    best = materialize(params.groupBy(*KEYS).agg(F.min_by(F.struct("start", *MEANS, *COVARIANCES, *WEIGHTS, "logdet"), F.struct("logdet", "start")).alias("b")).select(*KEYS, "b.*"))
    while True:
        before = best.select(*KEYS, F.col("logdet").alias("_before"))
        after = materialize(_concentrate(rows, best, share).join(small(before), KEYS))
        falls = F.col("logdet") < F.col("_before") - LEAST_FALL
        if after.where(falls).isEmpty():
            break
        stay = after.where(~falls).select(*KEYS)
        best = materialize(after.where(falls).drop("_before").unionByName(best.join(small(materialize(stay)), KEYS, "left_semi")))
    factor = consistency(share)
    return materialize(rows.groupBy(*KEYS).agg(F.count("*").alias("n")).join(best, KEYS).select(*KEYS, "n", *MEANS, *[(factor * F.col(c)).alias(c) for c in COVARIANCES]))


def _weights(estimates: DataFrame) -> DataFrame:
    return materialize(_whitener(estimates.withColumn("start", F.lit(0))).drop("start", "logdet", *COVARIANCES))


def estimate(rows: DataFrame, *, share: float = 0.75, trial_steps: int = 2) -> DataFrame:
    """Location and whitener of :func:`robust` for each (lang_key, source_key)."""
    return _weights(robust(rows, share=share, trial_steps=trial_steps))


def estimate_shrunk(rows: DataFrame, *, prior_rows: float, share: float = 0.75, trial_steps: int = 2) -> DataFrame:
    """As :func:`estimate`, each group's location and covariance drawn towards its language's, and a language's towards that of all rows.

    What is above counts as ``prior_rows`` rows: n rows of a group weigh n / (n + prior_rows). So a group of any size has an estimate, and
    none changes by a step as rows come in. Every row counts for three groups, its own, its language and the whole, in the same passes.
    """
    star = F.lit("*")  # no key: those begin with = or are empty
    groups = F.array(*[F.struct(lang.alias("lang_key"), source.alias("source_key")) for lang, source in ((star, star), (F.col("lang_key"), star), (F.col("lang_key"), F.col("source_key")))])
    xs = [f"x{i}" for i in DIMS]
    levels = robust(rows.select(F.explode(groups).alias("g"), *xs).select("g.*", *xs), share=share, trial_steps=trial_steps)
    own = F.col("n") / (F.col("n") + prior_rows)
    whole = levels.where("lang_key = '*'").first()  # one row, or none of an empty table
    if whole is None:
        return _weights(levels)
    blend = lambda above: [(own * F.col(c) + (1 - own) * above(c)).alias(c) for c in (*MEANS, *COVARIANCES)]
    languages = levels.where("lang_key <> '*' AND source_key = '*'").select("lang_key", *blend(lambda c: F.lit(whole[c])))
    languages = languages.withColumnsRenamed({c: f"_tm_{c}" for c in (*MEANS, *COVARIANCES)})
    return _weights(levels.where("source_key <> '*'").join(small(materialize(languages)), "lang_key").select(*KEYS, *blend(lambda c: F.col(f"_tm_{c}"))))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 20, max_repeat: int = 30, prior_rows: float = PRIOR_ROWS, tail: float = 1e-6) -> DataFrame:
    """One row per document: id, mark (hash of its text, language and source), the base statistics, base_failed, distance2, kept.

    A document fails the base rules with fewer than ``min_words`` words or more than ``max_repeat``
    percent of them in repeated windows. The others are held against the robust estimate of their
    language and source, and go if their squared distance is beyond the chi-square quantile of
    1 - ``tail``. Estimates are drawn towards those of the language and of all documents, as if these had
    ``prior_rows`` more rows in the group, so groups of every size, also of one document, are judged alike.

    Null text: empty, so it fails. Null language or source: a group of its own. Null ids and repeated
    rows: documents like others. Empty table: empty result.
    """
    text = text_of(text_col)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    read = with_statistics(docs.select(F.col(id_col).alias("id"), _mark(text_col, lang_col, source_col).alias("mark"), key(lang_col).alias("lang_key"), key(source_col).alias("source_key"), text.alias("text")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    stats = materialize(read.select("*", failed.alias("base_failed"), *[c.alias(f"x{i}") for i, c in enumerate(vector())]))

    params = estimate_shrunk(stats.where("NOT base_failed"), prior_rows=prior_rows)
    judged = stats.join(small(params), KEYS, "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance2()))
    return judged.select("id", "mark", *STATISTICS, "base_failed", "distance2", (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= chi2_quantile(1 - tail))).alias("kept"))


def _mark(text_col: str, lang_col: str, source_col: str) -> Column:
    """Hash of all that a verdict depends on."""
    return F.xxhash64(text_of(text_col), F.struct(lang_col, source_col))


def quality_filter(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """Rows of ``docs`` that :func:`judge` keeps, all columns as they are.

    Rows that are equal in id and text but not in language or source are judged each on their own; rows equal in all four
    stay or go together. Nulls, empty texts and an empty table: as in :func:`judge`. Extra columns pass through, whatever their names.
    """
    judged = judge(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, **options)
    kept = judged.where("kept").select(F.col("id").alias("_tm_id"), F.col("mark").alias("_tm_mark"))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_tm_id")) & (_mark(text_col, lang_col, source_col) == F.col("_tm_mark")), "left_semi")
