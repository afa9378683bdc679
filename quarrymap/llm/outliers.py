"""Quality rules by robust multivariate outliers.

Every text gives counts; a transformed vector of them is compared with the minimum-covariance-determinant estimate of its
group, the rows of one language and source that pass the base rules. The estimate starts three times: from medians and
absolute deviations, from the classical covariance, and from the covariance of directions. Concentration steps follow until
they settle: each keeps the ``SUBSET`` share of a group's rows with the smallest Mahalanobis distances and takes their mean
and covariance. The start that ends with the smallest determinant counts. Its covariance is multiplied by the consistency
factor of its share, and distances are scaled, as usual for small samples, so that their median is that of chi-squared.

All rows count at every step. Quantiles are taken from counts in fixed bins, so they don't depend on how rows are dealt, and
groups are only ever aggregated, so none meets in one task. Most texts have none of some counts; where the bulk of a group
doesn't differ at all there is no covariance to estimate. Every covariance is therefore taken plus that of ``FLOORS``, as the
regularised estimator does, with which steps never raise the determinant. In the directions in which texts do differ the
floors lie far below their spread. Groups with fewer than ``LEAST`` rows, ten for each dimension, use the estimate of all rows.

Null and empty texts have no words and fail the base rule. Null languages and sources are groups of their own. Repeated rows
are judged alike and counted as often as they come; ties at a limit are all kept. Whole texts are read, however long. An empty
table gives an empty one. Other columns pass through, those of the result's names are replaced; helper columns begin with
``_qm_``, names that a table must not have.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import with_python
from quarrymap.session import bounded, checkpointed, table

LEAST_WORDS, MOST_REPEATED = 20, 0.30
WINDOW = 8
#: Standard deviations added everywhere: log words, characters a word, symbol rate, repeated lines, repeated words.
FLOORS = [0.05, 0.02, 0.05, 0.25, 0.15]
N = len(FLOORS)
LEAST, SUBSET = 10 * N, 0.75
#: Steps until which all starts have settled, or are taken as they are; fall of the log determinant that counts as none.
STEPS, SETTLED = 30, 1e-4
#: Bins of distances for each doubling, and the range of their numbers.
BINS, RANGE = 16, 400
#: Share of the rows of a clean group that may be beyond the cut-off.
FALSE_ALARMS = 1e-6
#: Groups that are broadcast at most, at 200 bytes and three starts each; parts into which each group's rows are dealt beyond that.
FEW_GROUPS, SALTS = 20_000, 64
#: Tasks for tables with a row for each group.
GROUP_TASKS = 16

_SPLIT = re.compile(r"[^ \t-\r]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = _SPLIT.findall(text)
    lines = [x for x in text.split("\n") if _SPLIT.search(x)]
    repeated = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


_STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _statistics(texts):
    return [list(x) for x in zip(*map(statistics, texts), strict=True)]


def chi2_cdf(x: float, k: int) -> float:
    """The share of chi-squared with k degrees of freedom up to x."""
    if x <= 0:
        return 0.0
    if k % 2 == 0:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    return math.erf(math.sqrt(x / 2)) - math.exp(-x / 2) * sum((x / 2) ** (i + 0.5) / math.gamma(i + 1.5) for i in range(k // 2))


def chi2_quantile(share: float, k: int) -> float:
    """Where chi-squared with k degrees of freedom reaches a share."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        at = (low + high) / 2
        low, high = (at, high) if chi2_cdf(at, k) < share else (low, at)
    return high


#: Squared distance beyond which a row is an outlier.
CUTOFF = chi2_quantile(1 - FALSE_ALARMS, N)


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words"),
        F.col("word_chars") / words,
        F.log1p(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_dup_lines") + 4)),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


_UPPER = np.triu_indices(N)
X = [f"_qm_x{i}" for i in range(N)]


def _square(upper) -> np.ndarray:
    m = np.zeros((N, N))
    m[_UPPER] = upper
    return m + np.triu(m, 1).T


def inverted(covariance: np.ndarray) -> tuple[list[float], float]:
    """The upper half of the inverse of a covariance plus the floors', and the log determinant of their sum."""
    whole = covariance + np.diag(np.square(FLOORS))
    return np.linalg.inv(whole)[_UPPER].tolist(), float(np.linalg.slogdet(whole)[1])


def consistent(covariance: np.ndarray, share: float) -> tuple[np.ndarray, int]:
    """The covariance of the ``share`` of rows that are nearest, as that of all rows; and the directions that the floors don't rule."""
    rank = int((np.linalg.eigvalsh(covariance / np.outer(FLOORS, FLOORS)) > 1).sum())
    if not rank or share >= 1:
        return covariance, rank
    return covariance * share / chi2_cdf(chi2_quantile(share, rank), rank + 2), rank


def _first_estimates(medians, deviations, n, sums, squares, signs):
    """(mean, inverse, det) of the three starts of each group."""
    out = []
    for m, dev, k, s, q, g in zip(medians, deviations, n, sums, squares, signs, strict=True):
        m, scale = np.array(m), np.maximum(1.4826 * np.array(dev), FLOORS)
        off = np.array(s) / k
        classical = _square(q) / k - np.outer(off, off)
        starts = [(m, np.diag(np.square(1.4826 * np.array(dev)))), (m + off, classical), (m, N * _square(g) / k * np.outer(scale, scale))]
        out.append([(i, centre.tolist(), *inverted(c)) for i, (centre, c) in enumerate(starts)])
    return [out]


def _next_estimates(means, dets, n, every, sums, squares, first):
    """(mean, inverse, covariance, share, det, settled) after a step, of sums around the means before it."""
    out = []
    for m, det, k, total, s, q in zip(means, dets, n, every, sums, squares, strict=True):
        off = np.array(s) / k
        covariance = _square(q) / k - np.outer(off, off)
        inverse, now = inverted(covariance)
        out.append(((np.array(m) + off).tolist(), inverse, covariance[_UPPER].tolist(), k / total, now, not first and det - now < SETTLED))
    return [list(x) for x in zip(*out, strict=True)] if out else [[] for _ in range(6)]


def _last_estimates(covariances, shares):
    out = [(inverted(c)[0], r) for c, r in (consistent(_square(c), s) for c, s in zip(covariances, shares, strict=True))]
    return [[i for i, _ in out], [r for _, r in out]]


_ARRAY = T.ArrayType(T.DoubleType())
_START = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("mean", _ARRAY), T.StructField("inverse", _ARRAY), T.StructField("det", T.DoubleType())]))
_STEP = [T.StructField("mean", _ARRAY), T.StructField("inverse", _ARRAY), T.StructField("covariance", _ARRAY), T.StructField("share", T.DoubleType()), T.StructField("det", T.DoubleType()), T.StructField("settled", T.BooleanType())]


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of a vector to its group's mean."""
    d = [F.col(x) - F.col(mean)[i] for i, x in enumerate(X)]
    pairs = zip(*(u.tolist() for u in _UPPER), strict=True)
    return sum((F.col(inverse)[at] * d[i] * d[j] * (1 if i == j else 2) for at, (i, j) in enumerate(pairs)), F.lit(0.0))


def _bin(value: Column) -> Column:
    """The number of the bin of a value that isn't negative."""
    return F.least(F.greatest(F.coalesce(F.floor(F.log2(value) * BINS), F.lit(-RANGE)), F.lit(-RANGE)), F.lit(RANGE)).cast("int")


def _outer(values: list[Column]) -> Column:
    return F.array(*(F.sum(values[i] * values[j]) for i, j in zip(*(u.tolist() for u in _UPPER), strict=True)))


class _Groups:
    """Vectors with their groups, and joins of group tables to them that no group's size can skew.

    Few groups are broadcast. More of them are joined by group and salt; each group's rows have all salts, by their place.
    """

    def __init__(self, numbers: DataFrame, by: list[str], few: bool):
        self.by, self.few = by, few
        self.rows = numbers if few else numbers.withColumn("_qm_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))

    def with_(self, groups: DataFrame) -> DataFrame:
        if self.few:
            return self.rows.join(F.broadcast(groups), self.by)
        salted = groups.withColumn("_qm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        return self.rows.join(salted, [*self.by, "_qm_salt"]).drop("_qm_salt")

    def middles(self, binned: DataFrame, key: list[str], share: float) -> DataFrame:
        """(group, key.., bin, n) of the bin at which counts by group and key reach a share of all; ``binned`` has a column bin."""
        counts = binned.groupBy(*self.by, *key, "bin").agg(F.count(F.lit(1)).alias("n"))
        each = Window.partitionBy(*self.by, *key)  # no more rows than there are bins
        upto = counts.withColumns({"upto": F.sum("n").over(each.orderBy("bin")), "every": F.sum("n").over(each)})
        return upto.where(F.col("upto") >= share * F.col("every")).groupBy(*self.by, *key).agg(F.min("bin").alias("bin"), F.first("every").alias("n"))

    def medians(self, values: list[Column], of: DataFrame) -> DataFrame:
        """(group, array of medians) of values from 0 on, as the middle of their bins of the logarithm."""
        each = of.select(*self.by, F.posexplode(F.array(*(F.floor(F.log1p(v) * 64).cast("int") for v in values))).alias("pos", "bin"))
        found = self.middles(each, ["pos"], 0.5).withColumn("value", F.when(F.col("bin") == 0, 0.0).otherwise(F.expm1((F.col("bin") + 0.5) / 64)))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))  # one for each dimension
        return found.groupBy(*self.by).agg(F.transform(ordered, lambda v: v["value"]).alias("middle"))


def estimates(numbers: DataFrame, by: list[str], few: bool) -> DataFrame:
    """(mean, inverse, scale, rank) of every group of the vectors: minimum covariance determinant by concentration steps."""
    groups = _Groups(numbers, by, few)
    small = lambda df: checkpointed(df.coalesce(GROUP_TASKS) if few else df)
    medians = small(groups.medians([F.col(x) for x in X], groups.rows).withColumnRenamed("middle", "median"))
    away = groups.with_(medians)
    deviations = groups.medians([F.abs(F.col(x) - F.col("median")[i]) for i, x in enumerate(X)], away).withColumnRenamed("middle", "deviation")
    known = small(medians.join(deviations, by))
    off = [F.col(x) - F.col("median")[i] for i, x in enumerate(X)]
    scaled = [o / F.greatest(F.lit(1.4826) * F.col("deviation")[i], F.lit(FLOORS[i])) for i, o in enumerate(off)]
    length = F.sqrt(sum((u * u for u in scaled), F.lit(0.0)))
    signs = [F.when(length > 0, u / length).otherwise(0.0) for u in scaled]
    sums = groups.with_(known).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.sum, off)).alias("sums"), _outer(off).alias("squares"), _outer(signs).alias("signs"))
    made = with_python(known.join(sums, by), _first_estimates, ["median", "deviation", "n", "sums", "squares", "signs"], [T.StructField("starts", _START)], drop=["median", "deviation", "n", "sums", "squares", "signs"])
    now = small(made.select(*by, F.explode("starts").alias("s")).select(*by, "s.*"))
    settled: list[DataFrame] = []
    for step in range(STEPS):
        off = [F.col(x) - F.col("mean")[i] for i, x in enumerate(X)]
        far = groups.with_(now.select(*by, "start", "mean", "inverse")).withColumn("bin", _bin(_distance()))
        counted = far.groupBy(*by, "start", "bin").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.sum, off)).alias("sums"), _outer(off).alias("squares"))
        each = Window.partitionBy(*by, "start")  # no more rows than there are bins
        before = F.coalesce(F.sum("n").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = counted.withColumns({"before": before, "every": F.sum("n").over(each)}).where(F.col("before") < F.ceil(SUBSET * F.col("every")))
        total = lambda c, k: F.array(*(F.sum(F.col(c)[i]) for i in range(k)))
        taken = near.groupBy(*by, "start").agg(F.sum("n").alias("n"), F.first("every").alias("every"), total("sums", N).alias("sums"), total("squares", N * (N + 1) // 2).alias("squares"))
        both = now.select(*by, "start", "mean", "det").join(taken, [*by, "start"])
        stepped = small(with_python(both, partial(_next_estimates, first=step == 0), ["mean", "det", "n", "every", "sums", "squares"], _STEP, drop=["n", "every", "sums", "squares"]))
        last = step == STEPS - 1
        settled.append(stepped if last else stepped.where("settled"))
        now = stepped.where("not settled")
        if last or now.isEmpty():
            break
    ended = settled[0]
    for more in settled[1:]:
        ended = ended.unionByName(more)
    best = ended.groupBy(*by).agg(F.min(F.struct(F.round("det", 6).alias("det"), "start", "mean", "covariance", "share")).alias("best"))
    chosen = with_python(best.select(*by, "best.mean", "best.covariance", "best.share"), _last_estimates, ["covariance", "share"], [T.StructField("inverse", _ARRAY), T.StructField("rank", T.IntegerType())], drop=["covariance", "share"])
    chosen = small(chosen)
    middle = groups.middles(groups.with_(chosen).select(*by, _bin(_distance()).alias("bin")), [], 0.5)
    # Where half of the rows are in one place, or the floors rule every direction, distances are taken as they are.
    of_rank = F.array(*(F.lit(chi2_quantile(0.5, k)) for k in range(1, N + 1)))
    scale = F.when((F.col("rank") > 0) & (F.col("bin") > -RANGE), F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS) / F.get(of_rank, F.col("rank") - 1)).otherwise(1.0)
    return small(chosen.join(middle, by).select(*by, "mean", "inverse", scale.alias("scale"), "rank"))


def judge(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` without the text, with the statistics, base_failed, distance (squared) and kept."""
    outputs = [T.StructField(n, T.LongType(), False) for n in _STATISTICS]
    replaced = {text, *_STATISTICS, "base_failed", "distance", "kept"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in replaced]
    groups = [f"_qm_g{i}" for i in range(len(by))]
    rows = docs.withColumns({g: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for g, c in zip(groups, by, strict=True)})
    rows = with_python(rows, _statistics, [text], outputs, drop=[text, "base_failed", "distance", "kept"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    rows = checkpointed(rows.withColumns(dict(zip(X, _vector(), strict=True)) | {"_qm_failed": failed}))

    passed = rows.where("not _qm_failed").select(*groups, *X)
    everyone = F.struct(*(F.lit("\0all").alias(g) for g in groups))
    sizes = checkpointed(passed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).drop("n"))
    few = sizes.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    # Every row counts for the group of all rows, whose estimate serves small groups, and for its own if that is large.
    own = passed.join(F.broadcast(sizes) if few else sizes, groups, "left_semi")
    numbers = own.unionByName(passed.select(everyone.alias("e"), *X).select("e.*", *X))
    found = estimates(numbers, groups, few).select(*groups, *(F.col(c).alias(f"_qm_{c}") for c in ("mean", "inverse", "scale")))
    every = found.where(F.col(groups[0]) == "\0all").first()  # the one group of all rows; none where no row passes
    told = rows.join(bounded(found.where(F.col(groups[0]) != "\0all"), FEW_GROUPS), groups, "left")
    if every:
        told = told.withColumns({c: F.coalesce(c, F.array(*map(F.lit, every[c]))) for c in ("_qm_mean", "_qm_inverse")} | {"_qm_scale": F.coalesce("_qm_scale", F.lit(every["_qm_scale"]))})
    distance = _distance("_qm_mean", "_qm_inverse") / F.col("_qm_scale")
    return told.select(*kept, *_STATISTICS, F.col("_qm_failed").alias("base_failed"), distance.alias("distance"), (~F.col("_qm_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The statistics of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
