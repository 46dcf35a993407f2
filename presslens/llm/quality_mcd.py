"""Quality rules: base rules and robust multivariate outliers.

Base statistics per text (words between ASCII white space): n_words,
word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``),
n_dup_lines (lines with a word that equal an earlier line), n_repeat_words
(words in 3-word windows that occur twice or more in the text). A text fails
the base rules with fewer than ``MIN_WORDS`` words or more than half of its
words in repeated windows.

Texts that pass are judged by a minimum covariance determinant (Rousseeuw
1984) per language and source. A text's vector is ``STATISTICS``: logarithms
of the number of words and the mean word length, square roots of the shares of
symbols, repeated lines and repeated words. Each group has the deterministic
starts of ``STARTS`` (as in Hubert et al. 2012): medians, means, lower and upper
quartiles as centres, so that junk on either side of most texts, or far from
all, misleads some of them only. From each start concentration steps are
taken: the share ``CORE`` of a group's texts with least distance (half, which
junk in any lesser part cannot fill) gives the next mean and covariance, until
its determinant falls no more; the start with the least determinant gives the
estimate. A variance below ``LEAST`` squared is raised to it, in any direction
of the vectors scaled by ``LEAST``, so that statistics that are equal in most
texts have no zero variance; greater variances stay as they are. Then the
estimates are reweighted once by the texts within the 97.5 % point, and a text
is rejected if its squared Mahalanobis distance is over the ``1 - TAIL`` point
of chi-squared.

Texts alike in all statistics vote once, so that a group of copies can't pull
the estimates to itself; all others count in every step. A step is one
aggregation of the narrow vectors into moments per group, start and distance bin (``BINS`` a doubling);
the share is taken to whole bins, and groups are updated from their few hundred
bins. Starts that stand still take no part in further steps. A hot group only
meets partial aggregation; group estimates go back to the rows through
``util.join_by_key``.

Groups of fewer than ``MIN_GROUP`` texts are pooled per language, pools that
are still smaller over all languages; where fewer than ``MIN_GROUP`` different
vectors vote, nothing is rejected.

Defined cases: null texts have no words and fail; null language and source
are values of their own; texts alike are judged alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import field, join_by_key, row_keyed, stage

MIN_WORDS = 50
REPEAT_PERCENT = 50
STATISTICS = ("words", "word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation taken for each statistic. Symbols, repeated lines and repeated words are 0 in most clean
#: texts, so that theirs decides: with ``TAIL`` a share over 0.26 symbols a word or of repeated words rejects alone.
LEAST = (0.25, 0.03, 0.1, 0.1, 0.1)
#: Share of a group's texts that a concentration step takes.
CORE = 0.5
STARTS = ("median", "mean", "lower", "upper")
#: Least fall of a determinant's logarithm that counts; steps at most (a determinant seldom falls that often).
FALL, STEPS = 1e-3, 16
TAIL = 1e-4
MIN_GROUP = 50
BINS = 8

_P = len(STATISTICS)
_SYMBOLS = b"#*$%&|<>"
BASE = T.StructType([T.StructField(c, T.LongType()) for c in
                     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, len(data) - len(data.translate(None, _SYMBOLS)), 0, 0
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else [data]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        if k < n:
            pairs = ids[:-1] * k + ids[1:]
            if k >= 1 << 21:  # three numbers no longer fit 63 bits
                pairs, k = np.unique(pairs, return_inverse=True)[1], k
            windows = pairs[:-1] * k + ids[2:]
            _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift:n - 2 + shift] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([base_statistics(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(BASE))
        out = batch.drop_columns(["text"])
        for i, f in enumerate(BASE.fields):
            out = out.append_column(f.name, pa.array(found[:, i], pa.int64()))
        yield out


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n),
            F.sqrt(10 * F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_cdf(x: float, p: int) -> float:
    """Lower regularised incomplete gamma function of (p / 2, x / 2), by its series."""
    a, y = p / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi2_point(q: float, p: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def consistency(share: float, p: int = _P) -> float:
    """What the covariance of the ``share`` innermost points of a normal sample falls short by."""
    return share / chi2_cdf(chi2_point(share, p), p + 2)


ESTIMATE = T.StructType([T.StructField("grp", T.StringType()), T.StructField("start", T.StringType()), T.StructField("n", T.LongType()),
                         T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("precision", T.ArrayType(T.DoubleType())),
                         T.StructField("log_det", T.DoubleType())])


def _raised(cov: np.ndarray) -> np.ndarray:
    """Precision of a covariance whose variances below ``LEAST`` squared, in any direction, are raised to it."""
    unit = np.outer(LEAST, LEAST)
    variances, directions = np.linalg.eigh(cov / unit)
    return directions / np.maximum(variances, 1) @ directions.T / unit


def _estimate(grp: str, start: str, n: int, mean: np.ndarray, cov: np.ndarray, log_det: float | None = None) -> dict:
    precision = _raised(cov)
    return {"grp": grp, "start": start, "n": int(n), "mean": mean.tolist(), "precision": precision.reshape(-1).tolist(),
            "log_det": -float(np.linalg.slogdet(precision)[1]) if log_det is None else log_det}


def _covariance(moments: pd.Series, m: float, mean: np.ndarray) -> np.ndarray:
    cov = np.zeros((_P, _P))
    for i in range(_P):
        for j in range(i, _P):
            cov[i, j] = cov[j, i] = moments[f"q{i}_{j}"] / m - mean[i] * mean[j]
    return cov


def _updated(share: float | None, reach: float = 0.0):
    """Mean and covariance of a group and start from the moments of its distance bins: of
    the bins that hold ``share`` of its texts, or of those below ``reach``."""
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        counts = bins["m0"].to_numpy()
        n = counts.sum()
        if share is None:
            take = max(1, int((bins["bin"].to_numpy() <= _bin_number(reach)).sum()))
        else:
            core = max(math.ceil(share * n), min((n + _P + 1) // 2, n))
            take = int(np.searchsorted(np.cumsum(counts), core)) + 1
        inner = bins.iloc[:take].sum(numeric_only=True)
        m = inner["m0"]
        mean = np.array([inner[f"s{i}"] for i in range(_P)]) / m
        scale = consistency(0.975 if share is None else m / n)
        return pd.DataFrame([_estimate(bins["grp"].iloc[0], bins["start"].iloc[0], n, mean, _covariance(inner, m, mean) * scale)])
    return run


def _started(rows: pd.DataFrame) -> pd.DataFrame:
    r = rows.iloc[0]
    quartiles = np.array([r[f"v{i}"] for i in range(_P)])
    spread = np.diag(((quartiles[:, 2] - quartiles[:, 0]) / 1.349) ** 2)
    mean = np.array([r[f"s{i}"] for i in range(_P)]) / r["n"]
    begins = {"median": (quartiles[:, 1], spread), "mean": (mean, _covariance(r, r["n"], mean)),
              "lower": (quartiles[:, 0], spread), "upper": (quartiles[:, 2], spread)}
    return pd.DataFrame([_estimate(r["grp"], s, r["n"], *begins[s], log_det=math.inf) for s in STARTS])


def _bin_number(d: float) -> int:
    return math.floor(BINS * math.log2(max(d, 2.0 ** -10)))


def _distance(mean: Column, precision: Column) -> Column:
    off = [F.col(f"v{i}") - mean[i] for i in range(_P)]
    return sum((off[i] * off[j] * precision[i * _P + j] * (1 if i == j else 2)
                for i in range(_P) for j in range(i, _P)), F.lit(0.0))


def _grouped(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``grp``: the language and source, or the pool of small groups."""
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    keyed = rows.withColumn("own", own)
    sizes = keyed.groupBy("own").agg(F.count("*").alias("n_own"), F.first("lang").alias("lang"))
    pool = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    small = sizes.filter(F.col("n_own") < MIN_GROUP).groupBy(pool.alias("pool")).agg(F.sum("n_own").alias("n_pool"))
    sizes = stage(sizes.withColumn("pool", pool).join(small, "pool", "left").select(
        "own", "n_own", F.when(F.col("n_own") >= MIN_GROUP, F.col("own"))
        .when(F.col("n_pool") >= MIN_GROUP, F.col("pool")).otherwise("rest").alias("grp")))
    return join_by_key(keyed, sizes, ["own"], "n_own", n, ["_fk", "_rx"]).drop("own", "n_own")


def _sums() -> list[Column]:
    return [*[F.sum(f"v{i}").alias(f"s{i}") for i in range(_P)],
            *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i in range(_P) for j in range(i, _P)]]


def _stepped(vectors: DataFrame, n: int, now: DataFrame, update: Callable) -> DataFrame:
    """The next estimates from those of ``now``."""
    sided = now.groupBy("grp").agg(F.first("n").alias("n"), F.collect_list(F.struct("start", "mean", "precision")).alias("starts"))
    met = join_by_key(vectors, stage(sided), ["grp"], "n", n, ["_fk", "_rx"]).withColumn("at", F.explode("starts"))
    far = F.greatest(_distance(F.col("at.mean"), F.col("at.precision")), F.lit(2.0 ** -10))
    number = F.least(F.floor(BINS * F.log2(far)), F.lit(40 * BINS)).cast("int")
    bins = met.groupBy("grp", F.col("at.start").alias("start"), number.alias("bin")).agg(F.count("*").alias("m0"), *_sums())
    return bins.groupBy("grp", "start").applyInPandas(update, ESTIMATE)


def concentrated(vectors: DataFrame, n: int) -> DataFrame:
    """The estimate of every group and start of the stage ``vectors`` (grp, v0 ...) where its determinant falls no more."""
    now = stage(vectors.groupBy("grp").agg(F.count("*").alias("n"), *_sums(), *[
        F.percentile_approx(f"v{i}", [0.25, 0.5, 0.75], 10_000).alias(f"v{i}") for i in range(_P)])
        .groupBy("grp").applyInPandas(_started, ESTIMATE).withColumn("live", F.lit(True)))
    for _ in range(STEPS):
        then = _stepped(vectors, n, now.filter("live"), _updated(CORE)).select(
            "grp", "start", *[F.col(c).alias(f"new_{c}") for c in ("mean", "precision", "log_det")])
        falls = F.coalesce(F.col("new_log_det") < F.col("log_det") - FALL, F.lit(False))
        now = stage(now.join(then, ["grp", "start"], "left").select(
            "grp", "start", "n", *[F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "precision", "log_det")],
            falls.alias("live")))
        if now.filter("live").isEmpty():
            break
    return now


def estimates(vectors: DataFrame, n: int) -> DataFrame:
    """(grp, n, mean, precision) of every group: of its start with the least determinant, reweighted."""
    every = concentrated(vectors, n)
    best = every.groupBy("grp").agg(F.min_by(F.struct(*every.columns), F.struct("log_det", "start")).alias("e")).select("e.*")
    return stage(_stepped(vectors, n, best, _updated(None, chi2_point(0.975, _P))))


def judge(keyed: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          tail: float = TAIL, extra: list[Column] = ()) -> DataFrame:
    """Per row of ``util.row_keyed(...)``: _fk, _rx, base statistics, base_failed, distance, kept."""
    rows = keyed.select("_fk", "_rx", *extra, field(lang_col).cast("string").alias("lang"),
                        field(source_col).cast("string").alias("source"), field(text_col).cast("string").alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    measured = rows.mapInArrow(_measured, T.StructType([*kept, *BASE.fields]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measured = stage(measured.withColumn("base_failed", failed))
    passed = measured.filter(~F.col("base_failed"))
    n = passed.count()
    vectors = stage(_grouped(passed.select("_fk", "_rx", "lang", "source", *[
        c.alias(f"v{i}") for i, c in enumerate(_vector())]), n).select("_fk", "_rx", "grp", *[f"v{i}" for i in range(_P)]))
    votes = stage(vectors.dropDuplicates(["grp", *[f"v{i}" for i in range(_P)]]))
    found = estimates(votes, votes.count()).join(vectors.groupBy("grp").agg(F.count("*").alias("n_rows")), "grp")
    far = join_by_key(vectors, stage(found), ["grp"], "n_rows", n, ["_fk", "_rx"]).select(
        "_fk", "_rx", _distance(F.col("mean"), F.col("precision")).alias("distance"),
        ((_distance(F.col("mean"), F.col("precision")) <= chi2_point(1 - tail, _P)) | (F.col("n") < MIN_GROUP)).alias("within"))
    return (measured.join(far, ["_fk", "_rx"], "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce("within", F.lit(False))).drop("within"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Per row: id, the base statistics, base_failed, kept, distance (null if base_failed)."""
    return judge(row_keyed(docs), text_col, lang_col, source_col, tail, [field(id_col).alias("id")]).select(
        F.col("id").alias(id_col), *[f.name for f in BASE.fields], "base_failed", "kept", "distance")
