"""Quality rules: minimum-covariance-determinant outliers per language and source.

One scan makes the statistics of every document (stats.py); everything after works on that narrow table. For each group
the estimate starts at coordinate-wise medians and interquartile ranges and repeats concentration steps: the share h of
rows with the smallest Mahalanobis distances gives the next mean and covariance, until determinants stand still; a
reweighting step over the rows within a chi-square quantile ends it, and distances are scaled so that their median is
that of chi-square. A step is two aggregations with partial sums (a distance quantile from mergeable sketches, then
moments), so a group of any size is never gathered. Parameters are a table with one row a group, joined by key; Spark
broadcasts it only while its size allows.

First each language is estimated, over all its sources. Then each group (language and source) is, from two starts, its
own medians and its language's estimate, of which the lesser determinant counts; the language's mean, covariance and
scale come in as PRIOR_ROWS rows would. So a verdict moves smoothly from the language's estimate, which a group of a few
rows follows, to the group's own, without a switch at any size. Variances below a coordinate's floor are raised to it.

The steps use all rows that the base rules pass.

Defined cases: null language or source is a group value of its own; null or empty texts fail the base rule; groups
without spread are held by the floors of the coordinates; rows that repeat count each time; extra columns pass through,
and columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import forget, keep, rename_clashes
from abundex.llm.stats import COUNTS, VECTOR, text_stats

#: Least standard deviation of a coordinate: logs of sizes, then rates (square roots), which short texts make noisy.
FLOOR = {"log_words": 0.8, "log_word_len": 0.15, "distinct": 0.08, "log_line_words": 0.6, "log_max_word": 0.5, "punct": 0.25, "symbols": 0.15, "digits": 0.15, "dup_lines": 0.35, "repeats": 0.35}
RATE_FLOOR = 0.25
P = len(VECTOR)
#: Rows that a language's estimate counts for in each of its groups.
PRIOR_ROWS = 100
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _parameters(center: np.ndarray, cov: np.ndarray) -> tuple[list, list, list, float]:
    """Mean, covariance with floors, whitening rows and log determinant; the triangles are those of PAIRS."""
    floor = np.array([FLOOR.get(c, RATE_FLOOR) for c in VECTOR]) ** 2
    held = cov + np.diag(np.maximum(floor - np.diag(cov), 0) + 1e-9)  # the last for exact collinearity
    white = np.linalg.inv(np.linalg.cholesky(held))
    return center.tolist(), [cov[i, j] for i, j in PAIRS], [white[i, j] for i, j in PAIRS], float(np.linalg.slogdet(held)[1])


def _square(triangle) -> np.ndarray:
    out = np.zeros((P, P))
    for x, (i, j) in zip(triangle, PAIRS):
        out[i, j] = out[j, i] = x
    return out


def _estimate(frame: pd.DataFrame) -> pd.DataFrame:
    """Parameters of each group from its centred sums, and from its language's where it has one."""
    out = []
    for r in frame.itertuples(index=False):
        s = np.array(r.sums)
        shift = s[:P] / r.n
        cov, center = _square(s[P:] / r.n) - np.outer(shift, shift), np.asarray(r.center) + shift
        if r.prior_cov is not None:
            own = r.n / (r.n + PRIOR_ROWS)
            cov, center = own * cov + (1 - own) * _square(r.prior_cov), own * center + (1 - own) * np.asarray(r.prior_center)
        out.append((r.g, r.l, *_parameters(center, cov)))
    return pd.DataFrame(out, columns=["g", "l", "center", "cov", "white", "logdet"])


_PARAMS = "g string, l string, center array<double>, cov array<double>, white array<double>, logdet double"


def _estimates(rows: DataFrame, inside: Column, prior: DataFrame | None) -> DataFrame:
    """Parameters from the rows inside; rows come with the center that they are shifted by."""
    c = [F.col(f"v{i}") - F.col("center")[i] for i in range(P)]
    sums = [F.sum(x) for x in c] + [F.sum(c[i] * c[j]) for i, j in PAIRS]
    moments = rows.where(inside).groupBy("g").agg(F.first("l").alias("l"), F.count("*").alias("n"), F.first("center").alias("center"), F.array(*sums).alias("sums"))
    none = F.lit(None).cast("array<double>")
    if prior is None:
        moments = moments.withColumns({"prior_center": none, "prior_cov": none})
    else:
        moments = moments.join(prior.select(F.col("g").alias("l"), F.col("center").alias("prior_center"), F.col("cov").alias("prior_cov")), "l", "left")
    return keep(moments.mapInPandas(lambda frames: map(_estimate, frames), _PARAMS), "mcd")


def distance2() -> Column:
    """Squared Mahalanobis distance from center and white (rows of the inverse Cholesky factor)."""
    z = [sum((F.col("white")[n] * (F.col(f"v{j}") - F.col("center")[j]) for n, (k, j) in enumerate(PAIRS) if k == i), F.lit(0.0)) for i in range(P)]
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(params.drop("l"), "g").withColumn("d2", distance2())


def _cut(rows: DataFrame, share: float) -> DataFrame:
    return rows.groupBy("g").agg(F.percentile_approx("d2", share, 2000).alias("cut"))


def _first(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians and interquartile ranges of each group."""
    thirds = rows.groupBy("g").agg(F.first("l").alias("l"), *[F.percentile_approx(f"v{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(P)])

    def first(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                q = np.array([getattr(r, f"q{i}") for i in range(P)])
                out.append((r.g, r.l, *_parameters(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))))
            yield pd.DataFrame(out, columns=["g", "l", "center", "cov", "white", "logdet"])

    return keep(thirds.mapInPandas(first, _PARAMS), "mcd")


def _concentrate(rows: DataFrame, params: DataFrame, prior: DataFrame | None, share: float, steps: int, tolerance: float) -> DataFrame:
    for _ in range(steps):
        near = _with_distance(rows, params)
        cuts = keep(_cut(near, share), "mcd-cut")
        new = _estimates(near.join(cuts, "g"), F.col("d2") <= F.col("cut"), prior)
        moved = new.join(params.select("g", F.col("logdet").alias("old")), "g").agg(F.max(F.abs(F.col("old") - F.col("logdet")))).first()[0]
        forget(params, cuts)
        params = new
        if moved is None or moved < tolerance:
            break
    return params


def fit_mcd(rows: DataFrame, prior: DataFrame | None = None, share: float = 0.75, steps: int = 5, tolerance: float = 1e-2) -> DataFrame:
    """Parameters (g, l, center, cov, white, logdet, scale) from rows of g, l and v0 ... : scale divides squared
    distances. prior: such parameters of the values of l."""
    if "l" not in rows.columns:
        rows = rows.withColumn("l", F.col("g"))
    start = _first(rows)
    if prior is None:
        params = _concentrate(rows, start, None, share, steps, tolerance)
    else:
        # both starts at once: a group is two, marked at the end of its name
        other = start.select("g", "l").join(prior.select(F.col("g").alias("l"), "center", "cov", "white", "logdet"), "l").select(*start.columns)
        mark = [F.concat("g", F.lit(f"\x1e{i}")).alias("g") for i in (0, 1)]
        starts = keep(start.withColumn("g", mark[0]).unionByName(other.withColumn("g", mark[1])), "mcd")
        ends = _concentrate(rows.withColumn("g", F.explode(F.array(*mark))), starts, prior, share, steps, tolerance)
        best = ends.withColumn("g", F.expr("left(g, length(g) - 2)")).groupBy("g").agg(F.min(F.struct("logdet", "l", "center", "cov", "white")).alias("x"))
        params = keep(best.select("g", *(f"x.{c}" for c in start.columns[1:])), "mcd")
        forget(start, ends)
    near = _with_distance(rows, params)
    cuts = keep(_cut(near, 0.5), "mcd-cut")
    limit = chi2_quantile(0.975, P) / chi2_quantile(0.5, P)
    new = _estimates(near.join(cuts, "g"), F.col("d2") <= F.col("cut") * limit, prior)
    forget(cuts, params)
    scale = _with_distance(rows, new).groupBy("g").agg(F.percentile_approx("d2", 0.5, 2000).alias("cut"), F.count("*").alias("n")).select("g", "n", F.greatest(F.col("cut") / chi2_quantile(0.5, P), F.lit(0.25)).alias("scale"))
    scaled = new.join(scale, "g")
    if prior is not None:
        scaled = scaled.join(prior.select(F.col("g").alias("l"), F.col("scale").alias("usual")), "l", "left")
        scaled = scaled.withColumn("scale", F.coalesce((F.col("n") * F.col("scale") + PRIOR_ROWS * F.col("usual")) / (F.col("n") + PRIOR_ROWS), "scale"))
    final = keep(scaled.select(*new.columns, "scale"), "mcd")
    forget(new)
    return final


def quality_rules(docs: DataFrame, confidence: float = 0.999999, others: list[str] | None = None) -> DataFrame:
    """doc_id, lang, source, the columns in others and COUNTS, with base_failed, distance (null if base_failed) and kept."""
    own = list(dict.fromkeys(["doc_id", "lang", "source", *(others or [])]))
    docs = rename_clashes(docs, ["base_failed", "distance", "kept", "g", "l"])
    text = text_stats(docs, own)
    language = F.coalesce("lang", F.lit("\x00"))
    counted = keep(text.withColumns({"base_failed": base_failed(), "l": language, "g": F.concat_ws("\x1f", language, F.coalesce("source", F.lit("\x00")))}), "stats")
    vectors = keep(counted.where(~F.col("base_failed")).select("g", "l", *[x().alias(f"v{i}") for i, x in enumerate(VECTOR.values())]), "vectors")
    languages = fit_mcd(vectors.withColumn("g", F.col("l")))
    params = fit_mcd(vectors, languages)
    forget(vectors, languages)
    judged = counted.join(params.drop("l"), "g", "left")
    judged = judged.select(*counted.columns, "center", "white", "scale", *[x().alias(f"v{i}") for i, x in enumerate(VECTOR.values())])
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(distance2() / F.col("scale"))))
    limit = chi2_quantile(confidence, P) ** 0.5
    return judged.select(*own, *COUNTS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
