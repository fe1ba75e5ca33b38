"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Boosted shallow trees over text statistics (stats.py) are grown on labelled rows; every path from a root to a node is a
rule, a conjunction of threshold tests. Lasso logistic regression (accelerated proximal gradient, penalty chosen on a
held-back part) keeps few of the rules, and the ensemble becomes one Spark expression, so that scoring is a projection.

Fitting uses at most about max_rows labelled rows, chosen by a hash of the id; scoring covers every row in one scan.

Defined cases: empty and null texts have zero statistics and get a score like any other; without labels of both kinds
the score is their smoothed mean for every row; null labels and null ids aren't learned from; a doc_id that repeats in
labels counts for each label; extra columns of the documents aren't used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import crc_mod, keep
from abundex.llm.stats import VECTOR, text_stats

Rule = tuple[tuple[int, bool, float], ...]  # (feature, greater, threshold): all must hold


def _candidates(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 2)[1:-1])) for c in x.T]


def grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, found: list[tuple[Rule, float]]) -> None:
    """Adds the nodes below path, with the step of each leaf, to found (greedy second-order gain)."""
    g, h = grad[rows].sum(), hess[rows].sum() + 1.0
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl) - g**2 / h
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        found.append((path, -g / h))
        return
    _, f, i = best
    above = binned[rows, f] > i
    for side in (False, True):
        new = (*path, (f, side, float(cuts[f][i])))
        found.append((new, np.nan))
        grow(x, binned, cuts, grad, hess, rows[above == side], depth - 1, least, new, found)


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for f, greater, cut in rule:
            out[:, j] &= (x[:, f] > cut) == greater
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * |weights| (FISTA)."""
    n, k = a.shape
    step = 4 / max(np.linalg.norm(np.c_[np.ones(n), a], 2) ** 2 / n, 1e-9)
    w = v = np.zeros(k + 1)
    w[0] = v[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(steps):
        r = _sigmoid(v[0] + a @ v[1:]) - y
        z = v - step * np.r_[r.mean(), a.T @ r / n]
        new = np.r_[z[0], np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - step * penalty, 0)]
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and (rule, weight) pairs with nonzero weights."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(p / (1 - p))), []
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.15
    if y[~held].min() == y[~held].max():
        held[:] = False
    xt, yt = x[~held], y[~held]
    cuts = _candidates(xt, bins)
    binned = np.stack([np.searchsorted(c, xt[:, f], "left") for f, c in enumerate(cuts)], 1)
    rules: dict[Rule, None] = {}
    z = np.full(len(yt), np.log(yt.mean() / (1 - yt.mean())))
    for _ in range(trees):
        p = _sigmoid(z)
        rows = np.flatnonzero(rng.random(len(yt)) < 0.6)
        found: list[tuple[Rule, float]] = []
        grow(xt, binned, cuts, p - yt, p * (1 - p), rows, depth, max(5, len(yt) // 400), (), found)
        nodes = [r for r, s in found if r and np.isnan(s)]
        rules |= dict.fromkeys(nodes)
        leaves = [(r, s) for r, s in found if not np.isnan(s)]
        z = z + 0.3 * rule_matrix(xt, [r for r, _ in leaves]) @ np.array([s for _, s in leaves])
    every = list(rules)
    if not every:
        return float(np.log(yt.mean() / (1 - yt.mean()))), []
    a, ah, yh = rule_matrix(xt, every).astype(float), rule_matrix(x[held], every).astype(float), y[held]
    best = None
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3):
        b, w = lasso_logistic(a, yt, penalty)
        if len(yh):
            p = np.clip(_sigmoid(b + ah @ w), 1e-6, 1 - 1e-6)
            loss = -(yh * np.log(p) + (1 - yh) * np.log(1 - p)).mean()
        else:
            loss = 0.0
        if best is None or loss < best[0] - 1e-4:
            best = (loss, b, w)
    _, b, w = best
    return b, [(r, float(v)) for r, v in zip(every, w) if abs(v) > 1e-6]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]], columns: list[Column]) -> Column:
    """The score, a probability, as one expression over the statistics."""
    z = F.lit(intercept)
    for rule, w in rules:
        tests = [columns[f] > cut if greater else columns[f] <= cut for f, greater, cut in rule]
        every = tests[0]
        for t in tests[1:]:
            every = every & t
        z = z + F.when(every, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, others: list[str] | None = None) -> DataFrame:
    """doc_id, the columns in others, held_out and score of every row of docs.

    labels has doc_id and the label column; rows whose crc32(doc_id) mod 5 is 0 are held out."""
    own = list(dict.fromkeys(["doc_id", *(others or [])]))
    names = [f"v{i}" for i in range(len(VECTOR))]
    stats = keep(text_stats(docs, own).select(*own, *[x().alias(n) for n, x in zip(names, VECTOR.values())]), "quality")
    out_of_fit = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~out_of_fit).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    part = max(1, -(-known.count() // max_rows))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(part)) == 0)
    frame = stats.join(known, F.col("doc_id") == F.col("_id")).select(*names, "_y").toPandas()
    frame = frame.sort_values([*names, "_y"])
    intercept, rules = fit_rules(frame[names].to_numpy(float), frame["_y"].to_numpy(float))
    return stats.select(*own, out_of_fit.alias("held_out"), compile_rules(intercept, rules, [F.col(n) for n in names]).alias("score"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
