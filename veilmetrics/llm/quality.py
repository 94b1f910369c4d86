"""Operator 6, a quality classifier as a sparse rule ensemble.

Whole-text statistics are Spark columns. On a bounded sample of labelled rows (SAMPLE, taken by the hash of the doc_id;
a repeated row counts once)
shallow boosted trees are grown; every path from a root to a node is a conjunctive rule; lasso logistic regression gives
the rules weights, most of them zero; the rules left are compiled into one Spark column expression, so scoring is a
narrow JVM plan over all documents.

Cases: null and empty texts have zero statistics and a score like any other; a null doc_id is in no fold of its own
(crc32 of null is null) and is neither learnt from nor held out; without labels, or with labels of one class, the score is
the smoothed share of label 1; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, plain, table

SAMPLE = 12_000
ROUNDS, DEPTH, BINS, LEAF = 24, 3, 24, 8
LEAVES, INNER, CHOICE = (4, 8, 16), 3, 2_000
LASSO = 2e-3

#: Statistics of a text t with n characters, w words and the lines ls.
_COUNTS = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "symbol": r"[^\p{L}\p{N}\s.,;:'\"()?-]",
    "bar": r"\|",
    "stop": r"[.?!]",
    "comma": r"[,;:]",
    "short": r"(?<!\S)\S{1,3}(?!\S)",
    "long": r"\S{14,}",
    "space": r"\s",
}


def statistics(text: Column) -> dict[str, Column]:
    """Name -> column expression; all but the first two are shares or means."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    w = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    out = {"log_chars": F.log10(n), "log_words": F.log10(w), "word_len": n / w}
    for k, p in _COUNTS.items():
        out[k] = F.regexp_count(t, F.lit(p)) / (w if k in ("short", "long") else n)
    out["line_len"] = F.log10(n / F.size(lines))
    out["line_repeat"] = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    words = F.split(t, r"\s+")
    out["word_repeat"] = 1 - F.size(F.array_distinct(words)) / F.size(words)
    return {k: v.cast("double") for k, v in out.items()}


@dataclass
class Rules:
    """score = sigmoid(bias + sum of the weights of the rules that hold); a rule is a list of (statistic, above, threshold)."""

    bias: float = 0.0
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, stats: dict[str, Column] | None = None) -> Column:
        at = (lambda k: stats[k]) if stats else F.col
        total = F.lit(self.bias)
        for conds, weight in self.rules:
            holds = None
            for k, above, x in conds:
                c = at(k) > F.lit(x) if above else at(k) <= F.lit(x)
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for conds, weight in self.rules:
            total += weight * _holds(x, names, conds)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, names: list[str], conds) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, above, t in conds:
        c = x[:, names.index(k)]
        ok &= c > t if above else c <= t
    return ok


def _grow(x, names, grad, hess, rows, depth, conds, rules, step, leaf):
    """Splits where the gradient gain is largest; adds a rule for each node. Returns nothing: step collects leaf values."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = None
    if depth:
        for f, name in enumerate(names):
            col = x[rows, f]
            for t in np.unique(np.quantile(col, np.linspace(0, 1, BINS + 2)[1:-1], method="lower")):
                left = col <= t
                k = int(left.sum())
                if k < leaf or len(rows) - k < leaf:
                    continue
                gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, name, float(t))
    if best is None or best[0] < 1e-3:
        step[rows] = g / (h + 1)
        return
    _, f, name, t = best
    left = x[rows, f] <= t
    for above, part in ((False, rows[left]), (True, rows[~left])):
        path = (*conds, (name, above, t))
        rules.append(path)
        _grow(x, names, grad, hess, part, depth - 1, path, rules, step, leaf)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], lasso: float = LASSO, seed: int = 1, leaf: int = LEAF) -> Rules:
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    base = math.log(prior / (1 - prior))
    if n < 2 * leaf or y.min() == y.max():
        return Rules(base)
    rng, paths, raw = np.random.default_rng(seed), [], np.full(n, base)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        rows = np.sort(rng.permutation(n)[: max(2 * leaf, n // 2)])
        step, found = np.zeros(n), []
        _grow(x, names, y - p, p * (1 - p), rows, DEPTH, (), found, step, leaf)
        for path in found:  # the leaves hold for rows that were left out too
            if not any(other[: len(path)] == path and len(other) > len(path) for other in found):
                inside = _holds(x, names, path)
                raw[inside] += 0.5 * step[rows[inside[rows]]].mean() if inside[rows].any() else 0.0
        paths += found
    paths = list(dict.fromkeys(paths))
    if not paths:  # no split gains anything
        return Rules(base)
    a = np.stack([_holds(x, names, p) for p in paths], 1).astype(float)
    a, at = np.unique(a, axis=1, return_index=True)
    paths = [paths[i] for i in at]
    mean = a.mean(0)
    c = a - mean
    size = np.linalg.norm(c, 2) ** 2 / (4 * n) + 1e-9
    w, v, b, k = np.zeros(c.shape[1]), np.zeros(c.shape[1]), base, 1.0
    for _ in range(1500):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(c @ v + b)))
        new = v + c.T @ (y - p) / n / size
        new = np.sign(new) * np.maximum(np.abs(new) - lasso / size, 0)
        b += 4 * (y - p).mean()
        nk = (1 + math.sqrt(1 + 4 * k * k)) / 2
        v, k = new + (k - 1) / nk * (new - w), nk
        w = new
    kept = [(paths[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-6)]
    return Rules(float(b - mean @ w), kept)


def choose(x: np.ndarray, y: np.ndarray, names: list[str], folds: np.ndarray) -> Rules:
    """The fit with the smallest leaf of LEAVES that has the least log loss over INNER folds of the first CHOICE learning rows; ties go to the larger leaf."""
    some, of, part = x[:CHOICE], y[:CHOICE], folds[:CHOICE]

    def loss(leaf: int) -> float:
        total = 0.0
        for k in range(INNER):
            inside = part != k
            p = np.clip(fit(some[inside], of[inside], names, leaf=leaf).predict(some[~inside], names), 1e-6, 1 - 1e-6)
            total -= float((of[~inside] * np.log(p) + (1 - of[~inside]) * np.log(1 - p)).sum())
        return total

    if len(of) < 2 * INNER or of.min() == of.max() or any((part != k).sum() == 0 for k in range(INNER)):
        return fit(x, y, names)
    return fit(x, y, names, leaf=min(sorted(LEAVES, reverse=True), key=lambda leaf: round(loss(leaf), 9)))


def learn(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", sample: int = SAMPLE) -> Rules:
    """Fits the rules to `sample` labelled rows at most, none of the held-out fold; the smallest leaf is chosen by folds inside these rows."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & (crc_mod(F.col("doc_id")) != 1))
    some = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    d = plain(docs, doc_id=doc_id, text=text).join(F.broadcast(some), "doc_id").distinct()  # a repeated row is learnt from once
    stats = statistics(F.col("text").cast("string"))
    names = list(stats)
    got = d.select("doc_id", "y", *[v.alias(k) for k, v in stats.items()]).orderBy(F.xxhash64("doc_id"), "doc_id", "y", *names).limit(sample).toPandas()
    folds = np.array([zlib.crc32(str(i).encode()) // 3 % INNER for i in got["doc_id"]], np.int64)
    return choose(got[names].to_numpy(float), got["y"].to_numpy(float), names, folds)


def score(docs: DataFrame, rules: Rules, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    d = plain(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = d.select("doc_id", *[v.alias(k) for k, v in statistics(F.col("text")).items()]).withColumn("score", rules.column())
    return d.select("doc_id", F.coalesce(crc_mod(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, rules: Rules, text="text") -> DataFrame:
    """The rows with a score of 0.5 or more, as they are.

    The score is projected as for `score` and written with the rows; a filter on it in the same plan would be pushed into
    the projections, and work out each statistic as often as it stands in the rules.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = docs.select(whole, *[v.alias(k) for k, v in statistics(F.col(f"`{text}`").cast("string")).items()]).select("_row", rules.column().alias("_score"))
    return cut(scored, "scored").where("_score >= 0.5").select("_row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
