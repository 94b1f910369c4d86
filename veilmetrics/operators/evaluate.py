"""Evaluating results: matching, precision and recall, ranks, percentiles, stability, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou, nearest_rank, overlap, safe_ratio
from . import bands

MIN_IOU, MISSING_RANK = 0.20, 10_000


def iou_pairs(truth: DataFrame, found: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """Pairs of boxes of one page (equal in doc_id and page_index) with an IoU of min_iou or more, which must be above 0."""
    edges = ("x0", "y0", "x1", "y1")
    a = truth.select("doc_id", "page_index", F.col("token_idx").alias("t"), *[F.col(c).alias("a" + c) for c in edges])
    b = found.select("doc_id", "page_index", F.col("token_idx").alias("f"), *[F.col(c).alias("b" + c) for c in edges])
    axes = [bands.rows("ay0", "ay1", "by0", "by1"), bands.columns("ax0", "ax1", "bx0", "bx1")]
    met = bands.grid_join(a, b, ["doc_id", "page_index"], axes, (overlap("ax0", "ax1", "bx0", "bx1") > 0) & (overlap("ay0", "ay1", "by0", "by1") > 0))
    return met.withColumn("iou", F.round(iou("a", "b"), 6)).where(F.col("iou") >= min_iou)


def gap_boxes(runs: DataFrame, keys: list[str], reach: int = 5, least: float = 6.0, most: float = 160.0) -> DataFrame:
    """Synthetic boxes: the gaps between a run and each of the `reach` runs after it on its line, `least` to `most` points wide."""
    w = Window.partitionBy(*keys).orderBy("x0", "token_idx")
    after = F.array(*[F.lead(F.struct("token_idx", "x0"), i).over(w) for i in range(1, reach + 1)])
    each = runs.select(*keys, "token_idx", "x1", after.alias("_a")).select(keys[0], F.col("token_idx").alias("left_idx"), "x1", F.explode("_a").alias("b"))
    return each.select(keys[0], "left_idx", F.col("b.token_idx").alias("right_idx"), F.round(F.col("b.x0") - F.col("x1"), 4).alias("gap")).where(F.col("gap").between(least, most))


def greedy_match(pairs: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: best IoU first, each box used once."""
    doc = pairs["doc_id"].iloc[0]
    keep = [(doc, t, f, -s) for s, t, f in best_first(sorted(zip(-pairs["iou"], pairs["t"], pairs["f"])))]
    return pd.DataFrame(keep, columns=["doc_id", "t", "f", "iou"])


def best_first(pairs: list[tuple]):
    """Of sorted (-iou, t, f) those whose boxes no pair before has taken."""
    used_t, used_f = set(), set()
    for s, t, f in pairs:
        if t not in used_t and f not in used_f:
            used_t.add(t)
            used_f.add(f)
            yield s, t, f


def each_part(step, keys: list[str]):
    """For applyInPandas over documents: the step on each of their parts. Parts are small and many; a group for each would cost more than the step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([step(p) for _, p in pdf.groupby(keys, sort=False)], ignore_index=True)

    return run


def match(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc_id", "page_index", "t", "f", "iou").groupBy("doc_id").applyInPandas(each_part(greedy_match, ["page_index"]), "doc_id long, t long, f long, iou double")


def spaced(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc_id", "line", "token_idx", "target", "x0", "x1").groupBy("doc_id").applyInPandas(each_part(spaced_sample, ["line"]), "doc_id long, line long, token_idx long, target string")


def prf(tp: Column, n_truth: Column, n_found: Column) -> dict[str, Column]:
    """Precision, recall and F1; nothing to find and nothing found is perfect."""
    p, r = safe_ratio(tp, n_found), safe_ratio(tp, n_truth)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 6)}


def percentile(values: Column, q: float) -> Column:
    """Aggregate: the value at index round((n - 1) * q) of those sorted."""
    return nearest_rank(F.array_sort(F.collect_list(values)), q)


def metric_delta(now: Column, base: Column, eps: float = 1e-9) -> dict[str, Column]:
    d = now - base
    return {"delta": F.round(d, 6), "pct": F.when(F.abs(base) < eps, F.lit(None).cast("double")).otherwise(F.round(d / base * 100, 6)), "trend": F.when(F.abs(d) <= eps, "flat").when(d > 0, "up").otherwise("down")}


def rank_summary(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """recall at 1, 5 and 20, MRR (a miss counts 0), mean rank of those found, and the largest rank if none is missed."""
    r = F.col(rank)
    hit = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), hit(1), hit(5), hit(20), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(r), 6).alias("mean_rank"), F.when(F.count("*") == F.count(r), F.max(r)).alias("best_feasible_k"))


def weighted_merge(summary: DataFrame, keys: list[str], weight: str, cols: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.sum(weight).alias(weight), *[F.round(F.sum(F.col(c) * F.col(weight)) / F.sum(weight), 6).alias(c) for c in cols])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """log2 entropy of kinds within keys, the dominant kind (first by name among equals) and its share."""
    n = df.groupBy(*keys, kind).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    p = n.withColumn("p", F.col("c") / F.sum("c").over(w))
    return p.groupBy(*keys).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"), F.min_by(kind, F.struct((-F.col("c")).alias("m"), F.col(kind))).alias("dominant"), F.round(F.max("p"), 6).alias("share"))


def tie_density(df: DataFrame, keys: list[str], error: str, bands=(0.05, 0.10, 0.25, 0.50, 1.00)) -> DataFrame:
    """How many rows lie within each band of the least error of their group."""
    base = df.withColumn("_b", F.min(error).over(Window.partitionBy(*keys)))
    return base.groupBy(*keys).agg(*[F.count_if(F.abs(F.col(error) - F.col("_b")) <= t).alias(f"within_{round(t * 100):03d}") for t in bands])


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n rows of least md5(seed:key): the same rows whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def spaced_sample(pdf: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: in order of token_idx, rows of distinct texts, none overlapping one already taken."""
    pdf = pdf.sort_values("token_idx")
    return pdf.iloc[list(apart(zip(pdf["target"], pdf["x0"], pdf["x1"])))][["doc_id", "line", "token_idx", "target"]]


def apart(rows):
    """Places of the (text, x0, x1) that repeat no text and overlap none of those taken before."""
    taken, texts = [], set()
    for i, (text, a, b) in enumerate(rows):
        if text not in texts and all(a >= x1 or b <= x0 for x0, x1 in taken):
            texts.add(text)
            taken.append((a, b))
            yield i


def greedy_assignment(pdf: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: rows of a cluster in order take their best candidate that no earlier row took."""
    out, used = [], set()
    for row, g in pdf.sort_values(["row_id", "rank"]).groupby("row_id", sort=True):
        free = [t for t in g["text"] if t not in used]
        out.append((int(g["cluster"].iloc[0]), int(row), g["text"].iloc[0], free[0] if free else None))
        used.update(free[:1])
    return pd.DataFrame(out, columns=["cluster", "row_id", "independent", "unique_text"])


def assigned(rows: DataFrame) -> DataFrame:
    """greedy_assignment of all clusters: rows dealt out by cluster and read in order, one cluster at a time. A group for each would cost more than its rows."""
    rows = rows.select("cluster", "row_id", "rank", "text").repartition("cluster").sortWithinPartitions("cluster", "row_id", "rank")
    return rows.mapInPandas(_assigned, "cluster long, row_id long, independent string, unique_text string")


def _assigned(batches):
    """For mapInPandas: sorted rows; a row of a cluster may go on in the next batch."""
    columns, at, used, own = ["cluster", "row_id", "independent", "unique_text"], None, set(), None
    for pdf in batches:
        out = []
        for cluster, row, text in zip(pdf["cluster"].tolist(), pdf["row_id"].tolist(), pdf["text"].tolist()):
            if (cluster, row) != at:
                if own:
                    out.append(own)
                if at is None or cluster != at[0]:
                    used = set()
                at, own = (cluster, row), [cluster, row, text, None]
                picked = False
            if not picked and text not in used:
                used.add(text)
                own[3], picked = text, True
        yield pd.DataFrame(out, columns=columns)
    if own:
        yield pd.DataFrame([own], columns=columns)


def cluster_by_seed(pdf: pd.DataFrame, reach: float = 3.0) -> pd.DataFrame:
    """For applyInPandas: rows in order of y1; a row joins the first cluster whose seed row overlaps it or lies within reach."""
    pdf = pdf.sort_values(["y1", "x0", "token_idx"])
    return pdf[["doc_id", "page_index", "token_idx"]].assign(cluster=seed_clusters(zip(pdf["y0"], pdf["y1"]), reach))


def seed_clusters(rows, reach: float = 3.0) -> list[int]:
    """The clusters of (y0, y1) in order: the first whose seed overlaps it or ends within reach, else a new one."""
    seeds, label = [], []
    for y0, y1 in rows:
        at = next((i for i, s in enumerate(seeds) if min(s[1], y1) - max(s[0], y0) > 0 or abs(s[1] - y1) <= reach), len(seeds))
        if at == len(seeds):
            seeds.append((y0, y1))
        label.append(at)
    return label
