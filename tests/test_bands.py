"""Grid joins against all pairs, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from veilmetrics.operators import bands, evaluate


def rects(n, seed, wide=30.0):
    r = random.Random(seed)
    out = [(r.randint(0, 2), i, (x := r.choice([r.uniform(-50, 600), 72.0 * r.randint(0, 5)])), (y := r.choice([r.uniform(-50, 800), 72.0 * r.randint(0, 5)])), x + r.choice([0.0, r.uniform(0, wide), 400.0]), y + r.choice([0.0, r.uniform(0, wide), 300.0])) for i in range(n)]
    return out + [(0, n, None, 1.0, 2.0, 3.0), (0, n + 1, float("nan"), 1.0, 2.0, 3.0), (0, n + 2, 0.0, 0.0, float("inf"), 9.0), (1, n + 3, 50.0, 60.0, 10.0, 20.0)]


@pytest.mark.parametrize("axes", ["y", "xy"])
def test_pairs_once_and_none_lost(spark, axes):
    a, b = rects(120, 1), rects(150, 2)
    cols = lambda s: f"page int, {s} int, {s}x0 double, {s}y0 double, {s}x1 double, {s}y1 double"
    grid = [bands.rows("ay0", "ay1", "by0", "by1")] + ([bands.columns("ax0", "ax1", "bx0", "bx1")] if axes == "xy" else [])
    l, r = spark.createDataFrame(a, cols("a")), spark.createDataFrame(b, cols("b"))
    got = sorted((x["a"], x["b"]) for x in bands.grid_join(l, r, ["page"], grid, F.lit(True)).select("a", "b").collect())
    # the grid posts intervals by cells: pairs that share a cell are given, and the condition decides
    touch = lambda p, q, i, j: min(p[i], p[j]) <= max(q[i], q[j]) and min(q[i], q[j]) <= max(p[i], p[j])
    good = lambda x: all(v is not None and v == v and abs(v) < float("inf") for v in (x[2:] if axes == "xy" else (x[3], x[5])))
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and good(p) and good(q) and touch(p, q, 3, 5) and (axes == "y" or touch(p, q, 2, 4))]
    assert len(got) == len(set(got)) and set(want) <= set(got)
    over = (F.least("ay0", "ay1") <= F.greatest("by0", "by1")) & (F.least("by0", "by1") <= F.greatest("ay0", "ay1"))
    if axes == "xy":
        over = over & (F.least("ax0", "ax1") <= F.greatest("bx0", "bx1")) & (F.least("bx0", "bx1") <= F.greatest("ax0", "ax1"))
    assert sorted((x["a"], x["b"]) for x in bands.grid_join(l, r, ["page"], grid, over).select("a", "b").collect()) == sorted(want)


def test_plan_is_an_equi_join_on_cells(spark):
    cols = "doc_id int, page_index int, token_idx int, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 5.0, 0.0, 15.0, 10.0)], cols)
    pairs = evaluate.iou_pairs(df, df)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell0" in plan and "_cell1" in plan and "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["t"], r["f"], r["iou"]) for r in pairs.collect()) == [(1, 1, 1.0), (1, 2, 0.333333), (2, 1, 0.333333), (2, 2, 1.0)]


def test_empty(spark):
    cols = "doc_id int, page_index int, token_idx int, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([], cols)
    assert evaluate.iou_pairs(df, df).count() == 0


def test_spaced_sample_keeps_the_row_it_took(spark):
    df = spark.createDataFrame([(1, 0, 1, "X", 0.0, 10.0), (1, 0, 2, "A", 5.0, 15.0), (1, 0, 3, "A", 20.0, 30.0)], "doc_id long, line long, token_idx long, target string, x0 double, x1 double")
    assert sorted((r["token_idx"], r["target"]) for r in evaluate.spaced(df).collect()) == [(1, "X"), (3, "A")]
