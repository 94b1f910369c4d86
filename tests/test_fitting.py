"""The core ranking against the full product in Python."""

import random

import pytest
from pyspark.sql import functions as F

from veilmetrics.functions.widths import HELVETICA
from veilmetrics.operators import fitting

ROW = "doc_id long, token_idx long, mode string, font_size double, left_edge double, right_edge double, box_x0 double, box_x1 double, prev_box_x1 double, next_box_x0 double, tolerance double, h_scale double, units long, target_width double"


def product(rows, variants, top):
    out = []
    for d, t, mode, size, left, right, x0, x1, prev, nxt, tol, tz, _, _ in rows:
        best = {}
        for text, template in variants:
            norm = " ".join(text.split()).upper()
            if mode == "unresolved" or not norm or not all(32 <= ord(c) < 127 for c in text):
                continue
            w = sum(HELVETICA[ord(c) - 32] for c in text) * (size / 1000 * max(tz / 100, 0.01))
            pl, pr = (right - w, right) if mode == "right_only" else (left, left + w)
            err = round(abs(pr - right) if mode == "two_sided" else abs(pr - x1) if mode == "left_only" else abs(pl - x0), 4)
            if (prev is not None and prev - pl > tol) or (nxt is not None and pr - nxt > tol):
                continue
            key = (err if template == "canonical" else round(err + 2.75, 4), -sum(c.isascii() and c.isalpha() for c in text), -len(norm.split()), norm, text)
            best[norm] = min(best.get(norm, key), key)
        out += [(d, t, i + 1, k[4], round(k[0], 4)) for i, k in enumerate(sorted(best.values())[:top])]
    return sorted(out)


def make_rows(r, n):
    rows = []
    for i in range(n):
        x0 = round(r.uniform(60, 300), 2)
        w = round(r.choice([r.uniform(2, 60), r.uniform(60, 300)]), 2)
        mode = r.choice(["two_sided", "left_only", "right_only", "two_sided", "unresolved"])
        left = None if mode in ("right_only", "unresolved") else x0 - r.uniform(0, 3)
        right = None if mode in ("left_only", "unresolved") else x0 + w + r.uniform(0, 3)
        prev, nxt = r.choice([None, x0 - 5.0, x0 + 3.0]), r.choice([None, None, x0 + w + 4.0, x0 + w / 2])
        rows.append((i // 7, i, mode, r.choice([9.0, 10.0, 12.5]), left, right, x0, x0 + w, prev, nxt, r.choice([1.0, 3.5, 8.0]), r.choice([100.0, 80.0]), 1, w))
    return rows


@pytest.mark.parametrize("size,top", [(0, 5), (3, 5), (400, 5), (3000, 20)])
def test_equals_the_full_product(spark, size, top):
    r = random.Random(size)
    words = ["ab", "Il", "mm", "WORD", "word", "Word", "né", "x-y", "a b", "i"]
    variants = sorted({("".join(r.choice(["a", "i", "m", "W", "l", " ", "e"]) for _ in range(r.randint(1, 14))), r.choice(["canonical", "comma", "initial"])) for _ in range(size)} | ({(w, "canonical") for w in words} if size else set()))
    rows = make_rows(r, 60)
    v = fitting.measured(spark.createDataFrame(variants, "text string, template string"))
    got = fitting.fitted(spark.createDataFrame(rows, ROW), v, top)
    assert sorted((x["doc_id"], x["token_idx"], x["rank"], x["text"], x["adjusted"]) for x in got.collect()) == product(rows, variants, top)


def test_reach_and_groups_are_bounded(spark):
    r = random.Random(1)
    variants = [("".join(r.choice("ailmWe") for _ in range(6)), "canonical") for _ in range(4000)]
    v = fitting.measured(spark.createDataFrame(variants, "text string, template string"))
    groups = fitting.width_groups(v, 5)
    assert groups.agg(F.max("n")).first()[0] <= 5
    rows = [(1, i, "two_sided", 10.0, 100.0, 100.0 + w, 100.0, 100.0 + w, None, None, 3.5, 100.0, 1, w) for i, w in enumerate((28.0, 30.0, 32.0))]
    far = fitting.with_reach(fitting._ranges(spark.createDataFrame(rows, ROW)), groups, 10)
    assert {x["step"] for x in far.collect()} <= {0, 1}  # enough words close by: no row looks farther
    boxes = spark.createDataFrame([(1, 0, 1.0, 5.0), (9, 9, 2.0, 12.5)], "doc_id long, token_idx long, x0 double, x1 double")
    every = fitting.with_placeholders(boxes, spark.createDataFrame(rows, ROW), fitting.fitted(spark.createDataFrame(rows, ROW), v, 2)).collect()
    assert sorted((x["doc_id"], x["mode"], x["target_width"], x["rank"]) for x in every) == [(1, "two_sided", 28.0, 1), (1, "two_sided", 28.0, 2), (9, "unresolved", 10.5, None)] or len(every) == 3
