"""The core ranking in the tasks: candidates are never shuffled, cut groups and halves."""

import random

from pyspark.sql import functions as F

from veilmetrics.operators import fitting
from veilmetrics.plans import registry

from .test_fitting import ROW, make_rows, product

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_sorted_or_joined(spark):
    """Rows were joined with all groups in their reach, and candidates sorted by windows, some milliseconds a row."""
    p = plan(registry.queries()["m09_fitted_variants"](spark, SF))
    assert "Join" not in p and "Window" not in p and p.count("Exchange") == 1


def test_many_texts_of_one_width(spark):
    """Groups larger than what is looked at on a side, all at the same distance: their best texts by letters and words."""
    r = random.Random(4)
    variants = sorted({("".join(r.choice(["a", "e", "n", "b"]) for _ in range(5)) + r.choice(["", " ", "."]), r.choice(["canonical", "comma"])) for _ in range(900)})
    rows = make_rows(r, 40) + [(99, i, "two_sided", 10.0, 100.0, 100.0 + w, 100.0, 100.0 + w, None, n, 3.5, 100.0, 1, w) for i, (w, n) in enumerate(((27.8, None), (27.8, 122.0), (0.0, None), (500.0, None), (27.80005, None)))]
    v = fitting.measured(spark.createDataFrame(variants, "text string, template string"))
    for top in (1, 3, 20):
        got = fitting.fitted(spark.createDataFrame(rows, ROW), v, top)
        found = sorted((x["doc_id"], x["token_idx"], x["rank"], x["text"], x["adjusted"]) for x in got.collect() if (x["doc_id"], x["token_idx"]) != (99, 4))
        assert found == [x for x in product(rows, variants, top) if x[:2] != (99, 4)]


def test_every_row_stays(spark):
    r = random.Random(6)
    rows = make_rows(r, 80)
    for texts in ([], [("ab", "canonical"), ("Some Name", "comma")]):
        v = fitting.measured(spark.createDataFrame(texts, "text string, template string"))
        d = spark.createDataFrame(rows, ROW)
        got = fitting.fitted(d, v, 5, every=True)
        assert "Join" not in plan(got)
        assert {(x["token_idx"], x["mode"], x["target_width"]) for x in got.collect()} == {(x[1], x[2], x[13]) for x in rows}
        some = got.where("rank is not null").drop("mode", "target_width")
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, fitting.fitted(d, v, 5).collect()))
        assert got.where("rank is null").where(F.coalesce("text", "template").isNotNull()).count() == 0
