"""The anchor chain found in the tasks that cut the texts, against the operators on arrays of pages."""

import random

import pytest
from pyspark.sql import functions as F

from veilmetrics.operators import anchors
from veilmetrics.plans import anchoring, registry

KEYS = ["doc_id", "page_index", "token_idx"]
NAMES = "j22_anchor_chain j18_pair_pool j16_span_rules e60_selected_pair_facts m14_event_order".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts with punctuation, words beyond ASCII, words without width, wide words (a gap that parts a line), pages of 600 words and more, no text."""
    r = random.Random(11)
    word = lambda: r.choice(["Lorem", "ipsum", "a", "été", "x-1", "dolore", "!", "...", "§", "\x01", "W" * 20, "m" * 20, "word"])
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 11, 12, 13, 240, 599, 601, 1400, 1900)] + [None, "  two  spaces ", "\ntail\n\nof lines "]
    d = tmp_path_factory.mktemp("chain")
    spark.createDataFrame([(i * 7 - 14, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d)


def by_arrays(spark, d):
    """The queries' rows by the operators."""
    r, k = anchoring.resolved(spark, d), lambda *c: [*KEYS, *c]
    four = lambda *names: [F.round(c, 4).alias(c) for c in names]
    pair = r.select(*KEYS, F.explode("pairs").alias("p"))
    one = lambda side: r.select(F.lit(side).alias("side"), *KEYS, F.explode(f"{side}s").alias("x")).select("side", *k("x.rt", "x.relation", "x.status"))
    log = anchors.diagnostics(r)
    return {
        "j22_anchor_chain": r.select(*k("n_lines"), F.size("pairs").alias("n_pairs"), F.size(F.filter("pairs", lambda p: p["status"] == "nonlocal")).alias("n_nonlocal"), "mode", "reason", "left_rt", "right_rt", "seed", *four("left_edge", "right_edge", "target_width")),
        "j18_pair_pool": pair.select(*k("p.left_rt", "p.right_rt", "p.gap_sum"), F.round("p.width", 4).alias("width"), "p.status"),
        "j16_span_rules": one("left").unionByName(one("right")),
        "e60_selected_pair_facts": anchors.facts(log, "anchor_pair_selected", ["pair_target_width_pt", "pair_box_delta_pt", "line_rank"]).drop("item"),
        "m14_event_order": log.select(*k("place", "stage", "code", "level", "item"), F.to_json("metrics").alias("metrics")),
        "m15_event_histogram": anchors.histograms(log, ["doc_id"])}


@pytest.mark.parametrize("name", [*NAMES, "m15_event_histogram"])
def test_equal_to_the_operators(spark, folder, name):
    got, want = registry.queries()[name](spark, folder), by_arrays(spark, folder)[name]
    assert got.dtypes == want.dtypes
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    found = rows(got)
    assert found == rows(want) and len(found) > 50


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_shuffled_or_interpreted(spark, folder, name):
    """The arrays of a box were folded by interpreted lambdas, which took most of the time."""
    plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lambda" not in plan


def test_histogram_shuffles_counts_alone(spark, folder):
    plan = registry.queries()["m15_event_histogram"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_no_text_at_all(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in [*NAMES, "m15_event_histogram"]:
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0
