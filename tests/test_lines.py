"""What is found within the tasks that cut the texts, against the operators on tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilmetrics.operators import context, evaluate, measure, names
from veilmetrics.plans import registry
from veilmetrics.sources import layout, lines

KEY = ["doc_id", "token_idx"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    word = lambda: r.choice(["Lorem", "ipsum", "a", "été", "x-1", "dolore", "Word", "word", "illi,"])
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 11, 12, 13, 240, 599, 601, 1400)] + [None, "  two  spaces ", "tail\n\nof lines "]
    return spark.createDataFrame([(i * 7 - 14, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted((tuple(x) for x in d.select(cols).collect()), key=repr)
    assert rows(a) == rows(b) and a.count() > 0


def test_edges_and_tolerance(docs):
    t = layout.tokens(docs)
    bias = context.row_bias(layout.runs(t)).select("doc_id", "line", "tolerance")
    same(lines.edges(docs), measure.edges(t).join(bias, ["doc_id", "line"], "left").withColumn("tolerance", F.coalesce("tolerance", F.lit(3.5))))


def test_anchors_phrases_and_spans(docs):
    t = layout.tokens(docs)
    joined = context.band_join(layout.boxes(t), layout.runs(t))
    made = lines.line_anchors(docs)
    same(made.drop("before", "after"), context.line_anchors(joined))
    same(context.best_line(made).select(*KEY, "before", "after"), context.phrases(joined, context.best_line(context.line_anchors(joined))))
    n = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    for limit in (9, 48):
        same(lines.span_counts(docs, limit), context.context_spans(joined, limit).groupBy(*KEY).agg(n("left"), n("right"), n("center"), F.max("n").cast("long").alias("n_all")))


def test_boxes_of_lines_and_pages(docs):
    t = layout.tokens(docs)
    b = layout.boxes(t)
    same(lines.gap_boxes(docs), evaluate.gap_boxes(layout.runs(t), ["doc_id", "line"]))
    same(lines.spaced(docs, 40.0), evaluate.spaced(b.withColumns({"x0": F.col("x0") - 40, "x1": F.col("x1") + 40})))
    same(lines.matched(docs), evaluate.match(evaluate.iou_pairs(b, layout.detected(b))))
    same(lines.clusters(docs), b.groupBy("doc_id", "page_index").applyInPandas(lambda pdf: evaluate.cluster_by_seed(pdf), "doc_id long, page_index long, token_idx long, cluster long"))
    s = b.select("doc_id", "line", "token_idx", F.col("x0").alias("bx0")).join(layout.runs(t).select("doc_id", "line", "x0", "y0", "x1", "y1"), ["doc_id", "line"]).where("x1 <= bx0").withColumn("gap", F.col("bx0") - F.col("x1"))
    same(lines.grouped_spans(docs), s.groupBy("doc_id").applyInPandas(evaluate.each_part(context.grouped_span, ["token_idx"]), "doc_id long, token_idx long, n long, x0 double, y0 double, x1 double, y1 double"))


def test_targets(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["Lo", "lO", "so", "ſo", "ma", "ıma", "ima", "straße", "strasse", "ﬁne", "fine", "été"]) for _ in range(r.randint(1, 3)))
    docs = spark.createDataFrame([(i - 2, " ".join(word() for _ in range(n))) for i, n in enumerate((0, 1, 2, 12, 13, 40, 599, 601, 1300))] + [(20, None), (21, " Word word  other\nmore "), (22, "\nTail of some Lines")], "doc_id long, text string")
    w = Window.partitionBy("doc_id", "line").orderBy("token_idx")
    k = layout.tokens(docs).withColumns({"pv": F.lag("token").over(w), "nx": F.lead("token").over(w)}).withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "page_index", names.simple_upper(F.col("token")))))
    same(lines.targets(docs), k.where(F.rlike("token", F.lit(layout.TARGET)) & F.expr("same = 1 and pv is not null and nx is not null and x1 - x0 >= 6")).select("doc_id", "token_idx", "token"))


SF = "/root/testdata/sf0.001"
NO_SHUFFLE = "v08_grouped_span e20_spaced_sample p03_seed_clusters e04_greedy_match e15_gap_boxes j07_context_spans j03_before_after_anchor j24_usable_edges e19_target_selection".split()


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_word_is_shuffled(spark, name):
    assert "Exchange" not in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["m00_ranked_candidates", "m09_fitted_variants", "j05_phrase_growth"])
def test_only_boxes_are_shuffled(spark, name):
    """One shuffle by box and none by line or page."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Exchange hashpartitioning(doc_id#" in plan


def test_files_are_handed_on_in_parts():
    """A batch of any size gives parts of 200 files at most, so that a task never holds what it makes of them all."""
    import pandas as pd

    from veilmetrics.sources import pdf

    batch = pd.DataFrame({"path": [f"{i}.pdf" for i in range(450)], "content": [pdf.make_pdf(["a b"])] * 450})
    parts = list(pdf._each([batch], ["path", "n", "error"], lambda d: [(len(d),)]))
    assert [len(p) for p in parts] == [200, 200, 50] and list(pd.concat(parts)["path"]) == list(batch["path"])


def test_policy_matrix_counts_in_the_task(spark):
    from veilmetrics.operators import analysis

    r = random.Random(3)
    rows = [(k, f"t{j:02d}", r.choice([0.5, 1.0, 1.25]), r.random() < 0.5, r.random() < 0.4, r.random() < 0.3) for k in range(40) for j in range(r.randint(1, 9))]
    d = spark.createDataFrame(rows, "k int, text string, err double, a boolean, b boolean, hit boolean")
    got = analysis.policy_matrix(d, ["k"], {"a": F.col("a"), "b": F.col("b")}, F.col("hit"), "err", ["text"], (0.25, 0.5))
    want = {}
    for name, flag, way, extra in [("none", 3, "penalty", 0.0)] + [(f"{w}:{n}" + (f":{x}" if w == "penalty" else ""), f, w, x) for f, n in ((3, "a"), (4, "b")) for w, x in (("drop", 0.0), ("keep", 0.0), ("penalty", 0.25), ("penalty", 0.5))]:
        best = []
        for k in range(40):
            left = sorted((x[2] + (extra if x[flag] and name != "none" else 0.0), x[1], x[5]) for x in rows if x[0] == k and (way == "penalty" or x[flag] == (way == "keep")))
            best += [i + 1 for i, x in enumerate(left) if x[2]][:1]
        want[name] = (len(best), round(sum(best) / len(best), 6), round(sum(1 / n for n in best) / len(best), 6))
    assert {x["policy"]: (x["found"], x["mean_rank"], x["mrr"]) for x in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each policy is ranked


def test_a_window_is_the_page_cut():
    import numpy as np

    from veilmetrics.sources import fonts, render

    data = fonts.make_pdf(["some words of a line", "and more"], "Abc", 33)
    whole = next(render.rasters(data, 72))[1]
    for x0, y0, x1, y1 in ((67, 717, 177, 747), (-5, 40, 200, 90), (80, 60, 90, 75), (600, 780, 700, 900)):
        part = next(render.rasters(data, 72, lambda w, h: (x0, y0, x1, y1)))[1]
        assert np.array_equal(part, whole[max(0, y0) : y1, max(0, x0) : x1])


def test_clusters_are_assigned_in_order(spark):
    import pandas as pd

    r = random.Random(8)
    rows = pd.DataFrame([(c, c * 10 + k, j, r.choice("abcd")) for c in range(30) for k in range(r.randint(1, 5)) for j in range(r.randint(1, 4))], columns=["cluster", "row_id", "rank", "text"])
    want = sorted(tuple(x) for _, g in rows.groupby("cluster") for x in evaluate.greedy_assignment(g).astype(object).where(lambda d: d.notna(), None).itertuples(index=False))
    for size in (1, 7, 10_000):
        got = pd.concat(evaluate._assigned(rows.iloc[i : i + size] for i in range(0, len(rows), size))).astype(object)
        assert sorted(tuple(x) for x in got.where(got.notna(), None).itertuples(index=False)) == want
    made = evaluate.assigned(spark.createDataFrame(rows))
    assert sorted(tuple(x) for x in made.collect()) == want
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_entries_are_dealt_out(spark):
    """A small file of entries is not one task."""
    from veilmetrics.plans import dictionary

    plan = dictionary.entries(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entry_idx" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in plan


def test_numbers_of_names():
    """Numbers by runs are those of a search from 2 for each name; families don't meet; a name's many copies are one run."""
    from veilmetrics.sources import render

    def slow(names):
        used, out = set(), []
        for name in names:
            at = name.rfind(".")
            stem, ext = (name[:at], name[at:]) if at > 0 else (name, "")
            k, now = 1, name
            while now.lower() in used:
                k += 1
                now = f"{stem} ({k}){ext}"
            used.add(now.lower())
            out.append(now)
        return out

    r = random.Random(4)
    for _ in range(1500):
        stem = lambda: r.choice(["a", "A", "a (2)", "A (3)", "a (2) (2)", "ΑΣ", "ασ", "b (02)", "", "x. (2)"]) + r.choice(["", " (2)", " (4)"])
        found = [stem() + r.choice(["", ".txt", ".TXT", ".", ".Σ"]) for _ in range(r.randint(1, 12))]
        assert render.unique_names(found) == slow(found)
        families = {}
        for x in found:
            families.setdefault(render.name_family(x), []).append(x)
        assert sorted(y for v in families.values() for y in render.unique_names(v)) == sorted(slow(found))
    n = render.Numbers()
    assert n.runs("a (4).txt", 1) == [(1, 1)] and n.runs("A.txt", 10**9) == [(1, 1), (4, 5)] and n.runs("a.TXT", 2) == [(1, 10**9 + 2)]


def test_a_key_has_zips_of_bounded_size(spark):
    """A key's files are neither one group nor one ZIP, and its names differ over all of them."""
    import io
    import zipfile

    from veilmetrics.sources import render

    r = random.Random(6)
    rows = [(r.choice([1, 2, None]), r.choice(["a.txt", "A.txt", "a (2).txt", "a (9).txt", "b", "B"]), r.randbytes(r.choice([0, 1, 40, 900]))) for _ in range(400)] + [(3, "big", b"x" * 5000), (3, "big", b"x" * 5000)]
    files = spark.createDataFrame(rows, "k int, n string, c binary").repartition(5)
    made = render.bundles(files, "k", "n", "c", limit=2000)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    zips = made.collect()
    assert len({z["part"] for z in zips}) == len(zips) and len(zips) > 50
    got = {}
    for z in zips:
        inside = zipfile.ZipFile(io.BytesIO(z["zip"]))
        assert len(z["zip"]) <= 2000 or len(inside.namelist()) == 1
        got.setdefault(z["key"], []).extend((e.filename, inside.read(e)) for e in inside.infolist())
    for key in (1, 2, 3, None):
        own = [(n, c) for k, n, c in rows if k == key]
        names, entries = sorted(n for n, _ in own), got[None if key is None else str(key)]
        assert sorted(n for n, _ in entries) == sorted(render.unique_names(names))
        assert sorted(c for _, c in entries) == sorted(c for _, c in own)
        for n, c in entries:  # a number is added, nothing else
            assert any(c == x and n.startswith(m.rpartition(".")[0] or m) for m, x in own)


PLAN = lambda d: d._jdf.queryExecution().executedPlan().toString()


def test_equal_entries_are_worked_out_once(spark):
    """Their ids come back from one row; a null id and repeated rows stay."""
    from veilmetrics.operators import names
    from veilmetrics.plans import dictionary

    rows = [(i % 50 if i % 9 else None, ["Anne-Marie Holt", "Èo Rook", "Ida Ann", None][i % 4]) for i in range(200)]
    d = spark.createDataFrame(rows, "entry_idx long, entry string")
    made = names.together(d)
    again = [(i["entry_idx"], r["entry"]) for r in made.collect() for i in r["ids"]]
    assert sorted(again, key=repr) == sorted(rows, key=repr) and made.count() <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = spark.read.parquet(f"{SF}/part.parquet")
    al = part.groupBy(F.lit("given").alias("role"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key")).agg(F.min(F.concat(F.lit("al-"), "p_brand")).alias("alias")).withColumn("place", F.lit(0))
    each = names.role_templates(dictionary.normal(spark, SF), al).select("entry_idx", F.explode("roles").alias("r")).select("entry_idx", "r.*")
    query = registry.queries()["x05_role_templates"](spark, SF)
    same(query, each)
    assert "collect_list" in PLAN(query)


def test_the_first_of_equal_entries_is_expanded(spark):
    """Equal entries are one before variants are made, dealt out again, and a null id comes first."""
    from veilmetrics.operators import names

    rows = [(5, "Ida  Holt"), (3, "Ida|Holt"), (4, "Ida Holt"), (9, "IDA HOLT"), (7, "Boris Rook"), (None, "Boris Rook"), (1, None), (2, "")]
    got = names.expand(spark.createDataFrame(rows, "entry_idx long, entry string"), roles=False)
    assert {(r["entry_idx"], r["text"].lower()) for r in got.collect()} == {(3, "ida holt"), (None, "boris rook")}
    assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in names.expand(spark.createDataFrame([(3, "Ida Holt"), (7, "Boris Rook")], "entry_idx long, entry string"), roles=False).collect())
    plan = PLAN(got)
    assert "HashAggregate(keys=[entry" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in plan
