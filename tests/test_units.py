"""Hand-worked vectors of single operators."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmetrics import __main__ as main
from veilmetrics import service
from veilmetrics.functions import geometry as g
from veilmetrics.functions import widths
from veilmetrics.operators import analysis, anchors, context, detection, evaluate, measure, names, raster
from veilmetrics.plans import anchoring
from veilmetrics.sources import fonts, pdf, render, reports


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_iou(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    assert d.select(g.iou("a", "b")).first()[0] == pytest.approx(1 / 3)


def test_rect_score(spark):
    d = spark.createDataFrame([(37.5, 18.0), (0.0, 5.0), (2.0, 40.0)], "w double, h double")
    assert [r[0] for r in d.select(g.redaction_score("w", "h")).collect()] == pytest.approx([0.8, 0.0, 0.2])


def test_safe_ratio(spark):
    assert value(spark, g.safe_ratio(F.lit(0), F.lit(0))) == 1.0
    assert value(spark, g.safe_ratio(F.lit(0), F.lit(1))) == 0.0


def test_nearest_rank(spark):
    assert value(spark, g.nearest_rank(F.array(*[F.lit(x) for x in (1, 2, 3, 4)]), 0.5)) == 3
    assert value(spark, g.nearest_rank(F.array().cast("array<int>"), 0.5)) is None


def test_normalise_rect(spark):
    assert tuple(value(spark, g.normalise_rect(F.lit(3), F.lit(4), F.lit(1), F.lit(2)))) == (1, 2, 3, 4)


def test_widths(spark):
    assert value(spark, widths.width_units(F.lit("Aé"))) == 667 + 600
    assert value(spark, widths.strict_units(F.lit("Aé"))) is None
    assert value(spark, widths.width_units(F.lit(""))) == 0
    assert value(spark, widths.project(F.lit(500), F.lit(10.0), F.lit(3), F.lit(1), 100.0, 0.5, 1.5)) == pytest.approx(7.5)
    assert len(widths.HELVETICA) == 95


def test_edge_errors(spark):
    d = spark.createDataFrame([("left_only", 10.0, None, 20.0), ("two_sided", 10.0, 18.0, 20.0), ("right_only", None, 18.0, 20.0), ("unresolved", None, None, 20.0)], "mode string, left_edge double, right_edge double, box_x1 double").withColumn("box_x0", F.lit(10.0))
    assert [r[0] for r in d.select(measure.error_pt(F.lit(8.0))).collect()] == [2.0, 0.0, 0.0, None]


def test_dedupe_keeps_best(spark):
    d = spark.createDataFrame([(1, "A", 1), (1, "A", 2), (1, "B", 3)], "row int, norm string, rank int")
    assert sorted(tuple(r) for r in measure.dedupe_ranked(d, ["row"]).collect()) == [(1, "A", 1), (1, "B", 2)]


@pytest.mark.parametrize(("text", "family"), [("ANNA BELL", "plain_multi_token"), ("BELL, ANNA", "comma"), ("BELLWETHER", "single_token"), ("J. BELL", "initial"), (": )", "punctuation_heavy"), ("", "empty")])
def test_family(spark, text, family):
    assert value(spark, names.family(F.lit(text))) == family


def test_names(spark):
    assert value(spark, names.title_case(F.lit("jean-luc o'neil"))) == "Jean-Luc O'Neil"
    assert value(spark, names.normalise_entry(F.lit(" a|b   c "))) == "a b c"
    rows = {"Dr. Ida van Holt Jr": ("Ida", "van Holt", "Dr.", "Jr"), "Holt, Prof. Ida Ann Sr": ("Ida Ann", "Holt", "Prof.", "Sr"), "Ida": ("Ida", "Ida", "", ""), "van der Holt": ("van", "van der Holt", "", ""), "Dr": ("Dr", "Dr", "Dr", ""), "": ("", "", "", "")}
    d = names.split_name(spark.createDataFrame([(k,) for k in rows], "entry string"))
    assert {r["entry"]: (r["given"], r["surname"], r["prefix"], r["suffix"]) for r in d.collect()} == rows
    assert (len(names.SPECIAL) + len(names.SIMPLE) + 1, len(names.PREFIXES), len(names.SUFFIXES), len(names.PARTICLES)) == (22, 24, 24, 28)
    assert value(spark, names.fold_latin(F.lit("Éñü"))) == "Enu"
    assert len(names.ACCENTED) == len(names.PLAIN)


def slow_roles(given, surname, aliases):
    """Role variants in plain Python, of tokens already split."""
    fold = lambda x: x.translate(str.maketrans(names.ACCENTED, names.PLAIN))
    key = lambda x: "".join(c for c in fold(x) if c.isascii() and c.isalnum()).lower()
    norm = lambda x: " ".join(x.split())

    def shapes(x):
        f = fold(x)
        return [(f, "", "latin_fold")] * (f != x) + [(norm(y), "", "token_shape") for y in (x.replace("-", " "), x.replace(" ", "-"), x.replace("-", ""), x.replace(" ", ""), f.replace("-", " "), f.replace(" ", "-"))]

    def first_of_each(rows):
        seen, out = set(), []
        for r in rows:
            if r[0] and r[0] not in seen:
                seen.add(r[0])
                out.append(r)
        return out

    def of(role, i, x):
        return aliases.get((role, key(x)), []) if role == "surname" or i == 0 else []

    def token(role, i, x):
        return first_of_each([(x, "", ""), *shapes(x), *(y for a in of(role, i, x) for y in [(a, key(x), ""), *shapes(a)])])[:8]

    def side(role, ts):
        states = [[]]
        for i, x in enumerate(ts):
            states = [[*s, v] for s in states for v in token(role, i, x)][:24]
        join = lambda s, k: ",".join(sorted({v[k] for v in s if v[k]}))
        return first_of_each([(" ".join(v[0] for v in s), join(s, 1), join(s, 2)) for s in states])[:24]

    both = lambda a, b: ",".join(sorted({a, b} - {""}))
    on = any(fold(x) != x or "-" in x or of(r, i, x) for r, ts in (("given", given), ("surname", surname)) for i, x in enumerate(ts))
    if not on:
        return []
    return [(k, t, both(g[1], z[1]), both(g[2], z[2])) for g in side("given", given) for z in side("surname", surname) for k, t in (("role_alias_pair", f"{g[0]} {z[0]}"), ("role_alias_comma_pair", f"{z[0]}, {g[0]}"))][:64]


def test_role_templates(spark):
    aliases = {("given", "ida"): ["Idy", "I-da", "Ide"], ("surname", "holt"): ["Holte"], ("surname", "ane"): ["Ane X"]}
    rows = {"Ida Holt": (["Ida"], ["Holt"]), "Mia Rook": (["Mia"], ["Rook"]), "Anne-Marie Ida von Èane": (["Anne-Marie", "Ida"], ["von", "Èane"]), "Bo Ane Ane-Li": (["Bo", "Ane"], ["Ane-Li"]), "Èo Holt": (["Èo"], ["Holt"])}
    table = spark.createDataFrame([(r, k, a, i) for (r, k), v in aliases.items() for i, a in enumerate(v)], "role string, key string, alias string, place int")
    d = spark.createDataFrame([(k,) for k in rows], "entry string")
    got = {r["entry"]: [tuple(x) for x in r["roles"]] for r in names.role_templates(d, table).collect()}
    assert got == {k: slow_roles(*v, aliases) for k, v in rows.items()} and got["Mia Rook"] == [] and max(map(len, got.values())) <= 64
    assert {r["entry"] for r in names.role_templates(d).where("size(roles) > 0").collect()} == {"Anne-Marie Ida von Èane", "Bo Ane Ane-Li", "Èo Holt"}


def test_runtime_policy(spark):
    d = spark.createDataFrame([(0, "Ida Holt")], "entry_idx int, entry string")
    texts = lambda p: {r["text"] for r in names.expand(d, runtime_policy=p).collect()}
    assert "Holt, Ida" in texts(False) and "Holt, Ida" not in texts(True) and "Holt" not in texts(True)


def test_keep_first(spark):
    d = spark.createDataFrame([(1, 0.001, 0.0, 1.0, 1.0, "k", 0), (1, 0.002, 0.0, 1.0, 1.0, "k", 1)], "p int, x0 double, y0 double, x1 double, y1 double, kind string, src int")
    assert [r["src"] for r in detection.dedupe_keep_first(d, ["p"], 2, ["src"]).collect()] == [0]
    assert detection.dedupe_keep_first(d, ["p"], 4, ["src"]).count() == 2


def test_raster_verdicts():
    black = np.full((8, 16, 4), 255, np.uint8)
    black[2:6, 4:12, :3] = 0
    assert raster.regions(black)[0][-1] == "selected_black_component"
    red = black.copy()
    red[2:6, 4:12, :3] = (70, 20, 20)
    assert raster.verdict(1.0, 1.0, 1.0, 50.0) == "rejected_high_channel_spread" and raster.regions(red)[0][-1] != "selected_black_component"
    line = np.full((8, 8, 4), 255, np.uint8)
    for i in range(8):
        line[i, i, :3] = line[i, max(0, i - 1), :3] = 0
    assert raster.regions(line)[0][-1] == "rejected_low_fill_ratio"


def test_components():
    m = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool)
    labels, n = raster.components(m)
    assert n == 3 and len(set(labels[m])) == 3 and labels[0, 0] == labels[0, 2]
    assert raster.column_runs(np.array([[1, 1, 0, 1, 0, 0, 1]], bool)) == [(0, 4), (6, 7)]


def test_greedy_match():
    p = pd.DataFrame({"doc_id": [1, 1, 1], "t": [1, 1, 2], "f": [1, 2, 1], "iou": [0.9, 0.5, 0.8]})
    assert evaluate.greedy_match(p)[["t", "f"]].values.tolist() == [[1, 1]]


def test_cluster_by_seed():
    p = pd.DataFrame({"doc_id": 1, "page_index": 0, "token_idx": [1, 2, 3], "x0": 0.0, "y0": [0.0, 1.0, 50.0], "y1": [10.0, 11.0, 60.0]})
    assert evaluate.cluster_by_seed(p)["cluster"].tolist() == [0, 0, 1]


def test_grouped_span():
    p = pd.DataFrame({"doc_id": 1, "token_idx": 1, "gap": [1.0, 5.0, 40.0], "x0": [90.0, 80.0, 10.0], "x1": [99.0, 89.0, 40.0], "y0": 0.0, "y1": 10.0})
    assert context.grouped_span(p)["n"].tolist() == [2]


def test_pdf_round_trip(spark):
    data = pdf.make_pdf(["Hello (World)", "second"], [(72, 694, 90, 12)])
    (index, box, source, content), = pdf.pages(data)
    assert (index, box, source) == (0, (0.0, 0.0, 612.0, 792.0), "MediaBox")
    runs = pdf.text_runs(content)
    assert [r[0] for r in runs] == ["Hello (World)", "second"] and runs[0][1:5] == pytest.approx((72, 708, 72 + 0.6 * 12 * 13, 720))
    assert pdf.drawn_rects(content) == [(72.0, 694.0, 162.0, 706.0)]
    files = spark.createDataFrame([("a.pdf", data), ("b.pdf", b"junk")], "path string, content binary")
    assert {r["path"]: r["status"] for r in pdf.manifest(pdf.read_pages(files)).collect()} == {"a.pdf": "ok", "b.pdf": "error"}


def test_tj_adjustments():
    assert pdf.text_runs(b"BT /F1 10 Tf 0 0 Td [50 (ab) -100 (c)] TJ ET")[0][3] == pytest.approx(0.6 * 10 * 3 + 1.0)
    assert pdf.drawn_rects(b"1 g 0 0 5 5 re q 0 g 1 1 2 2 re Q 3 3 4 4 re") == [(1.0, 1.0, 3.0, 3.0)]


def test_discover_and_reports(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.PDF").write_bytes(pdf.make_pdf(["hi"]))
    (tmp_path / "y.txt").write_text("no")
    assert pdf.discover(spark, str(tmp_path)).count() == 1
    (tmp_path / "r.json").write_text('{"input": "a", "redactions": [{"page_index": 1, "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "kind": "drawn_rect"}], "count": 1}')
    r = reports.read_redactions(spark, str(tmp_path / "r.json")).first()
    assert (r["page_index"], r["bbox"]["x1"], r["score"]) == (1, 3.0, None)
    reports.write_reports(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, t string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_manifest(spark, tmp_path):
    from veilmetrics import streaming

    (tmp_path / "a.pdf").write_bytes(pdf.make_pdf(["hi"]))
    q = streaming.stream_manifest(spark, str(tmp_path)).writeStream.format("memory").queryName("manifest").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select path, source from manifest").first()["source"] == "MediaBox"


def test_rank_summary(spark):
    d = spark.createDataFrame([("a", 1), ("a", 4), ("a", None)], "ds string, rank int")
    r = evaluate.rank_summary(d, ["ds"]).first()
    assert (r["recall_1"], r["recall_5"], r["mrr"], r["best_feasible_k"]) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(1.25 / 3, abs=1e-6), None)


def test_fonts():
    assert [fonts.glyph_char(x) for x in ("A", "eacute", "Ccedilla", "ntilde", "Ntilde", "quoteleft", "nope", "aring")] == ["A", "é", "Ç", "ń", "Ñ", "’", None, "å"]
    assert fonts.parse(b"<< /A [1 -2.5 (x\\)\\101) <4142>] /B 3 0 R /C#20D /n >>") == {"A": [1, -2.5, b"x)A", b"AB"], "B": 3, "C D": "n"}
    assert fonts._cmap(b"1 beginbfrange <01> <03> <0041> <05> <06> [<0061> <0062>] endbfrange 1 beginbfchar <09> <00e9> endbfchar") == {1: "A", 2: "B", 3: "C", 5: "a", 6: "b", 9: "é"}
    data = fonts.make_pdf(["où 漢 est", "ça va"], "a, b", 7)
    (i, f, content, res), = fonts._pages(data)
    runs = fonts.shown(f, content, res)
    assert [(r[0], r[5]) for r in runs] == [("a, b", "F1"), ("où 漢 est", "F2"), ("ça va", "F2")] and runs[0][3] - runs[0][1] == 4 * 500 * 12 / 1000
    assert fonts.drawn(f, content, res) == [("drawn_path_rect", 79.0, 50.0, 179.0, 70.0), ("drawn_rect", 300.0, 107.0, 360.0, 119.0)]
    truth = fonts.page_fonts(f, res)
    assert {k: (t["unicode_source"], t["width_source"], t["name"]) for k, t in truth.items()} == {"F1": ("encoding_dictionary", "explicit", "Sans-Bold"), "F2": ("to_unicode", "standard_14", "Courier"), "F3": ("named_encoding", "standard_14", "Helvetica")}
    w = fonts.File(b"%PDF 1 0 obj << /Subtype /Type0 /DescendantFonts [2 0 R] /Encoding /Identity-H >> endobj 2 0 obj << /W [3 [500 600] 7 9 250] >> endobj")
    assert fonts.font_truth(w, w.get(fonts.Ref(1)))["widths"] == {3: 500, 4: 600, 7: 250, 8: 250, 9: 250}


@pytest.mark.parametrize(("points", "closed", "want"), [([(0, 0), (4, 0), (4, 2), (0, 2)], True, (0, 0, 4, 2)), ([(0, 0), (4, 0), (4, 2), (1, 1)], True, (0, 0, 4, 2)), ([(0, 0), (4, 1), (3, 2), (0, 2)], True, None), ([(0, 0), (4, 0), (4, 2), (0, 2)], False, None), ([(0, 0), (4, 0), (4, 2)], True, None)])
def test_path_rects(points, closed, want):
    assert fonts.path_rect(points, closed) == want


def test_spacing_of_shown_text():
    content = b"BT /F1 10 Tf 50 Tz 1 Tc 2 Tw 5 5 Td [100 (a b) -200 (c)] TJ (d) Tj 0 -3 TD T* (e) Tj ET"
    f = fonts.File(b"%PDF")
    (a, d, e) = fonts.shown(f, content, None)
    assert a[0] == "a bc" and round(a[3] - a[1], 6) == 4 * 3 + 3 * 1 + 2 + 1 and (e[1], e[4]) == (5.0, -1.0)


def slow_regions(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            todo, part = [(y, x)], set()
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                part.add((a, b))
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
            out.append(part)
    return out


def test_dark_grid():
    r = np.random.default_rng(4)
    g = np.full((90, 130), 250, np.uint8)
    g[10:30, 20:80] = 5
    g[60:62, 5:9] = 0
    g[r.integers(0, 90, 40), r.integers(0, 130, 40)] = 0
    rows, cols = raster.bins(90), raster.bins(130)
    mean = np.array([[g[a:b, c:d].mean() for c, d in zip(cols, cols[1:])] for a, b in zip(rows, rows[1:])])
    limit = max(min(0.65 * g.mean(), 120), int(g.min()) + 5, 32)
    want = []
    for part in slow_regions(mean <= limit):
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        box = (int(cols[min(xs)]), int(rows[min(ys)]), int(cols[max(xs) + 1]), int(rows[max(ys) + 1]))
        area = sum((rows[y + 1] - rows[y]) * (cols[x + 1] - cols[x]) for y, x in part)
        if 0.0005 <= area / g.size <= 0.9 and min(box[2] - box[0], box[3] - box[1]) >= 4:
            want.append(box)
    got = raster.grid_regions(g)
    assert sorted(x[:4] for x in got) == sorted(want) and len(got) >= 1 and raster.grid_regions(np.zeros((0, 5), np.uint8)) == []
    assert raster.dark_pixels(g, 20, 10, 80, 30, 40) == 1200 and raster.dark_pixels(g, -5, -5, 0, 0) == 0
    assert sorted(c[4] for c in raster.dark_components(g, 40, 100)) == [len(p) for p in slow_regions(g < 40) if len(p) >= 100]
    assert all(c[4] < 1200 for c in raster.dark_components(g, 40, 1, (20, 10, 80, 30)))


def test_png_zip_and_names():
    a = np.random.default_rng(1).integers(0, 255, (7, 11, 4)).astype(np.uint8)
    data = render.png(a)
    assert render.png_size(data) == (11, 7)
    with pytest.raises(ValueError, match="damaged"):
        render.png_size(data[:-20] + b"x" + data[-19:])
    assert render.unique_names(["a.txt", "A.txt", "b", "a.txt", "B"]) == ["a.txt", "A (2).txt", "b", "a (3).txt", "B (2)"]
    assert render.page_name("x", 0, 1) == "x.png" and render.page_name("x", 4, 120) == "x-005.png"
    assert render.bundle([("a", b"1"), ("b", b"")]) == render.bundle([("a", b"1"), ("b", b"")])
    assert render.crop(a, -3, 2, 5, 99, [(0, 2, 5, 7, (1, 2, 3))]).shape == (5, 5, 4)


def test_service(spark, tmp_path):
    data = render.annotate(fonts.make_pdf(["one two"], "abc", 3), [(0, 80, 55, 120, 65, "under it", 8)])
    report = service.run_bytes(spark, "x.pdf", data)
    assert report["status"] == "ok" and sorted(r["kind"] for r in report["redactions"]) == ["annotation", "annotation", "drawn_path_rect", "drawn_rect"]
    assert [r["underlying_text"] for r in report["redactions"] if r["kind"] == "drawn_path_rect"] == [["under it"]]
    assert service.run_bytes(spark, "x.pdf", data, mode="drawn")["count"] == 2 and {f["font_key"] for f in report["fonts"]} == {"F1", "F2", "F3", "VeilOverlay"}
    assert service.run_bytes(spark, "bad", b"nothing")["status"] == "error"
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.PDF").write_bytes(data)
    (tmp_path / "in" / "b.pdf").write_bytes(b"nothing")
    out = service.run_batch(spark, main.arguments([str(tmp_path / "in"), str(tmp_path / "out"), "--diagnostics"]))
    assert sorted(r["status"] for r in out.collect()) == ["error", "ok"]
    assert {r["stage"] for r in spark.read.json(str(tmp_path / "out/timings")).collect()} == {"manifest", "boxes", "fonts"}
    (tmp_path / "d.txt").write_text("b|c  d\n\na\nb c d\n")
    assert [r["entry"] for r in service.load_dictionary(spark, str(tmp_path / "d.txt")).orderBy("entry_idx").collect()] == ["a", "b c d"]


def test_complexity_takes_the_rows_of_a_path_together(spark):
    d = spark.createDataFrame([("a", "x\n# y"), ("a", "z"), ("b", "u\n\nv\nw"), ("c", None)], "path string, text string")
    assert [tuple(r) for r in analysis.complexity(d, "path", "text").collect()] == [("b", 4, 3), ("a", 3, 2), ("c", 1, 0)]


def test_simple_upper_is_that_of_sql(spark):
    words = ["straße", "STRASSE", "ﬁne", "ıſ", "ŉ", "été", "ᾳ", "", *names.LONG_UPPER]
    want = [duckdb.execute("select upper(?)", [w]).fetchone()[0] for w in words]
    d = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", names.simple_upper(F.col("w")).alias("u")).orderBy("i")
    assert [r["u"] for r in d.collect()] == want


def test_width_of_a_box_is_that_of_its_edges(spark):
    rows = [(i, 0, 0, 0, "word", 1500, 10, 72.0 + i * 0.1, 94.6 + i * 0.37, True) for i in range(200)]
    tok = spark.createDataFrame(rows, "doc_id long, page_index long, line long, token_idx long, token string, units long, font_size long, x0 double, x1 double, is_box boolean")
    assert all(r["target_width"] == r["box_x1"] - r["box_x0"] for r in measure.edges(tok).collect())


def test_pages_meet_their_lines_without_a_shuffle(spark):
    sf = "/root/testdata/sf0.001"
    got, want = anchors.page_pool(anchoring.page_inputs(spark, sf)), anchors.candidate_pool(*anchoring.inputs(spark, sf))
    assert "Exchange" not in got._jdf.queryExecution().toString()
    key = lambda d: sorted((r["doc_id"], r["page_index"], r["token_idx"], r["bx0"], r["bx1"], r["by0"], r["by1"], r["n_lines"], sorted(map(str, r["pool"]))) for r in d.collect())
    assert key(got) == key(want)
    empty = spark.createDataFrame([(1, 0, [(5, 1.0, 2.0, 3.0, 4.0)], [])], "doc_id long, page_index long, boxes array<struct<token_idx:long,x0:double,y0:double,x1:double,y1:double>>, runs array<struct<token_idx:long,token:string,font_size:long,x0:double,y0:double,x1:double,y1:double>>")
    assert [(r["mode"], r["n_lines"]) for r in anchors.resolve(anchors.page_pool(empty)).collect()] == [("unresolved", 0)]


def test_histogram_of_boxes_is_that_of_their_events(spark):
    r = anchoring.resolved(spark, "/root/testdata/sf0.001").where("doc_id % 20 = 0")
    rows = lambda d: sorted(map(str, d.select("doc_id", "code", "n", "boxes").collect()))
    assert rows(anchors.box_histograms(r, ["doc_id"])) == rows(anchors.histograms(anchors.diagnostics(r), ["doc_id"]))


def test_components_of_any_mask():
    r = np.random.default_rng(5)
    masks = [r.random((h, w)) < p for h, w in ((1, 1), (1, 30), (30, 1), (17, 23), (40, 40)) for p in (0.0, 0.3, 0.5, 0.6, 0.9, 1.0)] + [np.zeros((0, 4), bool), np.zeros((4, 0), bool)]
    for mask in masks:
        want, n = np.zeros(mask.shape, int), 0  # flood fill, in order of the first pixel
        for y, x in np.argwhere(mask):
            todo = [] if want[y, x] else [(y, x)]
            n += bool(todo)
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not want[i, j]:
                    want[i, j] = n
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        got, m = raster.components(mask)
        assert m == n and (got == want).all()
        (ys, xs, of), area, box = raster.measured(got, m)
        assert [(*(int(e[k]) for e in box), int(area[k])) for k in range(m)] == [(q[1].min(), q[0].min(), q[1].max() + 1, q[0].max() + 1, len(q[0])) for q in (np.nonzero(want == k + 1) for k in range(m))]


def test_a_page_of_text_is_searched_in_few_calls(monkeypatch):
    a = render.page_raster(*(lambda f: (f, f.pages()[0]))(fonts.File(fonts.make_pdf(["one two three"], "abc", 3))), 72)[0]
    calls, nonzero = [], np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda *x: calls.append(1) or nonzero(*x))
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or nonzero(np.ravel(x))[0])
    assert raster.regions(a) and len(calls) < 20  # one for each row of pixels before
