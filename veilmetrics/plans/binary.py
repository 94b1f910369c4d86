"""Queries over binary sources: PDF bytes made from documents, and drawn page rasters."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import streaming
from ..operators import analysis as an
from ..operators import detection, raster
from ..operators import typography as ty
from ..sources import fonts, layout, lines, pdf, render

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def files(spark, d):
    return pdf.rendered(spark.read.parquet(f"{d}/documents.parquet"))


@query("s04_page_boxes", "select 'doc' || doc_id || '.pdf' as path, 0::int as page_index, 612.0::double as width, 792.0::double as height from documents")
def s04(spark, d):
    return pdf.read_pages(files(spark, d)).select("path", "page_index", (F.col("box")[2] - F.col("box")[0]).alias("width"), (F.col("box")[3] - F.col("box")[1]).alias("height"))


@query("s09_batch_manifest", "select 'ok' as status, count(*) as files from documents union all select 'error', 1")
def s09(spark, d):
    bad = spark.createDataFrame([("bad.pdf", b"no PDF")], "path string, content binary")
    return pdf.manifest(pdf.read_pages(files(spark, d).unionByName(bad))).groupBy("status").agg(F.count("*").alias("files"))


@query("t01_text_runs", "with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from documents) select 'doc' || doc_id || '.pdf' as path, ceil(len(w) / 10)::bigint as n from w where len(w) > 0")
def t01(spark, d):
    return pdf.read_runs(files(spark, d)).where("text is not null").groupBy("path").agg(F.count("*").alias("n"))


@query("t02_text_hit_width", "select round(0.6 * 12 * length(w), 4)::double as width, count(*) as n from (select unnest(regexp_split_to_array(trim(text), '\\s+')) as w from documents) group by 1")
def t02(spark, d):
    w = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split(F.trim("text"), r"\s+")).alias("w"))
    return w.groupBy(F.round(ty.simple_width(F.length("w"), F.lit(12)), 4).alias("width")).agg(F.count("*").alias("n"))


@query("d02_drawn_rects", "select 'doc' || doc_id || '.pdf' as path, 72.0::double as x0, 694.0::double as y0, 162.0::double as x1, 706.0::double as y1 from documents")
def d02(spark, d):
    return pdf.read_rects(files(spark, d)).select("path", "x0", "y0", "x1", "y1")


@query("v08_grouped_span", layout.SQL + """, s as (select b.doc_id, b.token_idx, r.x0, r.y0, r.x1, r.y1, b.x0 - r.x1 as gap from box b join run r on b.doc_id = r.doc_id and b.line = r.line where r.x1 <= b.x0),
 c as (select *, coalesce(lag(x0) over w - x1 <= 6, true) as near from s window w as (partition by doc_id, token_idx order by gap, x0)), k as (select *, bool_and(near) over (partition by doc_id, token_idx order by gap, x0) as chained from c)
select doc_id, token_idx, count(*) as n, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from k where chained group by 1, 2""")
def v08(spark, d):
    return lines.grouped_spans(spark.read.parquet(f"{d}/documents.parquet"))


@query("z01_windowed_timings", "select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def z01(spark, d):
    return streaming.windowed_timings(spark.read.parquet(f"{d}/events.parquet"))


def font_files(spark, d):
    """A page for each document: its first three words by glyph names, its first thirty by ToUnicode, a path and a form placed by doc_id."""

    def run(batches):
        for b in pdf.slices(batches):
            rows = []
            for i, text in zip(b["doc_id"], b["text"]):
                w = (text or "").split()[:30]
                first = "".join(c for c in " ".join(w[:3]) if c.isascii() and (c.isalpha() or c in " .,"))
                rows.append((f"doc{i}.pdf", fonts.make_pdf([" ".join(w[k : k + 10]) for k in range(0, len(w), 10)], first, int(i))))
            yield pd.DataFrame(rows, columns=["path", "content"])

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs.mapInPandas(run, "path string, content binary")


W30 = "w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')[1:30] as w from documents)"


@query("t11_font_truth", f"with {W30}, l as (select doc_id, unnest([w[1:10], w[11:20], w[21:30]]) as l, unnest([0, 1, 2]) as k from w) select 'doc' || doc_id || '.pdf' as path, k::int as line, array_to_string(l, ' ') as text from l where len(l) > 0")
def t11(spark, d):
    r = fonts.read_shown(font_files(spark, d)).where("font_key = 'F2'")
    return r.select("path", F.floor((720 - F.col("y1")) / 14).cast("int").alias("line"), "text")


@query("t13_glyph_names", f"with {W30} select 'doc' || doc_id || '.pdf' as path, regexp_replace(array_to_string(w[1:3], ' '), '[^A-Za-z .,]', '', 'g') as text from w where regexp_replace(array_to_string(w[1:3], ' '), '[^A-Za-z .,]', '', 'g') <> ''")
def t13(spark, d):
    return fonts.read_shown(font_files(spark, d)).where("font_key = 'F1'").select("path", "text")


@query("t03_font_occurrences", f"with {W30}, f as (select doc_id, length(regexp_replace(array_to_string(w[1:3], ' '), '[^A-Za-z .,]', '', 'g')) > 0 as has, len(w) as n from w) select 'Sans' as family, 'Bold' as variant, count(*) as n, 36.0::double as width from f where has union all select 'Courier', null, sum(ceil(n / 10))::bigint, 30.0::double from f")
def t03(spark, d):
    o = fonts.occurrences(fonts.read_shown(font_files(spark, d)))
    return o.groupBy("family", "variant").agg(F.count("*").alias("n"), F.round(F.max(F.col("x1") - F.col("x0")), 4).alias("width"))


@query("t18_font_inventory", "select k as font_key, wc as width_class, uc as unicode_class, us as unicode_source, count(*) as n from documents, (values ('F1', 'pdf_width_table', 'encoding_differences', 'encoding_dictionary'), ('F2', 'standard_14_font', 'to_unicode', case when 1 = 1 then 'to_unicode' end), ('F3', 'standard_14_font', 'named_encoding', 'named_encoding')) v(k, wc, uc, us) where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' and regexp_matches(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:3], ' '), '[A-Za-z .,]') group by all")
def t18(spark, d):
    t = fonts.inventory(fonts.read_truth(font_files(spark, d)))
    ok = t.withColumn("_ok", F.min(F.when(F.col("font_key") == "F1", F.size("widths") > 0).otherwise(F.lit(True))).over(Window.partitionBy("path")))
    return ok.where("_ok").groupBy("font_key", "width_class", "unicode_class", "unicode_source").agg(F.count("*").alias("n"))


@query("t01_font_run_width", f"with {W30} select 'doc' || doc_id || '.pdf' as path, round(length(regexp_replace(array_to_string(w[1:3], ' '), '[^A-Za-z .,]', '', 'g')) * 500 * 12 / 1000::double, 4) as width from w where regexp_replace(array_to_string(w[1:3], ' '), '[^A-Za-z .,]', '', 'g') <> ''")
def t01b(spark, d):
    return fonts.read_shown(font_files(spark, d)).where("font_key = 'F1'").select("path", F.round(F.col("x1") - F.col("x0"), 4).alias("width"))


@query("d03_path_rects", "select 'doc' || doc_id || '.pdf' as path, (72 + doc_id % 100)::double as x0, 50.0::double as y0, (172 + doc_id % 100)::double as x1, 70.0::double as y1 from documents")
def d03(spark, d):
    return fonts.read_drawn(font_files(spark, d)).where("kind = 'drawn_path_rect'").select("path", "x0", "y0", "x1", "y1")


@query("d04_form_rects", "select 'doc' || doc_id || '.pdf' as path, 300.0::double as x0, (100 + doc_id % 50)::double as y0, 360.0::double as x1, (112 + doc_id % 50)::double as y1 from documents")
def d04(spark, d):
    return fonts.read_drawn(font_files(spark, d)).where("kind = 'drawn_rect'").select("path", "x0", "y0", "x1", "y1")


def on_pages(files, schema, found):
    """Rows of found(at) for each page, where at(dpi) is its gray raster, width and height; files are read once, and handed on in parts."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in pdf.slices(batches):
            rows = []
            for path, data in zip(b["path"], b["content"]):
                f = fonts.File(bytes(data))
                for page, p in enumerate(f.pages()):
                    seen = render.marks(f, p)
                    rows += [(path, page, *r) for r in found(lambda dpi, seen=seen: render.draw(*seen, dpi, tones=raster.TONES))]
            yield pd.DataFrame(rows, columns=["path", "page_index", *columns])

    return files.select("path", "content").mapInPandas(run, f"path string, page_index int, {schema}")


RECTS_AT = "r as (select doc_id, 72 + doc_id % 100 as x0, 50 as y0, 172 + doc_id % 100 as x1, 70 as y1 from documents union all select doc_id, 300, 100 + doc_id % 50, 360, 112 + doc_id % 50 from documents)"
GRID = "px0 int, py0 int, px1 int, py1 int, tone double, share double, score double"


def covering(regions, dpi, looked_at=None):
    """Which of a page's two black rectangles a region covers: their centres, in pixels. Regions that are not looked at stay, without a rectangle."""
    i = F.regexp_extract("path", "doc([0-9]+)", 1).cast("long")
    px, py = lambda c: c["x"] * dpi / 72, lambda c: (792 - c["y"]) * dpi / 72
    inside = lambda c: (px(c) >= F.col("px0")) & (px(c) <= F.col("px1")) & (py(c) >= F.col("py0")) & (py(c) <= F.col("py1"))
    centres = F.array(F.struct((122 + i % 100).alias("x"), F.lit(60).alias("y")), F.struct(F.lit(330).alias("x"), (106 + i % 50).alias("y")))
    if looked_at is None:
        return regions.withColumn("c", F.explode_outer(centres)).where(inside(F.col("c")))
    return regions.withColumn("c", F.explode_outer(F.filter(centres, lambda c: looked_at & inside(c))))


@query("d09_dark_grid", f"with {RECTS_AT} select 'doc' || doc_id || '.pdf' as path, x0 < 300 and y0 = 50 as is_path, true as found from r")
def d09(spark, d):
    r = on_pages(font_files(spark, d), GRID, lambda at: raster.grid_regions(at(96)[0]))
    return covering(r, 96).select("path", (F.col("c.y") == 60).alias("is_path"), F.lit(True).alias("found")).distinct()


@query("d16_two_resolutions", "select 'doc' || doc_id || '.pdf' as path, 'highpass' as source, true as both_found from documents")
def d16(spark, d):
    """A pass at 18 dots an inch selects pages, one at 96 looks at these alone; where it finds nothing, the first one's regions stay."""

    def find(at):
        low = [(18, *r) for r in raster.grid_regions(at(18)[0])]
        return low + [(96, *r) for r in raster.grid_regions(at(96)[0])] if low else []

    r = on_pages(font_files(spark, d), "dpi int, " + GRID, find)
    # of a page: that it was selected, and which rectangles its second pass covers
    picked = covering(r, 96, F.col("dpi") == 96).groupBy("path").agg(*[F.max(F.coalesce(F.col("c.x") == x if k else F.col("c.y") == x, F.lit(False))).alias(name) for name, k, x in (("first", 0, 60), ("second", 1, 330))])
    return picked.select("path", F.when(F.col("first") | F.col("second"), "highpass").otherwise("prepass").alias("source"), (F.col("first") & F.col("second")).alias("both_found"))


@query("v06_dark_pixels", f"with {RECTS_AT} select 'doc' || doc_id || '.pdf' as path, y0 = 50 as is_path, ((x1 - x0) * (y1 - y0))::bigint as dark from r")
def v06(spark, d):
    def run(batches):
        for b in pdf.slices(batches):
            rows = []
            for path, data in zip(b["path"], b["content"]):
                i = int(path[3:-4])
                for _, a, _, h in render.rasters(bytes(data), 72):
                    g = raster.gray(a)
                    rows += [(path, True, raster.dark_pixels(g, 72 + i % 100, int(h) - 70, 172 + i % 100, int(h) - 50, 40)), (path, False, raster.dark_pixels(g, 300, int(h) - 112 - i % 50, 360, int(h) - 100 - i % 50, 40))]
            yield pd.DataFrame(rows, columns=["path", "is_path", "dark"])

    return font_files(spark, d).mapInPandas(run, "path string, is_path boolean, dark long")


@query("v04_components", f"with {RECTS_AT} select 'doc' || doc_id || '.pdf' as path, x0::int as px0, (792 - y1)::int as py0, x1::int as px1, (792 - y0)::int as py1, ((x1 - x0) * (y1 - y0))::bigint as pixels from r")
def v04(spark, d):
    def found(at):
        g, w, _ = at(72)
        return raster.dark_components(g, 40, 8, (0, 0, int(w), 60))

    return on_pages(font_files(spark, d), "px0 int, py0 int, px1 int, py1 int, pixels long", found).drop("page_index")


@query("s12_page_png", "select 'doc' || doc_id || '.png' as name, 306::int as width, 396::int as height from documents")
def s12(spark, d):
    def run(batches):
        for b in pdf.slices(batches):
            rows = []
            for path, data in zip(b["path"], b["content"]):
                made = list(render.rasters(bytes(data), 36))
                rows += [(render.page_name(path[:-4], i, len(made)), *render.png_size(render.png(a))) for i, a, _, _ in made]
            yield pd.DataFrame(rows, columns=["name", "width", "height"])

    return font_files(spark, d).mapInPandas(run, "name string, width int, height int")


@query("v13_crop_png", "select 'doc' || doc_id || '.pdf' as path, 110::int as width, 30::int as height from documents")
def v13(spark, d):
    def run(batches):
        for b in pdf.slices(batches):
            rows = []
            for path, data in zip(b["path"], b["content"]):
                i = int(path[3:-4]) % 100
                around = lambda _, h, i=i: (67 + i, int(h) - 75, 177 + i, int(h) - 45)
                for _, a, _, _ in render.rasters(bytes(data), 72, around):  # only these pixels are drawn
                    rows.append((path, *render.png_size(render.png(render.crop(a, 0, 0, 110, 30, [(5, 5, 105, 25, (255, 0, 0))])))))
            yield pd.DataFrame(rows, columns=["path", "width", "height"])

    return font_files(spark, d).mapInPandas(run, "path string, width int, height int")


@query("s11_annotated_pdf", f"with {W30} select 'doc' || doc_id || '.pdf' as path, 'seen (' || doc_id || ')' as overlay, ceil(len(w) / 10)::bigint as own_lines from w")
def s11(spark, d):
    def run(batches):
        for b in pdf.slices(batches):
            yield pd.DataFrame([(p, render.annotate(bytes(c), [(0, 72, 300, 172, 320, f"seen ({p[3:-4]})", 9)])) for p, c in zip(b["path"], b["content"])], columns=["path", "content"])

    s = fonts.read_shown(font_files(spark, d).mapInPandas(run, "path string, content binary"))
    return s.groupBy("path").agg(F.max(F.when(F.col("font_key") == "VeilOverlay", F.col("text"))).alias("overlay"), F.count_if(F.col("font_key") == "F2").alias("own_lines"))


@query("s13_zip_bundles", "select (doc_id % 7)::varchar as key, case when doc_id % 14 < 7 then 'Doc' else 'doc' end || doc_id // 14 || case when doc_id % 14 < 7 then '.txt' else ' (2).txt' end as name, octet_length(encode(coalesce(text, '')))::bigint as size from documents")
def s13(spark, d):
    i = F.col("doc_id")
    name = F.concat(F.when(i % 14 < 7, "Doc").otherwise("doc"), F.floor(i / 14).cast("string"), F.lit(".txt"))
    files = spark.read.parquet(f"{d}/documents.parquet").select((i % 7).alias("k"), name.alias("n"), F.coalesce("text", F.lit("")).cast("binary").alias("c"))
    files = files.where(F.col("n").isNotNull())

    def opened(batches):
        import io
        import zipfile

        for b in batches:
            for key, data in zip(b["key"], b["zip"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield pd.DataFrame([(key, e.filename, len(z.read(e))) for e in z.infolist()], columns=["key", "name", "size"])  # read checks the crc32

    return render.bundles(files, "k", "n", "c").select("key", "zip").mapInPandas(opened, "key string, name string, size long")


@query("p28_complexity", "with l as (select url, unnest(string_split(coalesce(html, ''), chr(10))) as line from pages) select url as path, count(*) as lines, count(*) filter (where not regexp_matches(trim(line), '^(//|#|--|$)')) as code from l group by 1 order by code desc, path limit 12")
def p28(spark, d):
    return an.complexity(spark.read.parquet(f"{d}/pages.parquet"), "url", "html")


@query("f03_hide_details", "select p_brand as family, count(*) as n from part group by 1")
def f03(spark, d):
    f = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("family")).agg(F.count("*").alias("n"), F.collect_set("p_type").alias("occurrences"))
    return an.without_details(f, "occurrences", show=False)


PROFILED = "region int, px0 int, py0 int, px1 int, py1 int, pixels int, fill double, dark double, spread double, verdict string"


@query("d13_dark_regions", f"with {RECTS_AT} select 'doc' || doc_id || '.pdf' as path, x0::int as px0, (792 - y1)::int as py0, x1::int as px1, (792 - y0)::int as py1, ((x1 - x0) * (y1 - y0))::int as pixels, 1.0::double as fill, 1.0::double as dark, 0.0::double as spread, 'selected_black_component' as verdict from r")
def d13(spark, d):
    """Regions that are rejected, most of them letters, don't leave their task."""
    r = on_pages(font_files(spark, d), PROFILED, lambda at: [x for x in raster.gray_regions(at(72)[0]) if x[-1] == "selected_black_component"])
    return r.drop("page_index", "region")


@query("v05_dominant_component", "select 'doc' || doc_id || '.pdf' as path, (72 + doc_id % 100)::int as px0, 722::int as py0, (172 + doc_id % 100)::int as px1, 742::int as py1, 2000::int as pixels, 1.0::double as fill from documents")
def v05(spark, d):
    return d13(spark, d).groupBy("path").agg(F.max_by(F.struct("px0", "py0", "px1", "py1", "pixels", "fill"), F.struct("pixels", -F.col("px0"), -F.col("py0"))).alias("b")).select("path", "b.*")


@query("d01_annotation_scan", "select 'doc' || doc_id || '.pdf' as path, k as seq, (72 + k * 10)::double as x0, 200.0::double as y0, (90 + k * 10)::double as x1, 212.0::double as y1 from documents, (values (0), (1)) v(k) where k = 0 or doc_id % 3 = 0")
def d01(spark, d):
    a = fonts.read_annotations(font_files(spark, d))
    return detection.annotation_hits(a, ["subtype", "rt", "it", "ft", "nm", "contents"]).select("path", F.col("seq").cast("int").alias("seq"), "x0", "y0", "x1", "y1")
