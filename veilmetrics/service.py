"""The engine's entry surface: a configuration, timed stages, and functions from bytes or tables to reports."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detection, names
from .sources import fonts, pdf, reports


@dataclass
class Config:
    input: str = ""
    output_dir: str = ""
    dictionary: str | None = None
    image_analysis: bool = True
    visualize: bool = False
    diagnostics: bool = False
    mode: str = "all"


@dataclass
class Timings:
    """Wall-clock milliseconds of each stage, in order; a stage that fails is timed too."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, (time.perf_counter() - began) * 1000))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, elapsed_ms double")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """entry_idx and entry: the distinct entries of a text file, sorted. entry_idx follows that order without a global sort."""
    e = spark.read.text(path).select(names.normalise_entry(F.col("value")).alias("entry")).where("entry <> ''").distinct()
    return e.repartitionByRange("entry").sortWithinPartitions("entry").withColumn("entry_idx", F.monotonically_increasing_id())


def boxes(files: DataFrame, mode: str = "all") -> DataFrame:
    """path, page_index, kind and rectangle of the boxes that the detectors of a mode find in PDF bytes, the first of equal ones."""
    cols = ["path", "page_index", "seq", "kind", "x0", "y0", "x1", "y1"]
    drawn = fonts.read_drawn(files).where("kind is not null").select(*cols)
    notes = fonts.read_annotations(files).where("x0 is not null").withColumn("kind", F.lit("annotation"))
    notes = detection.annotation_hits(notes, ["subtype", "rt", "it", "ft", "nm", "contents"]).select(*cols)
    found = detection.gated({"annotations": notes, "drawn": drawn}, mode, raster=False)
    return detection.dedupe_keep_first(found, ["path", "page_index"], 2, ["src", "seq"]).drop("src", "seq")


def underlying_text(files: DataFrame, found: DataFrame) -> DataFrame:
    """Boxes with the texts that are shown under them (an empty array where there are none)."""
    runs = fonts.read_shown(files).where("text is not null").select("path", "page_index", "seq", "text", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    b = found.withColumn("_box", F.monotonically_increasing_id())
    hit = b.select("path", "page_index", "_box", "x0", "y0", "x1", "y1").join(runs, ["path", "page_index"]).where("least(x1, rx1) > greatest(x0, rx0) and least(y1, ry1) > greatest(y0, ry0)")
    texts = hit.groupBy("_box").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("underlying_text"))
    return b.join(texts, "_box", "left").withColumn("underlying_text", F.coalesce("underlying_text", F.array().cast("array<string>"))).drop("_box")


def run_bytes(spark: SparkSession, name: str, data: bytes, mode: str = "all") -> dict:
    """One file's report from its bytes: boxes with what lies under them, fonts, and the error if it can't be read."""
    files = spark.createDataFrame([(name, data)], "path string, content binary")
    pages = pdf.read_pages(files).collect()
    errors = [r["error"] for r in pages if r["error"]]
    if errors:
        return {"input": name, "status": "error", "error": errors[0], "redactions": [], "count": 0, "fonts": []}
    found = [r.asDict() for r in underlying_text(files, boxes(files, mode)).orderBy("page_index", "x0", "y0").collect()]
    used = [r.asDict() for r in fonts.inventory(fonts.read_truth(files)).where("font_key is not null").select("page_index", "font_key", "name", "width_class", "unicode_class").orderBy("page_index", "font_key").collect()]
    return {"input": name, "status": "ok", "error": None, "redactions": found, "count": len(found), "fonts": used}


def run_batch(spark: SparkSession, config: Config) -> DataFrame:
    """Reads every PDF below the input, writes boxes, fonts and the manifest below the output, and returns the manifest."""
    timings = Timings()
    files = pdf.discover(spark, config.input)
    out = config.output_dir.rstrip("/")
    with timings.stage("manifest"):
        pdf.manifest(pdf.read_pages(files)).write.mode("overwrite").parquet(f"{out}/manifest")
    with timings.stage("boxes"):
        reports.write_reports(underlying_text(files, boxes(files, config.mode)), f"{out}/redactions", by="path")
    with timings.stage("fonts"):
        fonts.inventory(fonts.read_truth(files).where("font_key is not null")).drop("codes", "widths").write.mode("overwrite").json(f"{out}/fonts")
    if config.diagnostics:
        timings.table(spark).coalesce(1).write.mode("overwrite").json(f"{out}/timings")
    return spark.read.parquet(f"{out}/manifest")
