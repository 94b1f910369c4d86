"""Command line: python -m veilmetrics INPUT OUTPUT_DIR [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .service import Config, run_batch


def arguments(argv: list[str] | None = None) -> Config:
    p = argparse.ArgumentParser(prog="veilmetrics", description="Measures what the layout around redaction boxes of PDF files gives away.")
    p.add_argument("input", help="folder with PDF files, searched at any depth")
    p.add_argument("output_dir")
    p.add_argument("--dictionary", help="text file with an entry on each line")
    p.add_argument("--no-image-analysis", dest="image_analysis", action="store_false")
    p.add_argument("--visualize", action="store_true")
    p.add_argument("--diagnostics", action="store_true", help="write the stages' timings too")
    p.add_argument("--mode", choices=("annotations", "drawn", "all"), default="all")
    return Config(**vars(p.parse_args(argv)))


def main(argv: list[str] | None = None) -> int:
    config = arguments(argv)
    spark = SparkSession.builder.appName("veilmetrics").getOrCreate()
    counts = {r["status"]: r["count"] for r in run_batch(spark, config).groupBy("status").count().collect()}
    print(f"{counts.get('ok', 0)} read, {counts.get('error', 0)} failed")
    return int(bool(counts.get("error")))


if __name__ == "__main__":
    raise SystemExit(main())
