"""The pipeline's stages, each held against its own operator on its own input."""

import os

import pytest

import corpus_pipeline as cp
from veilmetrics.llm import decontamination, registry, simhash
from veilmetrics.llm.common import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_registry():
    assert [k.split("_")[0] for k in sorted(registry.queries(), key=lambda k: int(k[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, []
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), name)
        outs.append((before, docs))
        if name != "token_store":
            assert docs.columns == columns
            assert docs.exceptAll(before).count() == 0
    (b0, a0), (b1, a1), (b2, a2), (b3, a3), (b4, a4) = outs
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in a0.collect()}
    assert len(good & {r["doc_id"] for r in b0.collect()} - kept) <= 0.05 * len(good)
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(b1).collect()}
    assert {r["doc_id"] for r in a1.collect()} == set(comp.values())
    bad = {r["doc_id"] for r in decontamination.contaminated(b2, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in a2.collect()} == {r["doc_id"] for r in b2.collect()} - bad
    assert a3.count() == b3.count()
    rows = sorted(a4.collect(), key=lambda r: r["place"])
    assert len(rows) == b4.count() and rows[0]["start"] == 0 and all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(rows, rows[1:]))


def test_oracle_of_decontamination(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(decontamination.ORACLE_SQL["op2_decontamination"]).fetchall()
    got = decontamination.op2_decontamination(spark, SF).select("doc_id", "item_id", "n_windows", "coverage", "n_slots", "reparameterised").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("n", [None, 0])
def test_stages_on_awkward_rows(spark, tmp_path, n):
    """Nulls, empty and long texts, ties, repeated rows and callers' columns of any name; and the empty table."""
    from .test_operators import ROWS

    extra = "_row long, _own_id long, _nth long, _mix long, _part long, _ms long, bucket long"
    rows = [(*r[:5], *range(7)) for r in ROWS][:n]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(n is None and 12 or 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ROWS[17][1]), (2, None), (3, "")][:n], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, str(tmp_path)), name)
        if name == "token_store":
            assert docs.count() == before.count() and docs.select("place").distinct().count() == docs.count()
            continue
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0, name
        if name == "near_duplicates":
            found = simhash.near_duplicates(before).select("label").distinct().count()
            assert docs.count() == found
        if name == "mixing":
            assert docs.exceptAll(before).count() == before.exceptAll(docs).count() == 0
        if name == "decontamination" and n is None and before.where("doc_id = 17").count():
            assert docs.where("doc_id = 17").count() == 0
