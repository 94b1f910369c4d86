"""A page layout derived from documents: every word gets a line, a page and a box from glyph widths.

Positions are sums of integer units, multiplied by the font size once, so that every engine gets the same numbers. They are
worked out within a document: nothing is shuffled. Words are cut and measured in Arrow batches, since a fold over the
characters of every word as a column expression costs some ten times as much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.widths import FALLBACK, HELVETICA

WORDS_PER_LINE, LINES_PER_PAGE, SPACE = 12, 50, 278
TARGET = "^[A-Za-z]{4,20}$"


def _cutter():
    """A closure, so that workers need not import this package."""
    # units of a byte of UTF-8: a character beyond ASCII counts at its first byte
    units_of = np.array([HELVETICA[b - 32] if 32 <= b < 127 else 0 if 128 <= b < 192 else FALLBACK for b in range(256)], np.int64)
    space, per_line = SPACE, WORDS_PER_LINE

    def cut(b):
        """Of a batch of doc_id and text: each word's document, index, text, units and cum."""
        lists = pc.split_pattern_regex(pc.utf8_trim(b.column("text").cast(pa.large_string()), " "), "[ \\t\\n\\x0b\\f\\r]+")
        flat, n = pa.array(lists.flatten()), pc.list_value_length(lists).to_numpy().astype(np.int64)
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        upto = np.concatenate([[0], np.cumsum(units_of[data])])[offsets - offsets[0]]
        units = np.diff(upto)
        idx = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        before = np.concatenate([[0], np.cumsum(units + space)])
        cum = before[:-1] - before[np.arange(len(flat)) - idx % per_line]
        doc = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), n)))
        return doc, idx, flat.cast(pa.string()), units, cum

    return cut


def words(docs: DataFrame) -> DataFrame:
    """doc_id, token_idx, token, units, cum (units and spaces before the word in its line)."""
    _cut = _cutter()

    def cut(batches):
        for big in batches:
            for at in range(0, big.num_rows, 500):
                doc, idx, token, units, cum = _cut(big.slice(at, 500).drop_null())
                yield pa.RecordBatch.from_arrays([doc, pa.array(idx), token, pa.array(units), pa.array(cum)], names=["doc_id", "token_idx", "token", "units", "cum"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, token_idx long, token string, units long, cum long")


def tokens(docs: DataFrame) -> DataFrame:
    """words with line, page_index, font_size, x0, y0, x1, y1 and is_box."""
    t = words(docs).withColumns({"line": F.floor(F.col("token_idx") / WORDS_PER_LINE), "font_size": 10 + F.pmod("doc_id", F.lit(3))})
    t = t.withColumns({"page_index": F.floor(F.col("line") / LINES_PER_PAGE), "y1": (720 - 14 * (F.col("line") % LINES_PER_PAGE)).cast("double")})
    t = t.withColumns({
        "x0": F.lit(72.0) + F.col("font_size") * F.col("cum") / F.lit(1000.0), "x1": F.lit(72.0) + F.col("font_size") * (F.col("cum") + F.col("units")) / F.lit(1000.0), "y0": F.col("y1") - F.col("font_size"),
        "is_box": F.rlike("token", F.lit(TARGET)) & ((F.col("doc_id") * 31 + F.col("token_idx") * F.col("token_idx") * 17 + F.col("token_idx")) % 41).isin(7, 8)})
    return t


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_index and `toks`, a page's words in order, 600 at most, with the places that `tokens` gives them.

    Made in the tasks that cut the texts: a page is never shuffled. Words are placed by numpy, since column expressions on the
    elements of arrays are interpreted.
    """
    most, fields = WORDS_PER_LINE * LINES_PER_PAGE, ["token_idx", "token", "font_size", "x0", "y0", "x1", "y1", "is_box"]
    _cut, per_line, per_page, target = _cutter(), WORDS_PER_LINE, LINES_PER_PAGE, TARGET

    def cut(batches):
        for big in batches:
            for at in range(0, big.num_rows, 100):
                doc, idx, token, units, cum = _cut(big.slice(at, 100).drop_null())
                i, line = doc.to_numpy(), idx // per_line
                size, y1 = 10 + i % 3, (720 - 14 * (line % per_page)).astype(np.float64)
                box = pc.match_substring_regex(token, target).to_numpy(zero_copy_only=False).astype(bool) & np.isin(np.fmod(i * 31 + idx * idx * 17 + idx, 41), (7, 8))
                x0, x1 = 72.0 + size * cum / 1000.0, 72.0 + size * (cum + units) / 1000.0
                first = np.flatnonzero(idx % most == 0)
                each = pa.StructArray.from_arrays([pa.array(idx), token, *map(pa.array, (size, x0, y1 - size, x1, y1, box))], names=fields)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(idx)), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(first)), pa.array(idx[first] // most), lists], names=["doc_id", "page_index", "toks"])

    kind = "doc_id long, page_index long, toks array<struct<token_idx:long,token:string,font_size:long,x0:double,y0:double,x1:double,y1:double,is_box:boolean>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kind)


def boxes(tok: DataFrame) -> DataFrame:
    """Redaction boxes: redacted words, half a point wider on each side."""
    return tok.where("is_box").select("doc_id", "page_index", "line", "token_idx", F.col("token").alias("target"), "font_size", (F.col("x0") - 0.5).alias("x0"), (F.col("y0") - 0.5).alias("y0"), (F.col("x1") + 0.5).alias("x1"), (F.col("y1") + 0.5).alias("y1"))


def runs(tok: DataFrame) -> DataFrame:
    """Visible words."""
    return tok.where("not is_box").drop("is_box")


def _seen(doc, idx) -> tuple:
    """Whether the second detector sees a box, and by how much it shifts it."""
    return (doc + idx) % 11 != 0, ((doc + idx) % 5 - 2) * F.lit(0.4)


def detected(box: DataFrame) -> DataFrame:
    """A second detector's boxes: shifted a little, every eleventh missing."""
    seen, shift = _seen(F.col("doc_id"), F.col("token_idx"))
    return box.where(seen).withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift})


def page_detected(tok):
    """For a word of `pages`: whether it is a box that the second detector sees, and the box's x0, y0, x1, y1."""
    seen, shift = _seen(F.col("doc_id"), tok["token_idx"])
    return tok["is_box"] & seen, (tok["x0"] - 0.5 + shift, tok["y0"] - 0.5, tok["x1"] + 0.5 + shift, tok["y1"] + 0.5)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same relations for DuckDB: tok, box, run, det.
SQL = f"""
with lay_w as (select doc_id, regexp_split_to_array(trim(text), '\\s+') as ws from documents),
lay_t as (select doc_id, unnest(range(0, len(ws))) as token_idx, unnest(ws) as token from lay_w),
lay_u as (select *, coalesce(list_sum(list_transform(string_split(token, ''), lambda c: case when c = '' then 0 when ascii(c) between 32 and 126 then ({HELVETICA})[ascii(c) - 31] else 600 end)), 0)::bigint as units,
    token_idx // {WORDS_PER_LINE} as line, 10 + doc_id % 3 as font_size from lay_t),
lay_c as (select *, coalesce(sum(units + {SPACE}) over (partition by doc_id, line order by token_idx rows between unbounded preceding and 1 preceding), 0)::bigint as cum from lay_u),
tok as materialized (select *, line // {LINES_PER_PAGE} as page_index, (720 - 14 * (line % {LINES_PER_PAGE}))::double as y1, 72::double + (font_size * cum)::double / 1000::double as x0,
    72::double + (font_size * (cum + units))::double / 1000::double as x1, (720 - 14 * (line % {LINES_PER_PAGE}) - font_size)::double as y0,
    regexp_matches(token, '{TARGET}') and (doc_id * 31 + token_idx * token_idx * 17 + token_idx) % 41 in (7, 8) as is_box from lay_c),
box as (select doc_id, page_index, line, token_idx, token as target, font_size, x0 - 0.5::double as x0, y0 - 0.5::double as y0, x1 + 0.5::double as x1, y1 + 0.5::double as y1 from tok where is_box),
run as (select * exclude (is_box) from tok where not is_box),
det as (select * exclude (x0, x1), x0 + ((doc_id + token_idx) % 5 - 2) * 0.4::double as x0, x1 + ((doc_id + token_idx) % 5 - 2) * 0.4::double as x1 from box where (doc_id + token_idx) % 11 <> 0)
"""
