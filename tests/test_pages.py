"""Page search: gray rasters of inked rows alone, parts of files, one pass over each file."""

import os
from collections import deque

import duckdb
import numpy as np
import pandas as pd
import pytest

from veilmetrics.operators import raster
from veilmetrics.plans import binary
from veilmetrics.sources import fonts, render

from .test_oracle import SF, rows

PAGES = ["d09_dark_grid", "d13_dark_regions", "d16_two_resolutions", "v04_components", "v05_dominant_component"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", PAGES)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert rows(binary.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(binary.ORACLE_SQL[name]).df())


class Files:
    """Stands for a table of files: gives the function that would run in its tasks."""

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        return run


def test_pages_are_handed_on_in_parts():
    """A batch's rows of all files were held at once."""
    batch = pd.DataFrame({"path": [f"{i}.pdf" for i in range(450)], "content": [fonts.make_pdf(["a b"], "Abc", 3)] * 450})
    made = list(binary.on_pages(Files(), "width int", lambda at: [(at(18)[0].shape[1],)])([batch]))
    assert [len(p) for p in made] == [200, 200, 50] and set(pd.concat(made)["width"]) == {153}


def test_a_file_is_read_once_for_both_passes(spark):
    """The second pass read and parsed all files again and shuffled their bytes for a join."""
    assert "Join" not in binary.QUERIES["d16_two_resolutions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def flooded(mask):
    labels, n = np.zeros(mask.shape, np.int32), 0
    for y, x in zip(*np.nonzero(mask)):
        if not labels[y, x]:
            n += 1
            labels[y, x], todo = n, deque([(y, x)])
            while todo:
                a, b = todo.popleft()
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not labels[c, d]:
                        labels[c, d] = n
                        todo.append((c, d))
    return labels, n


def test_equal_rows_are_one_run():
    r = np.random.default_rng(1)
    for _ in range(30):
        mask = np.repeat(np.repeat(r.random(r.integers(1, 14, 2)) < r.choice([0.2, 0.5, 0.8]), 3, 0), 2, 1)
        (labels, n), (want, m) = raster.components(mask), flooded(mask)
        assert n == m and (labels == want).all()


def test_cells_of_blank_rows_are_not_summed_up():
    """Means of all cells, whatever is summed up: light, dark and gray pages, cells of uneven size."""
    r = np.random.default_rng(2)
    for paper in (255, 90, 10):
        for _ in range(15):
            g = np.full(r.integers(18, 130, 2), paper, np.uint8)
            for _ in range(3):
                y, x = r.integers(0, g.shape[0] - 10), r.integers(0, g.shape[1] - 10)
                g[y : y + r.integers(2, 20), x : x + r.integers(2, 40)] = r.choice([0, 60, 89])
            rows_, cols = raster.bins(g.shape[0]), raster.bins(g.shape[1])
            mean = np.array([[g[a:b, c:d].mean() for c, d in zip(cols[:-1], cols[1:])] for a, b in zip(rows_[:-1], rows_[1:])])
            labels, n = flooded(mean <= max(min(0.65 * g.mean(), 120.0), float(g.min()) + 5, 32.0))
            want = []
            for k in range(1, n + 1):
                ys, xs = np.nonzero(labels == k)
                box = (int(cols[xs.min()]), int(rows_[ys.min()]), int(cols[xs.max() + 1]), int(rows_[ys.max() + 1]))
                share = sum((rows_[y + 1] - rows_[y]) * (cols[x + 1] - cols[x]) for y, x in zip(ys, xs)) / g.size
                if 0.0005 <= share <= 0.9 and min(box[2] - box[0], box[3] - box[1]) >= 4:
                    want.append(box)
            assert [x[:4] for x in raster.grid_regions(g)] == want


def test_a_gray_raster_is_the_gray_of_the_page():
    f = fonts.File(fonts.make_pdf(["some words of a line", "and more"], "Abc", 33))
    seen = render.marks(f, f.pages()[0])
    for dpi in (18, 72, 96):
        rgba, gray = render.draw(*seen, dpi)[0], render.draw(*seen, dpi, tones=raster.TONES)[0]
        assert gray.ndim == 2 and (gray == raster.gray(rgba)).all() and raster.gray_regions(gray) == raster.regions(rgba)
