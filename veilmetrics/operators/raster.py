"""Dark regions of page rasters: gray values, connected components, profiles, accept or reject. One page is one task's unit."""

from __future__ import annotations

import numpy as np
import pandas as pd

REGIONS = "page_id long, region int, x0 int, y0 int, x1 int, y1 int, area int, fill double, dark double, spread double, verdict string"
# Limits of the region test.
MIN_FILL, MIN_BLACK, MIN_DARK, MAX_SPREAD, BLACK, DARK = 0.46, 0.72, 0.90, 12.0, 40, 96


def gray(rgba: np.ndarray) -> np.ndarray:
    """Rec. 709 luma, truncated. Pages are white for the most part: only pixels that are not are worked out."""
    luma = lambda a: (a[..., 0] * 0.2126 + a[..., 1] * 0.7152 + a[..., 2] * 0.0722).astype(np.uint8)
    out = np.full(rgba.shape[:2], luma(np.full((1, 4), 255, np.uint8))[0], np.uint8)
    inked = np.ascontiguousarray(rgba).view(np.uint32)[..., 0] != 0xFFFFFFFF
    out[inked] = luma(rgba[inked])
    return out


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected labels from 1 on, by union of row runs; runs are found for all rows at once, and equal rows one below the other are taken as one."""
    labels = np.zeros(mask.shape, np.int32)
    rows = np.flatnonzero(mask.any(1)) if mask.size else np.zeros(0, int)
    dark = mask[rows]
    fresh = np.append(True, (np.diff(rows) != 1) | (dark[1:] != dark[:-1]).any(1))[: len(rows)]
    tops, ends_of = rows[fresh], np.append(rows[np.flatnonzero(fresh)[1:] - 1], rows[-1:]) + 1
    step = np.diff(np.pad(dark[fresh].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (at, starts), ends = np.nonzero(step == 1), np.nonzero(step == -1)[1]
    ys, below, starts, ends = tops[at].tolist(), ends_of[at].tolist(), starts.tolist(), ends.tolist()
    parent = list(range(len(ys)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0  # the first run of the rows above that can still touch
    for k, (y, a, z) in enumerate(zip(ys, starts, ends)):
        while above < k and (below[above] < y or (below[above] == y and ends[above] <= a)):
            above += 1
        j = above
        while j < k and below[j] == y and starts[j] < z:
            p, q = find(j), find(k)
            parent[max(p, q)] = min(p, q)
            j += 1
    roots = np.array([find(k) for k in range(len(ys))], int)
    kept = np.unique(roots)
    for y, end, a, z, name in zip(ys, below, starts, ends, (np.searchsorted(kept, roots) + 1).tolist()):
        labels[y:end, a:z] = name
    return labels, len(kept)


def measured(labels: np.ndarray, n: int):
    """Pixels (ys, xs, label from 0), and of each label the count and x0, y0, x1, y1."""
    rows = np.flatnonzero(labels.any(1)) if labels.size else np.zeros(0, int)
    ys, xs = np.nonzero(labels[rows])
    of = labels[rows][ys, xs] - 1
    ys = rows[ys]
    lo, hi = np.full((2, n), max(labels.shape, default=0)), np.zeros((2, n), int)
    for k, v in enumerate((xs, ys)):
        np.minimum.at(lo[k], of, v)
        np.maximum.at(hi[k], of, v + 1)
    return (ys, xs, of), np.bincount(of, minlength=n), (lo[0], lo[1], hi[0], hi[1])


def parts(labels: np.ndarray, n: int):
    """Rows and columns of the pixels of each label, all found in one pass."""
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs]
    order = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[order], np.arange(1, n + 2))
    for a, z in zip(edge[:-1], edge[1:]):
        yield ys[order[a:z]], xs[order[a:z]]


def column_runs(mask: np.ndarray, share: float = 0.5, bridge: int = 1) -> list[tuple[int, int]]:
    """Runs of columns that are dark for at least this share; gaps of `bridge` columns at most are filled."""
    on = mask.mean(0) >= share
    for i in range(1, len(on) - bridge):
        if not on[i] and on[i - 1] and on[i : i + bridge + 1].any():
            on[i] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def verdict(fill: float, black: float, dark: float, spread: float) -> str:
    if fill < MIN_FILL:
        return "rejected_low_fill_ratio"
    if black < MIN_BLACK:
        return "rejected_low_black_ratio"
    if dark < MIN_DARK:
        return "rejected_low_dark_ratio"
    if spread > MAX_SPREAD:
        return "rejected_high_channel_spread"
    return "selected_black_component"


#: The gray of a pixel whose channels are equal.
TONES = gray(np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 4, 2))[0]


def regions(rgba: np.ndarray, min_area: int = 8) -> list[tuple]:
    return gray_regions(gray(rgba), rgba, min_area)


def gray_regions(g: np.ndarray, rgba: np.ndarray | None = None, min_area: int = 8) -> list[tuple]:
    """Regions of a page of this gray; without colours its channels are equal."""
    labels, n = components(g < max(min(0.65 * g.mean(), 120), int(g.min()) + 5, 32))
    (ys, xs, of), area, (x0, y0, x1, y1) = measured(labels, n)
    own = g[ys, xs]
    px = rgba[ys, xs, :3].astype(int) if rgba is not None else np.zeros((len(ys), 1), int)
    share = lambda v: np.bincount(of, v, n) / np.maximum(area, 1)
    fill, black, dark, spread = area / np.maximum((x1 - x0) * (y1 - y0), 1), share(own < BLACK), share(own < DARK), share(px.max(1) - px.min(1)) if len(px) else np.zeros(n)
    out = []
    for k in np.flatnonzero(area >= min_area).tolist():
        f, b, d, s = float(fill[k]), float(black[k]), float(dark[k]), float(spread[k])
        out.append((len(out), int(x0[k]), int(y0[k]), int(x1[k]), int(y1[k]), int(area[k]), round(f, 6), round(d, 6), round(s, 6), verdict(f, b, d, s)))
    return out


def bins(size: int) -> np.ndarray:
    """Edges of about size / 4 cells, 16 to 512; a cell is a pixel on small sides."""
    n = size if size <= 16 else min(max(-(-size // 4), 16), 512, size)
    return np.unique(np.arange(n + 1) * size // max(n, 1))


def grid_regions(g: np.ndarray) -> list[tuple]:
    """(x0, y0, x1, y1, mean gray, share of the page, score) of dark regions on a grid of cell means.

    Cells no lighter than the threshold that touch at a side make a region; those of under .0005 or over .9 of the page, or
    with a side below four pixels, are none. The score is .55 darkness, .35 coverage (full at .12) and .10 aspect (full at 4).
    """
    h, w = g.shape
    if not g.size:
        return []
    rows, cols = bins(h), bins(w)
    high = np.diff(rows)
    area = high[:, None] * np.diff(cols)[None, :]
    # rows of cells that are all as light as the page's lightest pixel have that mean: only the others are summed up
    low, paper = g.min(1), int(g.max())
    inked = np.minimum.reduceat(low, rows[:-1]) < paper
    part = g[np.repeat(inked, high)]
    average = (paper * (g.size - part.size) + int(part.sum(dtype=np.int64))) / g.size
    limit = max(min(0.65 * average, 120.0), float(low.min()) + 5, 32.0)
    mean = np.full(area.shape, float(paper))
    if part.size:
        sums = np.add.reduceat(np.add.reduceat(part, (np.cumsum(high[inked]) - high[inked]), 0, dtype=np.int64), cols[:-1], 1)
        mean[inked] = sums / area[inked]
    labels, n = components(mean <= limit)
    (ys, xs, of), _, (bx0, by0, bx1, by1) = measured(labels, n)
    pixels = np.bincount(of, area[ys, xs], n).astype(int)
    x0, x1, y0, y1 = cols[bx0], cols[bx1], rows[by0], rows[by1]
    share, short, long = pixels / g.size, np.minimum(x1 - x0, y1 - y0), np.maximum(x1 - x0, y1 - y0)
    out = []
    for k in np.flatnonzero((share >= 0.0005) & (share <= 0.9) & (short >= 4)).tolist():
        own = of == k
        tone = float((mean[ys[own], xs[own]] * area[ys[own], xs[own]]).sum() / pixels[k])
        score = 0.55 * (1 - tone / 255) + 0.35 * min(share[k] / 0.12, 1) + 0.10 * min(min(long[k] / short[k], 12) / 4, 1)
        out.append((int(x0[k]), int(y0[k]), int(x1[k]), int(y1[k]), round(tone, 4), round(float(share[k]), 6), round(float(score), 6)))
    return out


def dark_pixels(g: np.ndarray, x0: int, y0: int, x1: int, y1: int, limit: int = DARK) -> int:
    """How many pixels of the rectangle, as far as it is on the page, are below the limit."""
    return int((g[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] < limit).sum())


def dark_components(g: np.ndarray, limit: int = DARK, least: int = 8, excluded: tuple | None = None) -> list[tuple]:
    """(x0, y0, x1, y1, pixels) of 4-connected dark parts outside an excluded rectangle, `least` pixels at least."""
    mask = g < limit
    if excluded:
        x0, y0, x1, y1 = (max(0, v) for v in excluded)
        mask = mask.copy()
        mask[y0:y1, x0:x1] = False
    _, area, box = measured(*components(mask))
    return [(*(int(e[k]) for e in box), int(area[k])) for k in np.flatnonzero(area >= least).tolist()]


def draw_page(page_id: int, width: int = 120, height: int = 80) -> np.ndarray:
    """A made-up page: black bars, a coloured bar and a thin line, placed by page_id."""
    a = np.full((height, width, 4), 255, np.uint8)
    x, y = page_id * 7 % 60, page_id * 5 % 30
    a[y : y + 10, x : x + 40, :3] = 0
    a[y + 20 : y + 28, x + 5 : x + 35, :3] = (70, 20, 20)
    np.fill_diagonal(a[y + 35 : y + 50, x : x + 15, 0], 0)
    np.fill_diagonal(a[y + 35 : y + 50, x : x + 15, 1], 0)
    np.fill_diagonal(a[y + 35 : y + 50, x : x + 15, 2], 0)
    return a


def detect(batches):
    """For mapInPandas: rows of page_id, each page drawn and searched."""
    for pdf in batches:
        rows = [(int(p), *r) for p in pdf["page_id"] for r in regions(draw_page(int(p)))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in REGIONS.split(", ")])
