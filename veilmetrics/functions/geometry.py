"""Column expressions over rectangles and one-dimensional intervals."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlap(a0, a1, b0, b1) -> Column:
    """Length that two intervals share; negative if they are apart."""
    return F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0))


def overlap_len(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), overlap(a0, a1, b0, b1))


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0.0), _c(x1) - _c(x0)) * F.greatest(F.lit(0.0), _c(y1) - _c(y0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of rectangles with columns <prefix>x0, y0, x1, y1; 0 if the union is empty."""
    inter = overlap_len(f"{a}x0", f"{a}x1", f"{b}x0", f"{b}x1") * overlap_len(f"{a}y0", f"{a}y1", f"{b}y0", f"{b}y1")
    union = area(*[f"{a}{k}" for k in ("x0", "y0", "x1", "y1")]) + area(*[f"{b}{k}" for k in ("x0", "y0", "x1", "y1")]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def normalise_rect(x0, y0, x1, y1) -> Column:
    """A rectangle whose inverted edges are swapped."""
    return F.struct(F.least(_c(x0), _c(x1)).alias("x0"), F.least(_c(y0), _c(y1)).alias("y0"), F.greatest(_c(x0), _c(x1)).alias("x1"), F.greatest(_c(y0), _c(y1)).alias("y1"))


def redaction_score(w, h) -> Column:
    """0.2 for each sign that a rectangle of this size hides text."""
    w, h = F.abs(_c(w)), F.abs(_c(h))
    tests = [w * h >= 25, w * h >= 200, w / h >= 2, w / h >= 6, (w >= 20) & (h >= 6)]
    total = F.lit(0).cast("int")
    for t in tests:
        total = total + F.when(t, 1).otherwise(0)
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(total / F.lit(5.0))


def near_full_page(w, h, page_w=612.0, page_h=792.0) -> Column:
    w, h = _c(w), _c(h)
    return ((w >= 500) & (h >= 650)) | ((w >= F.lit(page_w) * 0.9) & (h >= F.lit(page_h) * 0.9))


def quantise(x, per_unit: int = 10_000) -> Column:
    """A sort key that small float noise cannot change."""
    return F.round(_c(x) * per_unit).cast("long")


def half_up(x: float, digits: int) -> float:
    """A number rounded as Spark's round does it."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def safe_ratio(part, whole) -> Column:
    """part / whole, and 1 where there is nothing to find."""
    return F.when(_c(whole) == 0, F.lit(1.0)).otherwise(_c(part) / _c(whole))


def nearest_rank(sorted_array, q: float) -> Column:
    """The element at index round((n - 1) * q) of a sorted array; null of an empty one."""
    a = _c(sorted_array)
    return F.get(a, F.round((F.size(a) - 1) * F.lit(q)).cast("int"))
