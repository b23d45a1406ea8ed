"""Bounding-box expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def box_corners(hpos, vpos, width, height) -> Column:
    """(h, v, w, h) -> struct(left, upper, right, lower) of doubles."""
    h, v = _c(hpos).cast("double"), _c(vpos).cast("double")
    return F.struct(h.alias("left"), v.alias("upper"),
                    (h + _c(width).cast("double")).alias("right"),
                    (v + _c(height).cast("double")).alias("lower"))


def box_normalise(box, page_width, page_height) -> Column:
    """Box in per-mille of the page: x / width * 1000, y / height * 1000."""
    b = _c(box)
    w, h = _c(page_width).cast("double"), _c(page_height).cast("double")
    k = F.lit(1000.0)
    return F.struct((F.try_divide(b["left"], w) * k).alias("left"),
                    (F.try_divide(b["upper"], h) * k).alias("upper"),
                    (F.try_divide(b["right"], w) * k).alias("right"),
                    (F.try_divide(b["lower"], h) * k).alias("lower"))
