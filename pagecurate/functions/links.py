"""Page-link parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two page-link forms of the record archive.
PAGE_PARAM_LINK = r"#page=(\d{1,3})"        # the link names the page itself
JP2_LINK = r"(\d{3})\.jp2/_view"            # the link names a 0-based scan index


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _try_int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))


def page_number_from_link(link, direct: str = PAGE_PARAM_LINK,
                          indexed: str = JP2_LINK) -> Column:
    """Page number of a link: the ``direct`` group as is, else the ``indexed``
    group + 1, else NULL (the reference fails on such a link)."""
    l = _c(link)
    d = _try_int(F.regexp_extract(l, direct, 1))
    i = _try_int(F.regexp_extract(l, indexed, 1))
    return F.coalesce(d, i + F.lit(1))


def page_stem_from_link(link) -> Column:
    """Second-last '/' part of a link, without '.jp2'."""
    return F.replace(F.try_element_at(F.split(_c(link), "/", -1), F.lit(-2)),
                     F.lit(".jp2"), F.lit(""))


def package_id(stem) -> Column:
    """'_' -> '-', then drop the last '-' part (no '-' at all: unchanged)."""
    return F.regexp_replace(F.replace(_c(stem), F.lit("_"), F.lit("-")), r"-[^-]*$", "")


def _zfill(s: Column, width: int) -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def page_as_string(page) -> Column:
    """Zero-pad to 3 characters, never truncate."""
    return _zfill(_c(page).cast("string"), 3)


def layout_file_name(pkg, page) -> Column:
    """Layout file of a package page: '-' -> '_' in the package id, then
    '-NNN.xml'. Packages of 1860-1869 pad their last number to 4 digits first."""
    p = _c(pkg)
    year = _try_int(F.split_part(p, F.lit("-"), F.lit(2)))
    parts = F.split(p, "--", -1)
    padded = F.concat(F.split_part(p, F.lit("--"), F.lit(1)), F.lit("--"),
                      F.split_part(p, F.lit("--"), F.lit(2)), F.lit("--"),
                      _zfill(F.element_at(parts, -1), 4))
    pid = F.when(year.between(1860, 1869) & (F.size(parts) >= 2), padded).otherwise(p)
    return F.concat(F.replace(pid, F.lit("-"), F.lit("_")), F.lit("-"),
                    F.format_string("%03d", _c(page).cast("int")), F.lit(".xml"))


def page_index_from_facs(facs) -> Column:
    """Raw page index of a facs link: the 3 characters before the extension,
    else the text after the last '='. On jp2 links this is one less than
    ``page_number_from_link``."""
    f = _c(facs)
    before_ext = F.try_element_at(F.split(f, r"\.", -1), F.lit(-2))
    a = _try_int(F.substring(before_ext, -3, 3))
    b = _try_int(F.element_at(F.split(f, "=", -1), -1))
    return F.coalesce(a, b)
