"""Label expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class ids and names of the 3-class target.
ID2LABEL = {0: "other", 1: "marginal_text", 2: "merged"}
LABEL2ID = {v: k for k, v in ID2LABEL.items()}
# The binary margin target.
BINARY_ID2LABEL = {0: "non_marginal", 1: "marginal"}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def final_target(marginal, merged) -> Column:
    """Row-wise sum of the two 0/1 labels, missing counts as 0.

    0 other, 1 marginal, 2 merged; a merged-only row also sums to 1 (kept as in
    the reference; ``segment_category`` gives the strict reading)."""
    return (F.coalesce(_c(marginal), F.lit(0)) + F.coalesce(_c(merged), F.lit(0))).cast("int")


def segment_category(marginal, merged) -> Column:
    m, g = _c(marginal), _c(merged)
    return (F.when((m == 0) & (g == 0), F.lit("non-marginal"))
            .when((m == 1) & (g == 0), F.lit("marginal"))
            .otherwise(F.lit("merged")))


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def label_name(label_id, mapping: dict = ID2LABEL) -> Column:
    return _map(mapping)[_c(label_id)]


def label_id(name, mapping: dict = LABEL2ID) -> Column:
    return _map(mapping)[_c(name)]


def label_to_int(c) -> Column:
    return _c(c).cast("int")
