"""Indel similarity ratio as an Arrow-batched pandas UDF.

ratio(a, b) = round(100 * (1 - indel(a, b) / (len a + len b))), where the Indel
distance counts insertions and deletions only: len a + len b - 2 * LCS(a, b).
Rounding is half-to-even (Python ``round``). Two empty strings score 100; one
empty string scores 0.

The LCS runs as a bit-parallel scan (Hyyro / Allison-Dix) over Python integers:
one pass per character of the shorter text, so a pair costs O(len a * len b / w).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# ship this module's code with the UDF, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def char_masks(a: str) -> dict[str, int]:
    """Bit i of masks[ch] is set where a[i] == ch."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def lcs_length(a: str, b: str, masks_a: dict[str, int] | None = None) -> int:
    if len(a) < len(b):
        a, b = b, a
        masks_a = None
    if not b:
        return 0
    masks = masks_a if masks_a is not None else char_masks(a)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio_py(a: str | None, b: str | None, masks_a: dict[str, int] | None = None) -> int | None:
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if total == 0 or a == b:
        return 100
    dist = total - 2 * lcs_length(a, b, masks_a)
    return int(np.round(100.0 * (1.0 - dist / total)))


@F.pandas_udf(IntegerType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    # a text meets several partners in a batch: build its bitmasks once
    memo: dict[str, dict[str, int]] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        long_, short = (x, y) if len(x) >= len(y) else (y, x)
        m = memo.get(long_)
        if m is None:
            m = memo[long_] = char_masks(long_)
        out.append(indel_ratio_py(long_, short, m))
    return pd.Series(out, dtype="Int32")
