"""Profiling aggregates.

All are hash aggregates with map-side partial aggregation; totals come from a
``rollup`` in the same job instead of a second pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOTAL = "total"


def class_distribution(df: DataFrame, class_col: str, split_col: str | None = None,
                       dropna: bool = True) -> DataFrame:
    """Rows per class (per split); ``dropna=False`` keeps the NULL class."""
    keys = ([split_col] if split_col else []) + [class_col]
    src = df.filter(F.col(class_col).isNotNull()) if dropna else df
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows and share of the total per split, plus a 'total' row."""
    r = df.rollup(split_col).agg(F.count(F.lit(1)).alias("n"), F.grouping(split_col).alias("_g"))
    # the rollup has one row per split + 1: a global window over it is bounded
    total = F.max(F.when(F.col("_g") == 1, F.col("n"))).over(Window.partitionBy())
    return r.select(F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(split_col).cast("string")).alias(split_col),
                    F.col("n"), (F.col("n") / total).alias("share"))


def label_shares(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Positives, the rest, and the positive share per split and in total."""
    t = F.col(target)
    r = df.rollup(split_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(t), F.lit(0)).alias("positives"),
        F.grouping(split_col).alias("_g"))
    return r.select(
        F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(split_col).cast("string")).alias(split_col),
        F.col("n"), F.col("positives").cast("double").alias("positives"),
        (F.col("n") - F.col("positives")).cast("double").alias("negatives"),
        F.try_divide(F.col("positives"), F.col("n")).alias("share"))


def null_count(df: DataFrame, cols: list[str], split_col: str | None = None) -> DataFrame:
    """E5: rows with a missing value in any of ``cols`` (per split)."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    miss = reduce(lambda a, b: a | b, [
        (F.col(c).isNull() | F.isnan(F.col(c))) if c in floats else F.col(c).isNull() for c in cols])
    agg = F.count_if(miss).alias("null_rows")
    return df.groupBy(split_col).agg(agg) if split_col else df.agg(agg)


def extent(df: DataFrame, left="posLeft", upper="posUpper", right="posRight", lower="posLower",
           group_cols: list[str] | None = None) -> DataFrame:
    """Min left/upper, max right/lower."""
    aggs = [F.min(left).alias("min_left"), F.min(upper).alias("min_upper"),
            F.max(right).alias("max_right"), F.max(lower).alias("max_lower")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def files_by_decade(df: DataFrame, decade_col: str, file_col: str, idx_col: str) -> DataFrame:
    """Distinct files per decade with their first-seen position."""
    return df.groupBy(decade_col, file_col).agg(F.min(idx_col).alias("first_idx"))


def position_histogram(df: DataFrame, category_col: str, x: str, y: str,
                       bin_size: float) -> DataFrame:
    """Segment positions binned per category (the data behind a scatter plot)."""
    return (df.groupBy(category_col,
                       F.floor(F.col(x) / F.lit(bin_size)).alias("x_bin"),
                       F.floor(F.col(y) / F.lit(bin_size)).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def row_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named part, for data-quality assertions."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
               for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counted)
