"""Joins (D1-D3, D6-D8).

No broadcast hints: AQE switches to a broadcast at run time from measured sizes
(``spark.sql.adaptive.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holdout_rows(df: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """Rows whose ``key`` is in ``files`` (left semi)."""
    return df.join(files.select(key).distinct(), key, "left_semi")


def train_rows(df: DataFrame, *excluded: DataFrame, key: str = "file") -> DataFrame:
    """Rows whose ``key`` is in none of ``excluded`` (left anti)."""
    out = df
    for ex in excluded:
        out = out.join(ex.select(key).distinct(), key, "left_anti")
    return out


def update_by_id(df: DataFrame, updates: DataFrame, key: str = "id",
                 order_col: str | None = None) -> DataFrame:
    """D3: set the ``updates`` columns on rows with the same ``key``; rows
    without an update keep the value they have (NULL in a new column). When a
    key is updated several times the last one (largest ``order_col``) wins;
    without ``order_col`` a key that is updated twice fails the query, since
    there is no last one."""
    cols = [c for c in updates.columns if c != key and c != order_col]
    row = F.struct(F.lit(True).alias("_set"), *cols)
    updates = updates.filter(F.col(key).isNotNull())  # no row has a NULL key in common
    if order_col:
        last = updates.groupBy(key).agg(F.max_by(row, F.col(order_col)).alias("_u"))
    else:
        twice = F.raise_error(F.concat(F.lit("update_by_id: several updates of key "), F.col(key).cast("string")))
        last = (updates.groupBy(key).agg(F.first(row).alias("_u"), F.count(F.lit(1)).alias("_n"))
                .select(key, F.when(F.col("_n") > 1, twice.cast(updates.select(row.alias("r")).schema["r"].dataType))
                        .otherwise(F.col("_u")).alias("_u")))
    joined = df.join(last, key, "left")
    return joined.select(*[c for c in df.columns if c not in cols],
                         *[(F.when(F.col("_u._set"), F.col(f"_u.{c}")).otherwise(df[c]) if c in df.columns
                            else F.col(f"_u.{c}")).alias(c) for c in cols])


def attach_predictions(df: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Predictions joined by key (never by row position)."""
    return df.join(preds, key, "left")


def zip_features(text_feats: DataFrame, pos_feats: DataFrame, key: str = "id") -> DataFrame:
    """Text features and positional features of the same segment."""
    return text_feats.join(pos_feats, key, "inner")


def apply_annotations(selected: DataFrame, annotations: DataFrame, key: str = "id",
                      label_col: str = "label") -> DataFrame:
    """Attach human labels to a selected batch (inner equi-join)."""
    return selected.join(annotations.select(key, label_col), key, "inner")
