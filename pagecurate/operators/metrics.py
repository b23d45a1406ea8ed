"""Evaluation metrics and losses (E9-E20) as single aggregations.

Every metric is one ``agg`` (optionally grouped by split); per-class metrics
derive from the confusion table, which has at most C x C rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecurate.functions.logits import log_softmax_at
from pagecurate.operators.ordering import Desc, global_index


def _g(df: DataFrame, group_cols):
    return df.groupBy(*group_cols) if group_cols else df.groupBy()


def class_weights(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """Weight per class = rows / rows of the class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: the global window is bounded by the class count
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label_col, "n", (total / F.col("n")).alias(out))


def with_class_weights(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label_col, out).select(label_col, out)
    return df.join(F.broadcast(w), label_col, "left")


def pos_weight(df: DataFrame, label_col: str) -> DataFrame:
    """Negatives / positives."""
    y = F.col(label_col)
    return df.agg(F.try_divide(F.count_if(y == 0), F.count_if(y == 1)).alias("pos_weight"))


def binary_metrics(df: DataFrame, label_col: str, pred_col: str,
                   group_cols: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class 1.

    Undefined precision / recall (empty denominator) are NULL and make F1
    NULL; F1 is 0 when there is no true positive but both are defined."""
    y, p = F.col(label_col), F.col(pred_col)
    agg = _g(df, group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == p).alias("correct"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if(p == 1).alias("pred_pos"),
        F.count_if(y == 1).alias("label_pos"))
    prec = F.try_divide(F.col("tp"), F.col("pred_pos"))
    rec = F.try_divide(F.col("tp"), F.col("label_pos"))
    f1 = F.when(prec.isNull() | rec.isNull(), F.lit(None).cast("double")) \
          .when(F.col("tp") == 0, F.lit(0.0)) \
          .otherwise(F.lit(2.0) / (F.lit(1.0) / prec + F.lit(1.0) / rec))
    return agg.select(*(group_cols or []),
                      F.try_divide(F.col("correct"), F.col("n")).alias("accuracy"),
                      prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def confusion(df: DataFrame, label_col: str, pred_col: str,
              group_cols: list[str] | None = None) -> DataFrame:
    keys = (group_cols or []) + [label_col, pred_col]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def per_class_metrics(df: DataFrame, label_col: str, pred_col: str,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined -> 0.

    Classes are the union of labels and predictions seen."""
    g = group_cols or []
    cm = confusion(df, label_col, pred_col, g)
    as_label = cm.select(*g, F.col(label_col).alias("class"), F.col("n").alias("support"),
                         F.when(F.col(label_col) == F.col(pred_col), F.col("n")).otherwise(0).alias("tp"),
                         F.lit(0).cast("bigint").alias("predicted"))
    as_pred = cm.select(*g, F.col(pred_col).alias("class"), F.lit(0).cast("bigint").alias("support"),
                        F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"))
    per = (as_label.unionByName(as_pred).groupBy(*g, "class")
           .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                F.sum("predicted").alias("predicted")))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * prec * rec, prec + rec), F.lit(0.0))
    return per.select(*g, "class", prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"), F.col("support").cast("bigint").alias("support"))


def weighted_metrics(df: DataFrame, label_col: str, pred_col: str,
                     group_cols: list[str] | None = None) -> DataFrame:
    """Support-weighted precision, recall, F1 (+ accuracy)."""
    g = group_cols or []
    s = F.col("support")
    return _g(per_class_metrics(df, label_col, pred_col, g), g).agg(
        F.try_divide(F.sum(F.col("precision") * s), F.sum(s)).alias("precision"),
        F.try_divide(F.sum(F.col("recall") * s), F.sum(s)).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * s), F.sum(s)).alias("f1"),
        # recall * support = true positives of the class
        F.try_divide(F.sum(F.col("recall") * s), F.sum(s)).alias("accuracy"))


def classification_report(df: DataFrame, label_col: str, pred_col: str,
                          names: dict | None = None) -> DataFrame:
    """Per-class rows, then 'accuracy', 'macro avg', 'weighted avg'."""
    per = per_class_metrics(df, label_col, pred_col)
    name = F.col("class").cast("string")
    if names:
        from pagecurate.functions.labels import label_name
        name = F.coalesce(label_name(F.col("class"), names), name)
    rows = per.select(name.alias("row"), "precision", "recall", "f1",
                      F.col("support").cast("bigint").alias("support"))
    s = F.col("support")
    acc = per.agg(F.try_divide(F.sum(F.col("recall") * s), F.sum(s)).alias("a"),
                  F.sum(s).alias("n"))
    acc_row = acc.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), F.col("a").alias("f1"),
                         F.col("n").cast("bigint").alias("support"))
    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1").alias("f1"), F.sum(s).cast("bigint").alias("support")) \
               .select(F.lit("macro avg").alias("row"), "precision", "recall", "f1", "support")
    weighted = per.agg(
        F.try_divide(F.sum(F.col("precision") * s), F.sum(s)).alias("precision"),
        F.try_divide(F.sum(F.col("recall") * s), F.sum(s)).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * s), F.sum(s)).alias("f1"),
        F.sum(s).cast("bigint").alias("support")
    ).select(F.lit("weighted avg").alias("row"), "precision", "recall", "f1", "support")
    return rows.unionByName(acc_row).unionByName(macro).unionByName(weighted)


def _order_names(order: list) -> list:
    return [Desc(f"_k{i}") if isinstance(o, Desc) else f"_k{i}" for i, o in enumerate(order)]


def _ordered_value(df: DataFrame, order: list, value: Column) -> DataFrame:
    """Only the order keys and the value: what the range partition has to carry."""
    items = [o.item if isinstance(o, Desc) else o for o in order]
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_k{i}") for i, o in enumerate(items)]
    return df.select(*keys, value.alias("_v"))


def batch_accuracy(df: DataFrame, label_col: str, pred_col: str, order: list,
                   batch_size: int = 16) -> DataFrame:
    """Mean over batches (in ``order``) of the batch accuracy; a short last
    batch weighs as much as a full one."""
    hit = (F.col(label_col) == F.col(pred_col)).cast("double")
    idx = global_index(_ordered_value(df, order, hit), _order_names(order), "_idx")
    per = idx.groupBy(F.floor(F.col("_idx") / F.lit(batch_size)).alias("_b")).agg(F.avg("_v").alias("_a"))
    return per.agg(F.avg("_a").alias("batch_accuracy"))


def nll(logits, label) -> Column:
    """Negative log-likelihood of the true class under softmax(logits)."""
    return -log_softmax_at(logits, F.col(label) if isinstance(label, str) else label)


def log_loss(df: DataFrame, logits_col: str, label_col: str,
             group_cols: list[str] | None = None) -> DataFrame:
    """Mean cross-entropy of the logits."""
    return _g(df, group_cols).agg(F.avg(nll(logits_col, label_col)).alias("log_loss"))


def weighted_log_loss(df: DataFrame, logits_col: str, label_col: str, weight_col: str,
                      group_cols: list[str] | None = None) -> DataFrame:
    """sum(w_y * nll) / sum(w_y)."""
    w = F.col(weight_col)
    return _g(df, group_cols).agg(
        F.try_divide(F.sum(w * nll(logits_col, label_col)), F.sum(w)).alias("log_loss"))


def smoothed_log_loss(df: DataFrame, logits_col: str, label_col: str,
                      class_weights: list[float], epsilon: float,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Class-weighted, label-smoothed cross-entropy:
    ((1-e) sum w_y nll_y + e/C sum_i sum_c w_c nll_c) / sum w_y."""
    c = len(class_weights)
    warr = F.array(*[F.lit(float(x)) for x in class_weights])
    wy = F.element_at(warr, F.col(label_col) + F.lit(1))
    all_c = F.aggregate(F.sequence(F.lit(0), F.lit(c - 1)), F.lit(0.0),
                        lambda acc, k: acc + F.element_at(warr, k + F.lit(1)) * nll(logits_col, k))
    num = F.lit(1.0 - epsilon) * wy * nll(logits_col, label_col) + F.lit(epsilon / c) * all_c
    return _g(df, group_cols).agg(F.try_divide(F.sum(num), F.sum(wy)).alias("log_loss"))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def binary_logit_loss(df: DataFrame, logit_col: str, label_col: str, pos_weight: float = 1.0,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Mean of pos_weight*y*softplus(-z) + (1-y)*softplus(z)."""
    z, y = F.col(logit_col).cast("double"), F.col(label_col).cast("double")
    loss = F.lit(pos_weight) * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)
    return _g(df, group_cols).agg(F.avg(loss).alias("log_loss"))


def batch_mean(df: DataFrame, value: Column, order: list, batch_size: int,
               how: str = "mean") -> DataFrame:
    """Mean ('mean') or sum ('sum') over batches of the batch mean of ``value``."""
    idx = global_index(_ordered_value(df, order, value), _order_names(order), "_idx")
    per = (idx.groupBy(F.floor(F.col("_idx") / F.lit(batch_size)).alias("_b"))
           .agg(F.avg("_v").alias("_m")))
    return per.agg((F.sum("_m") if how == "sum" else F.avg("_m")).alias("value"))
