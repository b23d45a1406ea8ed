"""Logit expressions (B18-B21) over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def argmax_class(logits) -> Column:
    """0-based index of the largest logit, the first one on ties."""
    a = _c(logits)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def sigmoid_decision(z) -> Column:
    """1 when sigmoid(z) > 0.5 (strict), else 0."""
    x = _c(z).cast("double")
    return ((F.lit(1.0) / (F.lit(1.0) + F.exp(-x))) > F.lit(0.5)).cast("int")


def _logsumexp(a: Column) -> Column:
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def softmax_uncertainty(logits) -> Column:
    """1 - the largest softmax probability (max shifted out for stability)."""
    a = F.transform(_c(logits), lambda x: x.cast("double"))
    m = F.array_max(a)
    return F.lit(1.0) - F.lit(1.0) / F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))


def log_softmax_at(logits, idx) -> Column:
    """log p(class idx) of a logit array (idx 0-based)."""
    a = F.transform(_c(logits), lambda x: x.cast("double"))
    i = idx if isinstance(idx, Column) else F.lit(idx)
    return F.element_at(a, i + F.lit(1)) - _logsumexp(a)


def logit_columns(logits, names=("logits1", "logits2")) -> list[Column]:
    a = _c(logits)
    return [F.element_at(a, k + 1).cast("double").alias(n) for k, n in enumerate(names)]
