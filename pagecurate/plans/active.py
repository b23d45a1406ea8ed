"""Uncertainty-sampling active learning.

Each round: draw a seeded sample of the pool, score it, take the most
uncertain rows and look their labels up in the annotation table (the human
annotator of the reference becomes a lookup). Rows with a label 0/1 move to
the labelled set; picked rows without one stay on record as rejected and are
not drawn again, so pool + labelled + rejected are always the rows of the
start. With ``refit`` a model is fitted on the labelled rows before the next
sample is scored, and the labelled set is evaluated once it is large enough.

Only the picked ids (at most ``batch`` per round) are materialised, by a
reliable checkpoint; the pool is the original table without these ids.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.functions.logits import argmax_class, softmax_uncertainty
from pagecurate.operators.filters import valid_annotations
from pagecurate.operators.joins import apply_annotations
from pagecurate.operators.metrics import binary_metrics
from pagecurate.operators.sampling import sample_rows
from pagecurate.operators.setops import labelled_union, pool_minus
from pagecurate.session import ensure_checkpoint_dir

#: Labelled rows above which a round is evaluated.
EVALUATE_ABOVE = 10


class ActiveResult(NamedTuple):
    labelled: DataFrame
    pool: DataFrame
    rejected: DataFrame
    metrics: list[dict]


def most_uncertain(scored: DataFrame, id_col: str, logits_col: str, batch: int) -> DataFrame:
    """B20 + G2: the ``batch`` most uncertain rows; ties by id."""
    ranked = scored.withColumn("uncertainty", softmax_uncertainty(logits_col))
    return ranked.orderBy(F.desc("uncertainty"), F.col(id_col)).limit(batch)


def select_batch(pool: DataFrame, id_col: str, logits_col: str, pool_size: int = 50,
                 batch: int = 10, seed: int = 42) -> DataFrame:
    """G3 + B20 + G2: ``batch`` most uncertain rows of a seeded ``pool_size``
    sample; ties by id."""
    return most_uncertain(sample_rows(pool, id_col, pool_size, seed), id_col, logits_col, batch)


def active_learning(pool: DataFrame, annotations: DataFrame, id_col: str = "id",
                    logits_col: str = "logits", label_col: str = "label", rounds: int = 5,
                    pool_size: int = 50, batch: int = 10, seed: int = 42,
                    refit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
                    labelled: DataFrame | None = None) -> ActiveResult:
    """Run ``rounds`` rounds. ``refit(labelled rows with their label)`` returns
    a function that gives rows fresh ``logits_col``; without it the logits of
    the pool are used as they are. ``labelled``: ids and labels known before the
    first round (their rows must be in ``pool``; they are not drawn)."""
    ensure_checkpoint_dir(pool.sparkSession)
    ok, _ = valid_annotations(annotations.select(id_col, label_col), label_col)
    known = None if labelled is None else labelled.select(id_col, label_col).withColumn("round", F.lit(0))
    rejected, metrics, score = None, [], None
    for r in range(1, rounds + 1):
        if refit is not None and known is not None and known.limit(1).count():
            score = refit(pool.drop(label_col).join(known.select(id_col, label_col), id_col))
        rest = pool if known is None else pool_minus(pool, known, id_col)
        rest = rest if rejected is None else pool_minus(rest, rejected, id_col)
        sample = sample_rows(rest, id_col, pool_size, seed + r - 1)
        picked = most_uncertain(score(sample) if score else sample, id_col, logits_col, batch)
        picked = picked.select(id_col).withColumn("round", F.lit(r)).checkpoint()
        got = apply_annotations(picked, ok, id_col, label_col).select(id_col, label_col, "round").checkpoint()
        missed = pool_minus(picked, got, id_col).checkpoint()
        known = got if known is None else labelled_union(known, got)
        rejected = missed if rejected is None else labelled_union(rejected, missed)
        if known.count() > EVALUATE_ABOVE:
            rows = pool.drop(label_col, "round").join(known, id_col)
            rows = (score(rows) if score else rows).withColumn("_pred", argmax_class(logits_col))
            metrics.append({"round": r, **binary_metrics(rows, label_col, "_pred").first().asDict()})
    rest = pool_minus(pool_minus(pool, known, id_col), rejected, id_col)
    return ActiveResult(known, rest, rejected, metrics)
