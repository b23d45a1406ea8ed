import math
import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from pagecurate.operators import metrics
from pagecurate.plans import splits

TABLES = os.path.join(FIXTURES, "tables")


def csv(spark, name, schema):
    return spark.read.schema(schema).option("header", True).csv(os.path.join(TABLES, name))


def test_file_holdout_roles(spark):
    df = csv(spark, "decades.csv", "row_idx INT, file STRING, decade INT")
    s = splits.file_holdout_split(df, "decade", "file", "row_idx")
    roles = {r.file: r.role for r in s.select("file", "role").distinct().collect()}
    # 1860: 7 files -> last 3 test, 3 val, first train
    assert [roles[f"1860_f{i}"] for i in range(7)] == ["train", "val", "val", "val", "test", "test", "test"]
    assert [roles[f"1870_f{i}"] for i in range(6)] == ["val"] * 3 + ["test"] * 3
    assert [roles[f"1880_f{i}"] for i in range(5)] == ["val"] * 2 + ["test"] * 3
    assert [roles[f"1890_f{i}"] for i in range(2)] == ["test"] * 2
    parts = splits.holdout_parts(df, "decade", "file", "row_idx")
    total = sum(p.count() for p in parts.values())
    assert total == df.count()
    plan = parts["test"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def sk_counts(counts, n_draws):
    # deterministic largest remainder (reference: random among equal remainders)
    total = sum(counts)
    cont = [c / total * n_draws for c in counts]
    fl = [math.floor(x) for x in cont]
    need = n_draws - sum(fl)
    order = sorted(range(len(counts)), key=lambda i: (-(cont[i] - fl[i]), i))
    for i in order[:need]:
        fl[i] += 1
    return fl


def test_stratified_quotas(spark):
    df = csv(spark, "strata.csv", "id STRING, cls INT")
    s = splits.stratified_split(df, "cls", "id")
    got = {(r.cls, r.split): r.n for r in s.groupBy("cls", "split").agg(F.count("*").alias("n")).collect()}
    counts = [7, 5, 3, 1]
    n = 16
    n_train = [*sk_counts(counts, n - math.ceil(0.3 * n))]
    rest = [c - t for c, t in zip(counts, n_train)]
    m = sum(rest)
    n_val = sk_counts(rest, m - math.ceil(0.5 * m))
    for c in range(4):
        assert got.get((c, "train"), 0) == n_train[c]
        assert got.get((c, "val"), 0) == n_val[c]
        assert got.get((c, "test"), 0) == rest[c] - n_val[c]
        assert abs(n_train[c] - counts[c] * (n - math.ceil(0.3 * n)) / n) < 1
    assert s.count() == 16 and s.select("id").distinct().count() == 16


@pytest.mark.parametrize("parts", [1, 5])
def test_stratified_split_independent_of_partitioning(spark, parts):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("cls"))
    base = {r.id: r.split for r in splits.stratified_split(df, "cls", "id").collect()}
    other = {r.id: r.split for r in splits.stratified_split(df.repartition(parts), "cls", "id").collect()}
    assert base == other


@pytest.mark.parametrize("n_rows,n", [(10, 3), (11, 3), (12, 5), (7, 7), (5, 7)])
def test_split_contiguous_sizes(spark, n_rows, n):
    df = spark.range(n_rows)
    got = sorted(r["count"] for r in splits.split_contiguous(df, n, ["id"]).groupBy("part").count().collect())
    q, r = divmod(n_rows, n)
    exp = sorted([q + 1] * r + [q] * (n - r))
    assert got == [x for x in exp if x > 0]


def test_binary_metric_edges(spark):
    df = csv(spark, "metrics.csv", "grp STRING, label INT, pred INT")
    got = {r.grp: r for r in metrics.binary_metrics(df, "label", "pred", ["grp"]).collect()}
    assert got["no_pred_pos"].precision is None and got["no_pred_pos"].f1 is None
    assert got["no_true_pos"].precision == 0.0 and got["no_true_pos"].f1 == 0.0
    assert got["perfect"].accuracy == 1.0 and got["perfect"].f1 == 1.0


def test_weighted_metrics_match_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("label"),
                                 ((F.col("id") * 7 + F.col("id") % 5) % 3).cast("double").alias("prediction"))
    ours = metrics.weighted_metrics(df, "label", "prediction").first()
    for name, ref in [("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "weightedFMeasure")]:
        ev = MulticlassClassificationEvaluator(metricName=ref).evaluate(df)
        assert abs(getattr(ours, name) - ev) < 1e-9


def test_classification_report_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1)], "y INT, p INT")
    rows = {r.row: r for r in metrics.classification_report(df, "y", "p", {0: "other", 1: "marginal_text", 2: "merged"}).collect()}
    assert set(rows) == {"other", "marginal_text", "merged", "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"].f1 == 0.75 and rows["merged"].precision == 0.5
