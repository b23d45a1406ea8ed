import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagecurate.operators.ordering import global_index, rank_within, running_scan, top_k_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(7)
    # one key holds about a third of the rows
    data = [(i, 0 if r.random() < 0.35 else r.randint(1, 30), r.randint(0, 50),
             r.choice([None, 1.5, 2.5])) for i in range(3000)]
    return spark.createDataFrame(data, "id INT, k INT, t INT, v DOUBLE").cache()


def test_global_index_matches_row_number(spark, skewed):
    a = {r.id: r.gi for r in global_index(skewed, ["t", "id"], "gi").collect()}
    b = {r.id: r.gi for r in skewed.withColumn("gi", F.row_number().over(Window.orderBy("t", "id")) - 1).collect()}
    assert a == b


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_rank_within_independent_of_partitions(spark, skewed, parts):
    a = {r.id: r.rk for r in rank_within(skewed, ["k"], ["t", "id"], "rk", partitions=parts).collect()}
    w = Window.partitionBy("k").orderBy("t", "id")
    b = {r.id: r.rk for r in skewed.withColumn("rk", F.row_number().over(w) - 1).collect()}
    assert a == b


def test_running_scan(spark, skewed):
    got = running_scan(skewed, ["k"], ["t", "id"], sums={"s": F.col("t")}, lasts={"l": F.col("v")})
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = skewed.withColumn("s", F.sum("t").over(w)).withColumn("l", F.last("v", True).over(w))
    assert {r.id: (r.s, r.l) for r in got.collect()} == {r.id: (r.s, r.l) for r in exp.collect()}
    excl = running_scan(skewed, ["k"], ["t", "id"], sums={"s": F.lit(1)}, inclusive=False)
    w2 = Window.partitionBy("k").orderBy("t", "id")
    exp2 = skewed.withColumn("s", F.row_number().over(w2) - 1)
    assert {r.id: r.s for r in excl.collect()} == {r.id: r.s for r in exp2.collect()}


def test_top_k_is_map_side(spark, skewed):
    df = top_k_per_group(skewed, ["k"], ["t", "id"], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert df.filter(F.col("k") == 0).count() == 3
