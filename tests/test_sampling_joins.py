import pytest
from pyspark.sql import functions as F

from pagecurate.operators import joins, sampling, setops


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_sample_per_group_independent_of_partitions(spark, parts):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    base = {(r.g, r.id) for r in sampling.sample_per_group(df, ["g"], "id", 3, seed=5).collect()}
    other = {(r.g, r.id) for r in sampling.sample_per_group(df.repartition(parts), ["g"], "id", 3, seed=5).collect()}
    assert base == other and len(base) == 21


def test_sample_rows_caps_at_table_size(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    assert sampling.sample_rows(df, "k", 50).count() == 7


def test_sample_with_replacement_draws_k_per_group(spark):
    items = spark.createDataFrame([(1860, f"186{i}") for i in range(3)] + [(1870, "1875")], "decade INT, folder STRING")
    d = sampling.sample_with_replacement(items, "decade", "folder", 5, seed=1)
    got = {(r.decade, r.draw_no): r.folder for r in d.collect()}
    assert len(got) == 10 and all(got[(1870, j)] == "1875" for j in range(5))
    assert {got[(1860, j)] for j in range(5)} <= {"1860", "1861", "1862"}


def test_update_by_id_last_write_wins(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "id STRING")
    upd = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "id STRING, seq INT, posLeft DOUBLE")
    got = {r.id: r.posLeft for r in joins.update_by_id(base, upd, "id", order_col="seq").collect()}
    assert got == {"a": 20.0, "b": 5.0, "c": None}


def test_pool_minus_and_union(spark):
    pool = spark.createDataFrame([(i,) for i in range(10)], "id INT")
    got = spark.createDataFrame([(2,), (5,)], "id INT")
    assert sorted(r.id for r in setops.pool_minus(pool, got, "id").collect()) == [0, 1, 3, 4, 6, 7, 8, 9]
    lab = setops.labelled_union(got.withColumn("round", F.lit(1)), spark.createDataFrame([(7,)], "id INT"))
    assert sorted((r.id, r.round) for r in lab.collect()) == [(2, 1), (5, 1), (7, None)]
