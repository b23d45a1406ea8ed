"""Dataset splits.

* ``stratified_split`` — 70/15/15 with exact per-class counts (sklearn-style
  two-stage sizes, largest-remainder quotas), membership by seeded hash order.
* ``file_holdout_split`` — per decade the last 3 files are test, the 3 before
  them validation, the rest train; rows follow their file.
* ``split_contiguous`` — n contiguous parts, the first ``rows % n`` one longer.

With two or three classes every class is a hot group, so no class is sorted: the
rows at its two borders are found by selection (``ordering.part_of``), and label
the wide rows by comparison, without a shuffle of these. The contiguous split
does the same with its n - 1 borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecurate.operators.aggregates import files_by_decade
from pagecurate.operators.joins import holdout_rows, train_rows
from pagecurate.operators.ordering import Desc, part_of, top_k_per_group
from pagecurate.operators.sampling import hash_key

TRAIN, VAL, TEST = "train", "val", "test"


def _largest_remainder(counts: DataFrame, class_col: str, n_col: str, total_col: str,
                       draws: str, out: str) -> DataFrame:
    """Quota per class of ``draws`` rows: floor of the proportional share, the
    rest to the largest remainders (ties: lower class first). ``counts`` has
    one row per class, so its global windows are bounded by the class count."""
    cont = F.col(n_col) / F.col(total_col) * F.col(draws)
    q = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    whole = Window.partitionBy()
    q = q.withColumn("_need", (F.col(draws) - F.sum("_fl").over(whole)).cast("bigint"))
    q = q.withColumn("_rk", F.row_number().over(
        Window.orderBy(F.desc(F.col("_cont") - F.col("_fl")), F.col(class_col))))
    q = q.withColumn(out, (F.col("_fl") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0)).cast("bigint"))
    return q.drop("_cont", "_fl", "_need", "_rk")


def split_quotas(df: DataFrame, target: str, test_size: float = 0.3,
                 second_test_size: float = 0.5) -> DataFrame:
    """Per class: (n, n_train, n_val, n_test) of the two-stage stratified split."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    counts = counts.withColumn("_total", F.sum("n").over(whole))
    counts = counts.withColumn("_train_draws", F.col("_total") - F.ceil(F.lit(test_size) * F.col("_total")))
    q = _largest_remainder(counts, target, "n", "_total", "_train_draws", "n_train")
    q = q.withColumn("_rest", F.col("n") - F.col("n_train"))
    q = q.withColumn("_rest_total", F.sum("_rest").over(whole))
    q = q.withColumn("_val_draws", F.col("_rest_total") - F.ceil(F.lit(second_test_size) * F.col("_rest_total")))
    q = _largest_remainder(q, target, "_rest", "_rest_total", "_val_draws", "n_val")
    q = q.withColumn("n_test", F.col("_rest") - F.col("n_val"))
    return q.select(target, "n", "n_train", "n_val", "n_test")


def stratified_split(df: DataFrame, target: str, id_col: str, seed: int = 42,
                     test_size: float = 0.3, second_test_size: float = 0.5,
                     out: str = "split") -> DataFrame:
    """Add ``out`` in {train, val, test} with exact per-class counts.

    Rows with a NULL target form their own stratum."""
    quotas = split_quotas(df, target, test_size, second_test_size)
    # one row per class: the first rows of val and test
    starts = quotas.select(target, F.array("n_train", F.col("n_train") + F.col("n_val")).alias("starts"))
    role = F.element_at(F.array(F.lit(TRAIN), F.lit(VAL), F.lit(TEST)), F.col("_part").cast("int") + 1)
    # an empty class part has no first row: its start coincides with the next one
    parts = part_of(df, [target], [hash_key(seed, id_col), id_col], starts, "_part")
    return parts.withColumn(out, role).drop("_part")


def holdout_roles(files: DataFrame, decade_col: str, file_col: str, first_idx: str = "first_idx",
                  n_test: int = 3, n_val: int = 3) -> DataFrame:
    """per decade, files ranked from the last seen: 1..n_test test,
    next n_val val. Returns (decade, file, role) for held-out files only; the
    top-k filter runs map-side (partial WindowGroupLimit)."""
    top = top_k_per_group(files, [decade_col], [Desc(first_idx), Desc(file_col)],
                          n_test + n_val, out="_rk")
    role = F.when(F.col("_rk") <= n_test, F.lit(TEST)).otherwise(F.lit(VAL))
    return top.select(decade_col, file_col, role.alias("role"))


def file_holdout_split(df: DataFrame, decade_col: str, file_col: str, idx_col: str,
                       n_test: int = 3, n_val: int = 3) -> DataFrame:
    """Every row with the role of its file (test / val / train)."""
    firsts = files_by_decade(df, decade_col, file_col, idx_col)
    roles = holdout_roles(firsts, decade_col, file_col, "first_idx", n_test, n_val)
    # held-out files are at most (n_test + n_val) per decade; their measured size picks the join
    r = roles.select(file_col, "role")
    return df.join(r, file_col, "left").withColumn(
        "role", F.coalesce(F.col("role"), F.lit(TRAIN)))


def holdout_parts(df: DataFrame, decade_col: str, file_col: str, idx_col: str,
                  n_test: int = 3, n_val: int = 3) -> dict[str, DataFrame]:
    """I3 as three tables via D1 (semi) and D2 (anti) joins."""
    firsts = files_by_decade(df, decade_col, file_col, idx_col)
    roles = holdout_roles(firsts, decade_col, file_col, "first_idx", n_test, n_val)
    test = roles.filter(F.col("role") == TEST)
    val = roles.filter(F.col("role") == VAL)
    return {TEST: holdout_rows(df, test, file_col),
            VAL: holdout_rows(df, val, file_col),
            TRAIN: train_rows(df, test, val, key=file_col)}


def split_contiguous(df: DataFrame, n: int, order: list, out: str = "part") -> DataFrame:
    """``ntile(n)`` over ``order`` (1-based part numbers)."""
    total = F.count(F.lit(1))
    q, r = F.floor(total / F.lit(n)), total % F.lit(n)
    starts = df.agg(F.array(*[F.lit(i) * q + F.least(F.lit(i), r) for i in range(1, n)]).cast("array<bigint>").alias("starts"))
    return part_of(df, [], order, starts, "_part").withColumn(out, F.col("_part") + 1).drop("_part")
