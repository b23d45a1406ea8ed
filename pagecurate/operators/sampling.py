"""Deterministic sampling.

Membership never depends on partitioning: rows are ordered by an md5 hash of
``seed | id`` (DuckDB's md5 gives the same order), never by ``rand``/``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecurate.operators.ordering import top_k_per_group


def hash_key(seed, *parts) -> Column:
    """md5 hex of 'seed|part1|part2...' — the sampling order."""
    cols = [F.lit(str(seed))] + [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def hash_index(seed, n, *parts) -> Column:
    """A number in [0, n) drawn from the first 32 bits of ``hash_key``."""
    h = F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n))


def sample_per_group(df: DataFrame, group_cols: list[str], id_col: str, k: int,
                     seed: int = 42, rank_col: str | None = None) -> DataFrame:
    """k rows without replacement per group (all rows when the group is smaller)."""
    order = [hash_key(seed, id_col), F.col(id_col)]
    return top_k_per_group(df, group_cols, order, k, out=rank_col)


def sample_rows(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement from the whole table (TakeOrderedAndProject)."""
    return df.orderBy(hash_key(seed, id_col), F.col(id_col)).limit(k)


def seeded_order(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Seeded shuffle order (training-loader order)."""
    return df.orderBy(hash_key(seed, id_col), F.col(id_col))


def sample_with_replacement(items: DataFrame, group_col: str, item_col: str, k: int,
                            seed: int = 42) -> DataFrame:
    """k draws per group with replacement; draw j picks item number
    ``hash(seed|group|j) mod n`` of the group's items in ``item_col`` order.

    Returns (group, draw_no, item). ``items`` is the small folder table
    (years of a decade: at most 10 per group), so the per-group window is bounded.
    """
    w = Window.partitionBy(group_col).orderBy(item_col)
    ranked = (items.select(group_col, item_col).distinct()
              .withColumn("_i", F.row_number().over(w) - 1)
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group_col))))
    sizes = ranked.select(group_col, "_n").distinct()
    draws = (sizes.withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
             .withColumn("_i", hash_index(seed, F.col("_n"), group_col, "draw_no")))
    return (draws.join(ranked.drop("_n"), [group_col, "_i"])
            .select(group_col, F.col("draw_no").cast("int").alias("draw_no"), item_col))


def draw_unseen(draws: DataFrame, files: DataFrame, item_col: str, file_col: str,
                seed: int = 42) -> DataFrame:
    """One not-yet-taken file per draw of a folder.

    Draw *j* of a folder takes the *j*-th file of the folder's hash order, so a
    folder drawn twice yields two different files and excess draws yield none —
    the same as removing taken files between draws, without a loop. ``draws``
    carries a ``draw_key`` column (draw order). The most draws of any folder are
    counted first, so only that many files of a folder leave their partition."""
    per_folder = draws.withColumn(
        "_j", F.row_number().over(Window.partitionBy(item_col).orderBy("draw_key")))
    most = per_folder.agg(F.max("_j")).first()[0] or 0
    ranked = top_k_per_group(files, [item_col], [hash_key(seed, file_col), F.col(file_col)],
                             most, out="_j")
    return per_folder.join(ranked, [item_col, "_j"]).drop("_j")
