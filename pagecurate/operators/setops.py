"""Set operations (H1, H2, H4, H5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.session import ensure_checkpoint_dir


def concat(*parts: DataFrame) -> DataFrame:
    """H1: union all by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_values(df: DataFrame, expr, name: str) -> DataFrame:
    """H2: distinct values of an expression."""
    e = F.col(expr) if isinstance(expr, str) else expr
    return df.select(e.alias(name)).distinct()


#: Pairs that one task walks through in order (some 100 bytes each).
WALKED_PAIRS = 500_000


def _walked(pairs: DataFrame, file_col: str, link_col: str, order_col: str) -> DataFrame:
    """The walk itself, in one task; the caller has checked the number of pairs."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, links = set(), set()
        for batch in batches:
            kept = []
            for i, (f, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if f not in files and k not in links:
                    files.add(f)
                    links.add(k)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = pairs.select(file_col, link_col, order_col).repartition(1).sortWithinPartitions(order_col, file_col, link_col)
    return ordered.mapInArrow(walk, ordered.schema)


def first_distinct_pairs(df: DataFrame, file_col: str, link_col: str, order_col: str) -> DataFrame:
    """in order of first appearance (ties: file, then link), the (file, link)
    pairs of which neither the file nor the link has been kept before; pairs with
    a NULL are left out.

    At most ``WALKED_PAIRS`` distinct pairs are walked through in one task. More are
    thinned out in rounds: a pair that is the first left of its file and of its
    link is kept, and all pairs that share either with a kept one go. Where a round
    settles less than a tenth (a long chain of pairs), the first ``WALKED_PAIRS``
    in order are walked through instead, which settles all of them, since the walk
    only depends on earlier pairs. What is left is checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)
    known = df.filter(F.col(file_col).isNotNull() & F.col(link_col).isNotNull())
    left = known.groupBy(file_col, link_col).agg(F.min(order_col).alias(order_col)).checkpoint()
    kept, n, stuck = None, left.count(), False

    def with_kept(now: DataFrame) -> DataFrame:
        return now if kept is None else kept.unionByName(now)

    def without(now: DataFrame) -> DataFrame:
        return left.join(now.select(file_col), file_col, "left_anti").join(now.select(link_col), link_col, "left_anti")

    while n > WALKED_PAIRS:
        if stuck:
            first = left.orderBy(order_col, file_col, link_col).limit(WALKED_PAIRS).checkpoint()
            now = _walked(first, file_col, link_col, order_col).checkpoint()
            rest = without(now).join(first.select(file_col, link_col), [file_col, link_col], "left_anti")
        else:
            place = F.struct(order_col, file_col, link_col)
            by_file = left.groupBy(file_col).agg(F.min(place).alias("_f"))
            by_link = left.groupBy(link_col).agg(F.min(place).alias("_l"))
            now = (left.join(by_file, file_col).join(by_link, link_col).filter((place == F.col("_f")) & (place == F.col("_l")))
                   .select(file_col, link_col, order_col)).checkpoint()
            rest = without(now)
        kept, left = with_kept(now), rest.select(file_col, link_col, order_col).checkpoint()
        n, before = left.count(), n
        stuck = not stuck and n > 0.9 * before
    return with_kept(_walked(left, file_col, link_col, order_col))


def pool_minus(pool: DataFrame, acquired: DataFrame, key: str = "id") -> DataFrame:
    """H4: pool rows not acquired (left anti on the key)."""
    return pool.join(acquired.select(key).distinct(), key, "left_anti")


def labelled_union(labelled: DataFrame, acquired: DataFrame) -> DataFrame:
    """H5: the labelled set grown by the acquired rows."""
    return labelled.unionByName(acquired, allowMissingColumns=True)
