"""Ordinals and ordered scans that stay distributed.

A window without ``partitionBy`` (or one whose partition is a hot key) puts
every row of the group into one task. The helpers here give the same numbers
while the work stays spread over range partitions:

* ``global_index`` — 0-based position in an order: range partition, sort inside
  partitions, count per partition, prefix-sum the counts, add the offset.
* ``rank_within`` — 0-based position inside key groups; a hot key spans many
  range partitions and each partition contributes its own slice.
* ``running_scan`` — running sums and "last non-null so far" per key, by the
  same slice-and-carry scheme.
* ``top_k_per_group`` — ``row_number() <= k``; Spark inserts a partial
  ``WindowGroupLimit`` before the shuffle, so a group sends at most ``k`` rows
  per input partition.
* ``part_of`` — which of the parts between given positions a row falls into,
  by comparing it with the rows at these positions. Selection by refined
  histograms finds these, so nothing is sorted as a whole.

The first three carry the columns they are given through the range partition,
so select the ones that are needed. The numbered rows are materialised once with
a reliable ``checkpoint()`` (the shared folder of ``spark.checkpoint.dir``):
range bounds are sampled anew on every execution, and the counts must see the
partitioning that the rows have, also after an executor loss. Nothing is joined
back on the order, so rows that repeat an order key keep their number of rows;
which of them comes first is open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, NumericType, StringType, TimestampType

from pagecurate.session import ensure_checkpoint_dir, shuffle_partitions

_PID, _LOC, _MID = "_pc_pid", "_pc_loc", "_pc_mid"
_LOCAL_BITS = 33  # monotonically_increasing_id puts the partition id above bit 33

#: Cells that one round of selection cuts an interval into, and the most rows of a
#: cell that are ranked in one task.
CELLS, NEAR_ROWS = 4096, 20_000
_AT = "_pc_at"


class Desc:
    """Marks a descending order item: ``Desc("n")``."""

    def __init__(self, item):
        self.item = item


def _expr(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _order(df: DataFrame, order: list) -> tuple[DataFrame, list[str], list[str], list[Column]]:
    """Order items as columns (expressions materialised as _o0..); returns the
    frame, the order column names, the helper names to drop, sort expressions."""
    names, helpers, sorts = [], [], []
    for i, item in enumerate(order):
        desc = isinstance(item, Desc)
        raw = item.item if desc else item
        if isinstance(raw, str):
            n = raw
        else:
            n = f"_o{i}"
            df = df.withColumn(n, raw)
            helpers.append(n)
        names.append(n)
        sorts.append(F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_first())
    return df, names, helpers, sorts


def _tagged(df: DataFrame, keys: list[str], sorts: list[Column], partitions: int | None) -> DataFrame:
    """The rows with their range partition and their place inside it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or shuffle_partitions(spark)
    by = [F.col(k).asc_nulls_first() for k in keys] + sorts
    t = (df.repartitionByRange(n, *by).sortWithinPartitions(*by)
         .withColumn(_MID, F.monotonically_increasing_id()))
    t = (t.withColumn(_PID, F.shiftright(F.col(_MID), _LOCAL_BITS))
         .withColumn(_LOC, F.col(_MID).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
         .drop(_MID))
    return t.checkpoint(eager=True)


def _with_slices(rows: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Attach what is known per slice (range partition and key) to its rows."""
    on = [_PID, *keys]
    s = slices.select(*[F.col(c).alias(f"_s{c}") for c in on], *[c for c in slices.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in on])
    return rows.join(s, same).drop(*[f"_s{c}" for c in on])


def global_index(df: DataFrame, order: list, out: str = "row_idx",
                 partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row in ``order`` (BIGINT)."""
    return rank_within(df, [], order, out, partitions)


def rank_within(df: DataFrame, keys: list[str], order: list, out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row inside its ``keys`` group
    (the whole table when ``keys`` is empty)."""
    columns = [c for c in df.columns if c != out]
    wide, _, _, sorts = _order(df, order)
    t = _tagged(wide, keys, sorts, partitions)
    # one row per (range partition, key) slice: at most partitions + keys rows
    slices = t.groupBy(_PID, *keys).agg(F.min(_LOC).alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(_PID, *keys, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rank = (F.col("_before") + F.col(_LOC) - F.col("_first")).cast("bigint")
    return _with_slices(t, slices, keys).select(*columns, rank.alias(out))


def running_scan(df: DataFrame, keys: list[str], order: list,
                 sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None,
                 inclusive: bool = True,
                 partitions: int | None = None) -> DataFrame:
    """Per key group, in ``order``: ``sums`` -> running sum, ``lasts`` -> last
    non-null value so far. ``inclusive`` = the current row counts."""
    sums, lasts = sums or {}, lasts or {}
    columns = [c for c in df.columns if c not in sums and c not in lasts]
    wide, _, _, sorts = _order(df, order)
    wide = wide.withColumns({f"_v_{n}": e for n, e in list(sums.items()) + list(lasts.items())})
    t = _tagged(wide, keys, sorts, partitions)
    end = Window.currentRow if inclusive else -1
    w_local = Window.partitionBy(_PID, *keys).orderBy(_LOC).rowsBetween(Window.unboundedPreceding, end)
    local = t
    for n in sums:
        local = local.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(w_local))
    for n in lasts:
        local = local.withColumn(f"_l_{n}", F.last(f"_v_{n}", ignorenulls=True).over(w_local))
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    aggs += [F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(_LOC))).alias(f"_t_{n}")
             for n in lasts]
    slices = t.groupBy(_PID, *keys).agg(*aggs)
    w_prev = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(_PID, *keys,
                          *[F.sum(f"_t_{n}").over(w_prev).alias(f"_c_{n}") for n in sums],
                          *[F.last(f"_t_{n}", ignorenulls=True).over(w_prev).alias(f"_c_{n}") for n in lasts])
    res = _with_slices(local, carry, keys)
    outs = [(F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.col(f"_l_{n}"), F.lit(0))).alias(n) for n in sums]
    outs += [F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in lasts]
    return res.select(*columns, *outs)


def _compare(row: Column, bound: Column, desc: bool) -> tuple[Column, Column]:
    """(row before bound, row level with it) in one order item: ascending with
    NULL first or descending with NULL last."""
    if desc:
        before = (row.isNotNull() & bound.isNull()) | (row > bound)
    else:
        before = (row.isNull() & bound.isNotNull()) | (row < bound)
    return F.coalesce(before, F.lit(False)), row.eqNullSafe(bound)


def _position(column: Column, kind: DataType, desc: bool) -> Column:
    """A long that never falls along the order of ``column``: integers and times
    themselves, the first seven bytes of a string, the floor of other numbers. The
    lowest bit is given up, so that differences fit a long."""
    if isinstance(kind, StringType):
        value = F.conv(F.rpad(F.substring(F.hex(F.substring(column, 1, 7)), 1, 14), 14, "0"), 16, 10).cast("bigint")
    elif isinstance(kind, DateType):
        value = F.unix_date(column).cast("bigint")
    elif isinstance(kind, TimestampType):
        value = F.unix_micros(column)
    elif isinstance(kind, (IntegralType, BooleanType)):
        value = column.cast("bigint")
    elif isinstance(kind, NumericType):
        near = F.greatest(F.least(column.cast("double"), F.lit(9e18)), F.lit(-9e18))  # both skip NULL
        value = F.when(column.isNotNull(), F.floor(near).cast("bigint"))
    else:
        value = F.when(column.isNotNull(), F.lit(0).cast("bigint"))
    value = F.shiftright(F.bitwise_not(value) if desc else value, 1)
    return F.coalesce(value, F.lit((1 << 62) - 1 if desc else -(1 << 62)).cast("bigint"))


def _with_group(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with what is known of their group (one row per group)."""
    if not keys:
        only = table.select(F.struct(*table.columns).alias("t")).scalar()
        return rows.withColumn("_t", only).select("*", "_t.*").drop("_t")
    t = table.select(*[F.col(k).alias(f"_g{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in keys])
    return rows.join(F.broadcast(t), same, "left").drop(*[f"_g{k}" for k in keys])


def _cell_of(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that lie in one of their group's cells, with it in ``_c``."""
    mine = F.filter("_cells", lambda c: F.col(_AT).between(c["lo"], c["hi"]))
    return _with_group(rows, table, keys).withColumn("_c", F.try_element_at(mine, F.lit(1))).filter("_c IS NOT NULL")


def _start_cells(rows: DataFrame, keys: list[str], starts: DataFrame) -> tuple[DataFrame, int]:
    """Selection: per group the cells (intervals of ``_position``, the number of
    rows before and inside) that hold the start positions, and the most rows a cell
    has. A cell is cut into CELLS of equal width, by one aggregate that is combined
    before its shuffle, until it has few rows or a single position. Cells come to
    the driver: as many as there are starts."""
    spark = rows.sparkSession
    cell = F.struct(F.min(_AT).alias("lo"), F.max(_AT).alias("hi"), F.lit(0).cast("bigint").alias("before"), F.count("*").alias("n"))
    whole = rows.groupBy(*keys).agg(F.array(cell).alias("_cells"))
    table = _with_group(whole, starts, keys)
    schema, found = table.schema, table.collect()
    while True:
        cells = [c for row in found for c in row["_cells"] if c["lo"] is not None]
        open_ = [c for c in cells if c["n"] > NEAR_ROWS and c["lo"] < c["hi"]]
        table = spark.createDataFrame(found, schema)
        if not open_:
            return table, max((c["n"] for c in cells), default=0)
        lo, hi = F.col("_c.lo"), F.col("_c.hi")
        share = (F.col(_AT) - lo).cast("double") / F.greatest(hi - lo, F.lit(1)).cast("double")
        inside = _cell_of(rows, table, keys).withColumn("_i", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        parts = inside.groupBy(*keys, "_c.lo", "_c.before", "_i").agg(F.min(_AT).alias("_lo"), F.max(_AT).alias("_hi"), F.count("*").alias("_n"))
        w = Window.partitionBy(*keys, "lo").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.col("before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
        held = _with_group(parts, table.select(*keys, "starts"), keys).filter(
            F.exists("starts", lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_n"))))
        cell = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_before").alias("before"), F.col("_n").alias("n"))
        held = held.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"), F.first("starts").alias("starts"))
        found = held.select(*schema.names).collect()


def _bounds(near: DataFrame, keys: list[str], names: list[str], desc: list[bool], most: int, starts: DataFrame) -> DataFrame:
    """Per group the order keys found at the start positions: the positions ``at``,
    how many starts (of empty parts) coincide there, the ``lowest`` position and
    the number of rows with the ``same`` order key."""
    slot = [*keys, "_lo"]
    others = [n for n in names if n not in keys]
    distinct = near.groupBy(*keys, F.col("_c.lo").alias("_lo"), F.col("_c.before").alias("_before"), *others).agg(F.count("*").alias("_same"))
    if most <= NEAR_ROWS:
        by = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in zip(names, desc)]
        w = Window.partitionBy(*slot).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        distinct = distinct.withColumn("_sum", F.coalesce(F.sum("_same").over(w), F.lit(0)))
    else:  # many rows share one position: summed over range partitions
        order = [Desc(n) if d else n for n, d in zip(names, desc)]
        distinct = running_scan(distinct, slot, order, sums={"_sum": F.col("_same")}, inclusive=False)
    lowest = F.col("_before") + F.col("_sum")
    here = F.array_distinct(F.filter("starts", lambda x: (x >= lowest) & (x < lowest + F.col("_same"))))
    hit = _with_group(distinct, starts, keys).withColumn("_at", F.explode(here))
    times = F.size(F.filter("starts", lambda x: x == F.col("_at")))
    bound = F.struct(F.col("_at").alias("at"), times.alias("times"), *[F.col(n).alias(f"k{i}") for i, n in enumerate(names)],
                     lowest.alias("lowest"), F.col("_same").alias("same"))
    return hit.groupBy(*keys).agg(F.sort_array(F.collect_list(bound)).alias("_bounds"))


def part_of(df: DataFrame, keys: list[str], order: list, starts: DataFrame, out: str) -> DataFrame:
    """Add ``out``: how many of the group's start positions lie at or before
    the row's 0-based position in ``order``.

    ``starts`` has one row per group, ``keys`` and an array of ascending
    positions (column ``starts``); it must be as small as it sounds, a few
    classes by a few parts. Nothing is sorted but the few rows around each start,
    which selection finds (``_start_cells``). The rows found at the start
    positions are then compared with every row in a projection. Only rows that
    repeat the order key of a start are numbered among themselves, so that the
    parts have exact sizes."""
    columns = [c for c in df.columns if c != out]
    wide, names, helpers, _ = _order(df.select(*columns), order)
    desc = [isinstance(item, Desc) for item in order]
    narrow = wide.select(*dict.fromkeys([*keys, *names]))
    at = _position(F.col(names[0]), narrow.schema[names[0]].dataType, desc[0])
    narrow = narrow.withColumn(_AT, at)
    table, most = _start_cells(narrow, keys, starts)
    bounds = _bounds(_cell_of(narrow, table, keys), keys, names, desc, most, table.select(*keys, "starts"))
    schema, rows = bounds.schema, bounds.collect()  # one row per group, an entry per start
    found = df.sparkSession.createDataFrame(rows, schema)

    def passed(reached) -> Column:
        return F.aggregate(F.filter("_bounds", reached), F.lit(0).cast("bigint"), lambda n, b: n + b["times"])

    def level(b: Column) -> Column:
        return reduce(lambda x, y: x & y, [_compare(F.col(n), b[f"k{i}"], d)[1] for i, (n, d) in enumerate(zip(names, desc))])

    def before(b: Column) -> Column:
        out_, same = F.lit(False), F.lit(True)
        for i, (n, d) in enumerate(zip(names, desc)):
            less, equal = _compare(F.col(n), b[f"k{i}"], d)
            out_, same = out_ | (same & less), same & equal
        return out_

    empty = F.array().cast(found.schema["_bounds"].dataType)
    marked = _with_group(wide, found, keys).withColumn("_bounds", F.coalesce("_bounds", empty))
    marked = marked.withColumn(out, passed(lambda b: ~before(b)))
    if all(b["same"] == 1 for row in rows for b in row["_bounds"]):
        return marked.select(*columns, out)
    # rows level with a start: number them, and count the starts at or before
    tied = F.exists("_bounds", lambda b: level(b))
    numbered = rank_within(marked.filter(tied), [*keys, *[n for n in names if n not in keys]], names[:1], "_nth")
    place = F.element_at(F.filter("_bounds", lambda b: level(b)), 1)["lowest"] + F.col("_nth")
    exact = numbered.withColumn("_place", place).withColumn(out, passed(lambda b: b["at"] <= F.col("_place")))
    return marked.filter(~tied).select(*columns, out).unionByName(exact.select(*columns, out))


def top_k_per_group(df: DataFrame, keys: list[str], order: list, k: int,
                    out: str | None = None) -> DataFrame:
    """Rows ranked ``<= k`` by ``order`` inside ``keys`` (row_number, 1-based).

    The constant filter lets Catalyst put a partial WindowGroupLimit before the
    exchange (map-side top-k), so the shuffle carries ``k`` rows per group and
    input partition, however large the group."""
    rn = out or "_pc_rn"
    sorts = [(_expr(o.item).desc() if isinstance(o, Desc) else _expr(o)) for o in order]
    w = Window.partitionBy(*keys).orderBy(*sorts)
    res = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= F.lit(k))
    return res if out else res.drop(rn)
