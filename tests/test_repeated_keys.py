"""Order keys that repeat: every row once, exact part and class sizes; the wide
rows of the splits are not shuffled."""
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagecurate.operators import ordering
from pagecurate.operators.joins import update_by_id
from pagecurate.operators.layout import match_blocks
from pagecurate.operators.ordering import Desc, global_index, part_of, running_scan
from pagecurate.functions.text import xml_unescape
from pagecurate.plans.splits import split_contiguous, stratified_split


def table(spark, n=40):
    return spark.createDataFrame([(i % 5, "ab"[i % 2], i, f"payload {i}") for i in range(n)], "k int, c string, v int, payload string")


@pytest.mark.parametrize("order", [["k"], [Desc("k")], ["k", Desc("c")]])
def test_positions_and_scans_keep_every_row_once(spark, order):
    df = table(spark)
    got = global_index(df, order, "i", partitions=3).collect()
    assert sorted(r.i for r in got) == list(range(40)) and sorted(r.v for r in got) == list(range(40))
    got = running_scan(df, ["c"], order, sums={"s": F.lit(1)}, partitions=3).collect()
    assert sorted((r.c, r.s) for r in got) == [(c, s) for c in "ab" for s in range(1, 21)]


@pytest.mark.parametrize("n", [1, 3, 7, 60])
def test_contiguous_parts_are_ntile(spark, n):
    got = split_contiguous(table(spark), n, ["k"], "part").collect()
    assert Counter(r.part for r in got) == Counter(p for p in [1 + i for i in range(min(n, 40))] for _ in range(40 // n + (p <= 40 % n)))
    by_part = sorted((r.part, r.k) for r in got)
    assert [k for _, k in by_part] == sorted(k for _, k in by_part)


def test_nulls_and_descending_order(spark):
    df = spark.createDataFrame([(None,), (None,), (3,), (1,), (2,), (2,)], "k int")
    up = sorted((r.part, -1 if r.k is None else r.k) for r in split_contiguous(df, 3, ["k"], "part").collect())
    assert up == [(1, -1), (1, -1), (2, 1), (2, 2), (3, 2), (3, 3)]
    down = sorted((r.part, -1 if r.k is None else r.k) for r in split_contiguous(df, 3, [Desc("k")], "part").collect())
    assert down == [(1, 2), (1, 3), (2, 1), (2, 2), (3, -1), (3, -1)]


def test_coinciding_starts_are_empty_parts(spark):
    starts = spark.createDataFrame([("a", [5, 5, 20]), ("b", [0, 3, 3])], "c string, starts array<bigint>")
    got = part_of(table(spark), ["c"], ["v"], starts, "p").collect()
    assert Counter((r.c, r.p) for r in got) == {("a", 0): 5, ("a", 2): 15, ("b", 1): 3, ("b", 3): 17}


def test_stratified_sizes_with_one_id(spark):
    df = table(spark).withColumn("id", F.lit(1))
    sizes = Counter((r.c, r.split) for r in stratified_split(df, "c", "id").collect())
    assert sizes == {(c, s): k for c in "ab" for s, k in (("train", 14), ("val", 3), ("test", 3))}


@pytest.mark.parametrize("make", [lambda d: stratified_split(d, "c", "v"), lambda d: split_contiguous(d, 4, ["v"], "part")])
def test_wide_rows_have_no_exchange(spark, tmp_path, make, capsys):
    table(spark, 400).write.parquet(f"{tmp_path}/t")
    make(spark.read.parquet(f"{tmp_path}/t")).explain("formatted")
    plan = capsys.readouterr().out
    blocks = re.split(r"\n\n", plan)
    moved = [b for b in blocks if re.match(r"\(\d+\) Exchange", b.strip()) and "payload" in b]
    assert "payload" in plan and not moved


def test_block_index_beyond_21_bits(spark):
    seg = spark.createDataFrame([("p", 1, "exact words", 0)], "page string, id int, text string, elem_ord int")
    blk = spark.createDataFrame([("p", "x", "nothing", 0), ("p", "y", "exact words", 3_000_000)], "page string, block_id string, block_text string, block_idx int")
    for scorer in ("indel", "levenshtein"):
        r = match_blocks(seg, blk, ["page"], scorer=scorer).collect()
        assert [(x.block_id, x.block_idx) for x in r] == [("y", 3_000_000)]


def test_two_blocks_of_one_index_keep_one_match(spark):
    seg = spark.createDataFrame([("p", 1, "abc", 7)], "page string, id int, text string, elem_ord int")
    blk = spark.createDataFrame([("p", "x", "abc", 0), ("p", "y", "abd", 0)], "page string, block_id string, block_text string, block_idx int")
    assert [x.block_id for x in match_blocks(seg, blk, ["page"], scorer="levenshtein").collect()] == ["x"]


def test_update_keeps_existing_values(spark):
    df = spark.createDataFrame([(1, 6.0), (2, 7.0), (3, None)], "id int, v double")
    up = spark.createDataFrame([(2, 1.0, 1), (2, None, 2), (3, 5.0, 1)], "id int, v double, at int")
    assert sorted((r.id, r.v) for r in update_by_id(df, up, order_col="at").collect()) == [(1, 6.0), (2, None), (3, 5.0)]
    assert sorted((r.id, r.w) for r in update_by_id(df, up.selectExpr("id", "v as w", "at"), order_col="at").collect()) == [(1, None), (2, None), (3, 5.0)]
    with pytest.raises(Exception, match="several updates"):
        update_by_id(df, up.drop("at")).collect()


@pytest.mark.parametrize("raw,want", [("&#38;lt;", "&lt;"), ("&#x26;amp;", "&amp;"), ("a &lt;b&gt; &#65;&#x1F600; &unknown; &", "a <b> A😀 &unknown; &"),
                                      ("&#1114112;&#xD800;", "&#1114112;&#xD800;"), ("plain", "plain"), ("", ""), (None, None)])
def test_unescape_is_one_pass(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(xml_unescape("s").alias("o")).first().o == want


def _values(spark, kind):
    import random
    rng = random.Random(kind)
    made = {"bigint": lambda: rng.choice([None, -(1 << 63), (1 << 63) - 1, rng.randint(-50, 50), rng.randint(-10**12, 10**12)]),
            "string": lambda: rng.choice([None, "", "same prefix " + str(rng.randint(0, 60)), "ü" * rng.randint(1, 9), chr(rng.randint(33, 50000))]),
            "double": lambda: rng.choice([None, float("inf"), float("-inf"), float("nan"), rng.random(), rng.uniform(-1e6, 1e6), 1e300]),
            "timestamp": lambda: rng.choice([None, datetime(1850, 1, 1) + timedelta(seconds=rng.randint(0, 10**9))]),
            "boolean": lambda: rng.choice([None, True, False])}[kind]
    return spark.createDataFrame([("ab"[i % 3 == 0], made(), i) for i in range(400)], f"c string, v {kind}, i int")


@pytest.mark.parametrize("kind", ["bigint", "string", "double", "timestamp", "boolean"])
@pytest.mark.parametrize("down", [False, True])
def test_selection_equals_the_full_order(spark, monkeypatch, kind, down):
    """Refined cells (of few rows, and of many that share a position) give the
    parts of the sorted rows, for every type and direction."""
    df = _values(spark, kind)
    starts = spark.createDataFrame([("a", [0, 7, 7, 100]), ("b", [40, 133, 200, 999])], "c string, starts array<bigint>")
    by = F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_first()
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(by, "i")) - 1).join(starts, "c")
    expected = sorted((r.i, r.p) for r in ranked.withColumn("p", F.size(F.filter("starts", lambda s: s <= F.col("r")))).collect())
    order = [Desc("v") if down else "v", "i"]
    for cells, near in ((64, 5), (4096, 0)):
        monkeypatch.setattr(ordering, "CELLS", cells)
        monkeypatch.setattr(ordering, "NEAR_ROWS", near)
        assert sorted((r.i, r.p) for r in part_of(df, ["c"], order, starts, "p").collect()) == expected


def test_selection_numbers_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "NEAR_ROWS", 5)
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = split_contiguous(df, 7, ["k"], "part").collect()
    assert Counter(r.part for r in got) == {p: 143 if p <= 6 else 142 for p in range(1, 8)}
    assert [k for _, k in sorted((r.part, r.k) for r in got)] == sorted(r.k for r in got)
