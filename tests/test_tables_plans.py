import os
import shutil
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import FIXTURES, SF_SMALL
from pagecurate import schemas
from pagecurate.sources import tables
from pagecurate.sources.alto import read_layout
from pagecurate.sources.tei import explode_pages, read_records, segments_table


def test_csv_roundtrip_and_parts(spark):
    out = tempfile.mkdtemp(prefix="pc-tables-")
    df = spark.createDataFrame([("a", "f", "l", 1, 0.0, 0.0, 'text, with "quote"\nand line'),
                                ("b", "f", "l", 2, 1.0, 0.0, "plain")], schemas.SEGMENTS)
    tables.write_table(df, f"{out}/csv", fmt="csv")
    back = tables.read_annotations(spark, f"{out}/csv", schemas.SEGMENTS)
    assert sorted(r.text_line for r in back.collect()) == sorted(r.text_line for r in df.collect())
    tables.write_parts(spark.range(10), f"{out}/parts", 3, ["id"])
    parts = tables.read_parts(spark, f"{out}/parts")
    assert sorted(r["count"] for r in parts.groupBy("part").count().collect()) == [3, 3, 4]
    assert parts.count() == 10


def test_corpus_sample(spark):
    from pagecurate.plans.corpus import sample_corpus
    base = tempfile.mkdtemp(prefix="pc-corpus-")
    src = os.path.join(FIXTURES, "tei")
    layout = {"1921": ["preamble.xml"], "1931": ["pb_no_facs.xml"], "1871": ["links.xml"],
              "1991": ["links.xml"], "200001": ["no_pb.xml"], "notayear": ["links.xml"]}
    for folder, names in layout.items():
        os.makedirs(f"{base}/{folder}")
        for n in names:
            shutil.copy(f"{src}/{n}", f"{base}/{folder}/{n}")
    out = tempfile.mkdtemp(prefix="pc-sample-")
    seg = sample_corpus(spark, base, 1867, 2022, files_per_decade=2, pages_per_file=1, output=out)
    files = {r.file.split("/")[-2] for r in seg.select("file").distinct().collect()}
    assert files == {"1921", "1931", "1871"}          # 1991 is in the gap; 200001 has no page
    assert seg.groupBy("file").agg(F.countDistinct("page_link")).filter("`count(DISTINCT page_link)` > 1").count() == 0
    copies = {os.path.join(d, n) for d, _, names in os.walk(f"{out}/records") for n in names if n.endswith(".xml")}
    assert len(copies) >= 3 and files <= {c.split("/")[-2] for c in copies}
    for c in copies:                                  # the same bytes in the same year folder
        with open(c, "rb") as a, open(c.replace(f"{out}/records", base), "rb") as b:
            assert a.read() == b.read()


def test_write_files_gets_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    from pagecurate.sources import tables
    seen = []
    taken = type(spark.range(1)).mapInArrow

    def noted(self, f, schema):
        seen.append(int(spark.conf.get(tables.ARROW_ROWS)))
        return taken(self, f, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", noted)
    before = spark.conf.get(tables.ARROW_ROWS)
    df = spark.range(700).select(F.col("id").cast("string").alias("name"), F.col("id").cast("string").alias("value"))
    assert tables.write_files(df, str(tmp_path), "name", "value") == 700 and seen and max(seen) <= tables.WRITE_ROWS
    assert spark.conf.get(tables.ARROW_ROWS) == before


def test_tei_records_of_repeated_and_null_ids(spark, tmp_path):
    from pagecurate.registry import QUERIES
    rows = [(1, "a & b\nc"), (1, "a & b\nc"), (1, "d"), (None, "no id"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["tei_records"](spark, str(tmp_path)).collect()))
    assert got == [("d1-l0", 1, "a & b"), ("d1-l0", 1, "a & b"), ("d1-l0", 1, "d"), ("d1-l1", 1, "c"), ("d1-l1", 1, "c")]


def test_drawn_folders_are_listed_without_an_index(spark, tmp_path):
    from pagecurate.plans.corpus import list_files
    for name in ("1900/a.xml", "1900/empty.xml", "1900/b.txt", "1900/deep/c.xml", "1901/a.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else "x")
    files = list_files(spark, str(tmp_path), spark.createDataFrame([("1900",)], "folder STRING"))
    assert not [f for f in files.inputFiles() if f.endswith(".xml")]
    assert [tuple(r) for r in files.collect()] == [("1900", "a.xml", f"file:{tmp_path}/1900/a.xml")]


def test_write_files_keeps_bytes_and_names(spark, tmp_path):
    from pagecurate.sources.tables import write_files
    rows = [("a/x.xml", "å\r\n\x00z"), ("a/y.xml", ""), ("b.xml", None), ("c/d/e.txt", "q" * 100_000)]
    df = spark.createDataFrame(rows, "name STRING, value STRING")
    for _ in range(2):                                # a second run leaves the same files
        assert write_files(df, f"file:{tmp_path}", "name", "value") == 4
    found = {os.path.relpath(os.path.join(d, n), tmp_path): open(os.path.join(d, n), "rb").read()
             for d, _, names in os.walk(tmp_path) for n in names if not n.endswith(".crc")}
    assert found == {n: (v or "").encode() for n, v in rows}
    assert write_files(df.limit(0), str(tmp_path / "none"), "name", "value") == 0
    with pytest.raises(Exception, match="no name"):
        write_files(spark.createDataFrame([(None, "a")], "name STRING, value STRING"), str(tmp_path), "name", "value")


def test_positional_features(spark):
    from pagecurate.plans.positional import positional_features
    rec = read_records(spark, os.path.join(FIXTURES, "tei"))
    ann = segments_table(explode_pages(rec))
    lay = read_layout(spark, os.path.join(FIXTURES, "alto"))
    out = {r.id: r for r in positional_features(ann, rec, lay).collect()}
    assert (out["p-1"].posLeft, out["p-1"].posRight) == (50.0, 450.0)
    assert (out["p-3"].posUpper, out["p-3"].posLower) == (100.0, 120.0)
    assert (out["f-1"].posUpper, out["f-1"].posLower) == (10.0, 20.0)   # tie -> nearest block index
    assert out["f-1"].relative_page_number == 10 / 12 * 1000
    assert out["r-1"].unicameral == 1 and out["r-1"].year == 2022
    assert out["l-3"].posLeft is None and out["l-3"].relative_page_number == 0.0
    assert out["t-2"].posLeft == 0.0          # layouts are keyed by file name, not by folder
    assert out["e-1"].posLeft is None         # page 1 has no layout; page 4 (offset 3) has
    shifted = {r.id: r for r in positional_features(ann, rec, lay, max_page_offset=10).collect()}
    assert (shifted["e-1"].posLeft, shifted["e-1"].posUpper) == (100.0, 700.0)
    assert shifted["p-1"].posLeft == 50.0


def test_plan_shapes(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    sf = SF_SMALL

    def plan(name):
        df = q[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        return df._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan("top_k_uncertain")
    for name in ("match_blocks", "nearest_following_page"):
        p = plan(name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Exchange" not in plan("explode_segments")
    assert "WindowGroupLimit" in plan("sample_per_group")


def test_profile_is_one_aggregation_and_weights_broadcast(spark):
    from pagecurate.operators.metrics import with_class_weights
    from pagecurate.plans.profile import profile_dataset
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("split"),
                                 (F.col("id") % 2).alias("marginal_text"), (F.col("id") % 5 == 0).cast("int").alias("merged"),
                                 F.col("id").cast("double").alias("posLeft"), F.lit(1.0).alias("posUpper"),
                                 F.lit(2.0).alias("posRight"), F.when(F.col("id") % 7 == 0, None).otherwise(3.0).alias("posLower"))
    p = profile_dataset(df)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1
    rows = {r.split: r for r in p.collect()}
    assert rows["total"].n == 100 and rows["total"].null_rows == 15 and rows["total"].merged_positives == 20.0
    w = with_class_weights(df, "marginal_text")
    assert "BroadcastHashJoin" in w._jdf.queryExecution().executedPlan().toString()


def test_year_window_reaches_the_scan(spark):
    from pagecurate.operators.filters import date_year_window
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    df = date_year_window(o, "o_orderdate", 1992, 1997)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    years = {r.y for r in df.select(F.year("o_orderdate").alias("y")).distinct().collect()}
    assert years and all(1994 <= y <= 1997 for y in years)


def test_speaker_notes_by_type(spark):
    from pagecurate.plans.positional import positional_features
    rec = read_records(spark, os.path.join(FIXTURES, "tei"))
    ann = segments_table(explode_pages(rec))
    lay = read_layout(spark, os.path.join(FIXTURES, "alto"))
    out = {r.id: r for r in positional_features(ann, rec, lay, speaker_colons="by_type").collect()}
    # the speaker note boxes the words up to its colon; plain notes take the whole block
    assert (out["sp-1"].posLeft, out["sp-1"].posRight, out["sp-1"].posLower) == (0.0, 160.0, 20.0)
    assert out["t-2"].posRight == 500.0
    plain = {r.id: r for r in positional_features(ann, rec, lay).collect()}
    assert plain["sp-1"].posRight == 500.0


def test_read_part_files_in_name_order_and_validate(spark):
    out = tempfile.mkdtemp(prefix="pc-partfiles-")
    for i in (2, 0, 1):
        spark.createDataFrame([(f"s{i}", "f", "l", i, 0.0, 0.0, f"t{i}")], schemas.SEGMENTS) \
            .write.mode("overwrite").parquet(f"{out}/part_{i}")
    merged = tables.read_part_files(spark, [f"{out}/part_{i}" for i in (2, 0, 1)])
    # parts are unioned in name order; a union keeps its children's order
    assert [r.part_file.split("_")[-1] for r in merged.collect()] == ["0", "1", "2"]
    checked = schemas.validate(merged, schemas.SEGMENTS)
    assert checked.columns[:7] == schemas.SEGMENTS.fieldNames()
    with pytest.raises(ValueError):
        schemas.validate(merged.drop("text_line"), schemas.SEGMENTS)


def test_read_layout_blocks_in_reading_order(spark):
    from pagecurate.sources.alto import explode_blocks
    lay = read_layout(spark, os.path.join(FIXTURES, "alto", "prot-1921--ak--011"))
    pages = {(r.package_id, r.page_index): r for r in lay.collect()}
    assert set(pages) == {("prot-1921--ak--011", 4), ("prot-1921--ak--011", 5)}
    assert (pages[("prot-1921--ak--011", 4)].page_width, pages[("prot-1921--ak--011", 4)].page_height) == (2000.0, 3000.0)
    blocks = explode_blocks(lay).filter(F.col("page_index") == 4).orderBy("block_idx").collect()
    assert [b.block_id for b in blocks] == ["B1", "B2", "B3"]
    assert [b.block_text for b in blocks] == ["First page title.", "Spoken on the first page.", "42"]
    b2 = blocks[1]
    assert (b2.block_box.left, b2.block_box.upper, b2.block_box.right, b2.block_box.lower) == (100.0, 300.0, 1000.0, 360.0)
    assert [w.content for w in b2.words][:2] == ["Spoken", "on"] and b2.words[0].box.right == 250.0
