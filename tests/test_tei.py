import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from pagecurate.sources.tei import explode_pages, read_records, segments_table

TEI = os.path.join(FIXTURES, "tei")


@pytest.fixture(scope="module")
def pages(spark):
    rec = read_records(spark, [TEI, "/nonexistent/folder"])
    return explode_pages(rec).withColumn("name", F.element_at(F.split("file", "/"), -1)).cache()


def segs(pages, name):
    p = pages.filter(F.col("name") == name)
    return [(r.page_ord, r.id, r.text_line, r.elem_ord)
            for r in p.selectExpr("page_ord", "inline(lines)").orderBy("page_ord", "elem_ord").collect()]


def test_no_pb_gives_nothing(pages):
    assert pages.filter(F.col("name") == "no_pb.xml").count() == 0


def test_preamble_dropped(pages):
    assert segs(pages, "preamble.xml") == [(1, "p-1", "First page title.", 0),
                                           (1, "p-3", "Spoken on the first page.", 1),
                                           (2, "p-4", "Second page.", 0)]


def test_repeated_link_is_two_pages(pages):
    assert [s[:2] for s in segs(pages, "repeat_link.xml")] == [(1, "r-1"), (2, "r-2")]


def test_pb_without_facs_drops_its_lines(pages):
    assert [s[:2] for s in segs(pages, "pb_no_facs.xml")] == [(1, "f-1"), (3, "f-3")]


def test_empty_page_not_emitted(pages):
    assert [s[:2] for s in segs(pages, "empty_page.xml")] == [(2, "e-1")]


def test_text_edges(pages):
    got = segs(pages, "text_edges.xml")
    assert got == [(1, "t-2", "Head text", 1), (1, "t-3", "Fish & chips > soup ä€", 2),
                   (1, "t-5", "Broken over lines", 4), (1, "t-6", "No break space", 5)]


def test_segments_table_page_numbers(spark, pages):
    t = segments_table(pages.filter(F.col("name") == "links.xml"))
    assert t.columns == ["id", "file", "page_link", "page_number", "marginal_text", "merged", "text_line"]
    assert sorted((r.id, r.page_number) for r in t.collect()) == [("l-1", 8), ("l-2", 12), ("l-3", None)]


def test_no_shuffle_in_extraction(spark, pages):
    rec = read_records(spark, TEI)
    plan = segments_table(explode_pages(rec))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_listing_and_reading_in_tasks_as_by_sparks_source(spark, tmp_path, monkeypatch):
    from pagecurate.sources import tei
    texts = {"å b%20+c#.xml": "x\r\ny", "_x.xml": "hidden", "_a=1.xml": "part", ".h.xml": "hidden", "e.xml": "", "x&1.xml": "z" * 5_000_000,
             "sub_x/q1.xml": "q", "sub_x/_hid/r.xml": "hidden", "sub_x/deep/r.xml": "r", "sub_x/r.txt": "no"}
    for name, text in texts.items():
        (tmp_path / "a b" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "a b" / name).write_bytes(text.encode())
    base = f"{tmp_path}/a b"
    asked = [base, f"file://{base}", [f"{base}/sub_x", f"{base}/_x.xml", f"{base}/x&1.xml"], f"{base}/sub_x/_hid"]
    rec = [read_records(spark, p) for p in asked]
    # no record file is in an index on the driver
    assert not [f for r in rec for f in r.inputFiles() if f.endswith(".xml")]
    got = [sorted(map(tuple, r.collect())) for r in rec]
    monkeypatch.setattr(tei, "listing", lambda *a: None)
    assert got == [sorted(map(tuple, read_records(spark, p).collect())) for p in asked] and len(got[0]) == 5


def test_parts_of_a_segment_are_computed_once(spark):
    lines = spark.createDataFrame([("<seg xml:id='a'>b</seg>",)], "c string").select(tei_lines("c").alias("l"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xml:id") <= 4 and plan.count(r"(?s)^<[^>]*>(.*)$") == 1


def tei_lines(c):
    from pagecurate.sources.tei import found_elements, page_lines
    return page_lines(found_elements(F.col(c)))
