import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagecurate import functions as fx


def one(spark, expr, *vals, schema="a STRING"):
    df = spark.createDataFrame([tuple(vals)], schema)
    return df.select(expr.alias("r")).first()["r"]


def py_normalise(t):
    return re.sub(r"\s+", " ", (t or "").replace("\n", "")).strip()


@pytest.mark.parametrize("text", [None, "", "  a\n b  ", "x  y", "tab\tsep\r\n", "a\x1cb", "　z　"])
def test_normalise_matches_python(spark, text):
    assert one(spark, fx.normalise_text("a"), text) == py_normalise(text)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab :\n\t  \x85é")), max_size=20))
def test_normalise_property(spark, text):
    assert one(spark, fx.normalise_text("a"), text) == py_normalise(text)


def test_unescape(spark):
    assert one(spark, fx.xml_unescape(F.col("a")), "&lt;x&gt; &amp;amp; &#228;&#x20AC;") == "<x> &amp; ä€"


@pytest.mark.parametrize("text,n", [("Herr TALMAN: jag: nej", 0), ("Herr TALMAN: jag: nej", 1),
                                     ("Herr TALMAN: jag: nej", 2), ("Herr TALMAN: jag: nej", 5),
                                     ("no colon", 1), ("", 1), (":lead", 1)])
def test_speaker_prefix_matches_split(spark, text, n):
    expected = "".join(re.split("(:)", text)[: n + 1])
    assert one(spark, fx.speaker_prefix("a", n), text) == expected


@pytest.mark.parametrize("link,expected", [
    ("https://x.org/p/prot_1867__ak__0125-006.jp2/_view", 7),
    ("https://x.org/fil/H0095#page=12", 12),
    ("https://x.org/fil/Y", None), (None, None)])
def test_page_number_from_link(spark, link, expected):
    assert one(spark, fx.page_number_from_link("a"), link) == expected


@pytest.mark.parametrize("link,expected", [
    ("https://x.org/p/prot_1867__ak__0125-006.jp2/_view", 6),
    ("https://x.org/fil/H0095#page=12", 12), ("nothing", None)])
def test_page_index_from_facs(spark, link, expected):
    assert one(spark, fx.page_index_from_facs("a"), link) == expected


def test_stem_package_layout(spark):
    link = "https://x.org/prot-1867--ak--0125/prot_1867__ak__125-006.jp2/_view"
    stem = one(spark, fx.page_stem_from_link("a"), link)
    assert stem == "prot_1867__ak__125-006"
    pkg = one(spark, fx.package_id("a"), stem)
    assert pkg == "prot-1867--ak--125"
    df = spark.createDataFrame([(pkg, 6), ("prot-1921--ak--11", 1234)], "p STRING, n INT")
    got = [r[0] for r in df.select(fx.layout_file_name("p", "n")).collect()]
    assert got == ["prot_1867__ak__0125-006.xml", "prot_1921__ak__11-1234.xml"]
    assert one(spark, fx.package_id("a"), "nodash") == "nodash"


def test_page_as_string(spark):
    df = spark.createDataFrame([(5,), (42,), (1234,)], "n INT")
    assert [r[0] for r in df.select(fx.page_as_string("n")).collect()] == ["005", "042", "1234"]


def test_record_meta(spark):
    df = spark.createDataFrame([("prot-1916--ak--100",), ("prot-1870--fk--0205",), ("prot-202223--95",)], "p STRING")
    ch = fx.record_chamber("p")
    got = df.select(fx.record_year("p"), ch, fx.second_chamber(ch), fx.unicameral(ch)).collect()
    assert [tuple(r) for r in got] == [(1916, "Andra kammaren", 1, 0), (1870, "Första kammaren", 0, 0),
                                       (2022, "Enkammarriksdagen", 0, 1)]


def test_relative_page_and_even(spark):
    df = spark.createDataFrame([(3, 6), (3, 0), (None, 4), (4, None)], "p INT, n INT")
    got = df.select(fx.relative_page_number("p", "n"), fx.even_page("p")).collect()
    assert [tuple(r) for r in got] == [(500.0, 0), (0.0, 0), (0.0, None), (0.0, 1)]


def test_decade_from_path(spark):
    df = spark.createDataFrame([("..\\data\\1867\\a.xml",), ("../data/1993/b.xml",), ("x",)], "f STRING")
    assert [r[0] for r in df.select(fx.decade_from_path("f")).collect()] == [1860, 1990, None]


def test_labels(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (None, 1)], "m INT, g INT")
    ft = fx.final_target("m", "g")
    got = df.select(ft, fx.segment_category("m", "g"), fx.label_name(ft)).collect()
    assert [tuple(r) for r in got] == [(0, "non-marginal", "other"), (1, "marginal", "marginal_text"),
                                       (1, "merged", "marginal_text"), (2, "merged", "merged"),
                                       (1, "merged", "marginal_text")]


def test_logits(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0],)], "l ARRAY<DOUBLE>")
    got = df.select(fx.argmax_class("l"), fx.softmax_uncertainty("l"), fx.sigmoid_decision(F.col("l")[0])).collect()
    assert got[0][0] == 1 and got[1][0] == 0
    assert abs(got[1][1] - 0.5) < 1e-12
    assert got[1][2] == 0  # sigmoid(0) = 0.5 is not > 0.5


def test_boxes(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 100.0, 0.0)], "h DOUBLE, v DOUBLE, w DOUBLE, t DOUBLE, pw DOUBLE, ph DOUBLE")
    b = fx.box_corners("h", "v", "w", "t")
    r = df.select("pw", "ph", b.alias("b")).select("b.*", fx.box_normalise("b", "pw", "ph").alias("n")).first()
    assert (r.left, r.upper, r.right, r.lower) == (10.0, 20.0, 40.0, 60.0)
    assert r.n.left == 100.0 and r.n.upper is None


def py_page_number(link):
    m = re.search(r"#page=(\d{1,3})", link)
    if m:
        return int(m.group(1))
    m = re.search(r"(\d{3})\.jp2/_view", link)
    return int(m.group(1)) + 1 if m else None


def _strict_int(s):
    # integer text as the links carry it (Python's int() would also take '1_0')
    return int(s) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", s) else None


def py_page_index(link):
    parts = link.split(".")
    a = _strict_int(parts[-2][-3:]) if len(parts) >= 2 else None
    return a if a is not None else _strict_int(link.split("=")[-1])


LINK_ALPHABET = st.sampled_from(list("0123456789./_#=page:jpvw") + [".jp2/_view", "#page=", "-"])


@settings(max_examples=60, deadline=None)
@given(st.lists(LINK_ALPHABET, max_size=12).map("".join))
def test_link_parsers_property(spark, link):
    df = spark.createDataFrame([(link,)], "a STRING")
    r = df.select(fx.page_number_from_link("a").alias("n"), fx.page_index_from_facs("a").alias("i")).first()
    assert r.n == py_page_number(link)
    assert r.i == py_page_index(link)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab :", max_size=15), st.integers(min_value=0, max_value=4))
def test_speaker_prefix_property(spark, text, n):
    assert one(spark, fx.speaker_prefix("a", n), text) == "".join(re.split("(:)", text)[: n + 1])
