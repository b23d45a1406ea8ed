"""TEI record source (A1-A3, F1, F8, B1 on read).

A record is read whole, one row per file. Pages and segments
are cut with regular expressions over that text: narrow transformations, no
shuffle. Spark's XML source is not used here because it groups siblings by tag
and loses the interleaving of ``pb``, ``note``, ``seg`` and ``u``.

Assumptions on the markup (true for the record series): no comments or CDATA
inside segments, no ``>`` inside attribute values, no namespace prefixes on the
element names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecurate.functions.links import page_number_from_link
from pagecurate.functions.text import computed_once, normalise_text, xml_unescape
from pagecurate.sources.files import listing, read_whole

# The TEI markup that cuts pages and holds segments.
PB_MARKER = r"<pb(?=[\s/>])"
SEGMENT_TAGS = ("u", "seg", "note")
POSITION_TAGS = ("seg", "note")       # elements counted for the on-page ordinal
ID_ATTR = "xml:id"
LINK_ATTR = "facs"


def read_records(spark: SparkSession, path: str | list[str], pattern: str = "*.xml") -> DataFrame:
    """A1: every ``*.xml`` under ``path`` (recursively) -> (file, folder, value).

    A missing folder in a path list is skipped. Folders are listed and files read
    in tasks (``sources.files``): the driver holds none of their names."""
    paths = [path] if isinstance(path, str) else list(path)
    paths = _existing(spark, paths)
    if not paths:
        schema = "file STRING, folder STRING, value STRING"
        return spark.createDataFrame([], schema)
    files = listing(spark, paths, pattern)
    if files is None:
        df = (spark.read.option("pathGlobFilter", pattern)
              .option("recursiveFileLookup", "true")
              .text(paths, wholetext=True)).select(F.col("_metadata.file_path").alias("file"), "value")
    else:
        df = read_whole(files)
    return df.select("file", F.element_at(F.split("file", "/"), -2).alias("folder"), "value")


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    keep = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            keep.append(p)
    return keep


def _attr(tag: Column, name: str) -> Column:
    pat = r"\s" + name.replace(".", r"\.") + r"""\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    v = F.concat(F.regexp_extract(tag, pat, 1), F.regexp_extract(tag, pat, 2))
    return computed_once(xml_unescape(v), lambda x: F.when(x != "", x))


def element_pattern(tags) -> str:
    """Start tag of one of ``tags`` and the text after it up to the next markup
    (the element's own text; for a self-closed tag that text is not its own).
    Readable by Java regex and RE2 alike."""
    return r"<(?:" + "|".join(tags) + r")(?:[\s/][^>]*)?>[^<]*"


def found_elements(chunk: Column, tags=SEGMENT_TAGS, position_tags=POSITION_TAGS) -> Column:
    """ARRAY<STRUCT<m, ord>>: every start tag of ``tags`` in a page chunk with
    the text after it, and ``ord`` = number of ``position_tags`` elements
    before it on the page (F8).

    Linear in the page: the chunk is split once before every position tag, so
    piece k (k >= 1) starts with the k-th position tag and everything after
    that tag in the piece has k position tags before it."""
    before_pos = r"(?=<(?:" + "|".join(position_tags) + r")[\s/>])"
    pieces = F.split(F.concat(F.lit(" "), chunk), before_pos, -1)
    pat = F.lit(element_pattern(tags))
    return F.flatten(F.transform(pieces, lambda piece, k: F.transform(
        F.regexp_extract_all(piece, pat, F.lit(0)),
        lambda m, j: F.struct(m.alias("m"),
                              (k - F.when((k >= 1) & (j == 0), 1).otherwise(0)).alias("ord")))))


def page_lines(found: Column, id_attr: str | None = ID_ATTR, unescape: bool = True) -> Column:
    """ARRAY<STRUCT<id, text_line, elem_ord, elem_type>> of the segments of a page, from
    its ``found_elements`` column, in document order, non-blank text with an id
    only."""

    def one(e):
        tag, m = e["tag"], e["m"]
        raw = F.when(tag.endswith("/>"), F.lit("")).otherwise(
            F.regexp_extract(m, r"(?s)^<[^>]*>(.*)$", 1))
        text = normalise_text(xml_unescape(raw) if unescape else raw)
        ident = _attr(tag, id_attr) if id_attr else F.lit(None).cast("string")
        return F.struct(ident.alias("id"), text.alias("text_line"), e["ord"].cast("int").alias("elem_ord"),
                        _attr(tag, "type").alias("elem_type"))

    # the tag of an element is cut once, then read by every attribute
    found = F.transform(found, lambda e: F.struct(F.regexp_extract(e["m"], r"^(<[^>]*>)", 1).alias("tag"), e["m"].alias("m"), e["ord"].alias("ord")))
    lines = F.transform(found, one)
    keep = (lambda s: (F.length(s["text_line"]) > 0) & s["id"].isNotNull()) if id_attr else \
        (lambda s: F.length(s["text_line"]) > 0)
    return F.filter(lines, keep)


def explode_pages(records: DataFrame, text_col: str = "value", marker: str = PB_MARKER,
                  link_attr: str | None = LINK_ATTR, tags=SEGMENT_TAGS,
                  id_attr: str | None = ID_ATTR, position_tags=POSITION_TAGS,
                  unescape: bool = True) -> DataFrame:
    """A2 + F1: one row per page -> (…, page_ord, page_link, lines).

    A page is the text from one marker to the next; ``page_ord`` is the 1-based
    ordinal of its marker. Text before the first marker is dropped, a page
    whose marker has no link is dropped, so is a page without lines.
    The whole-record column is not carried past this step."""
    keep = [c for c in records.columns if c != text_col]
    chunks = records.select(*keep, F.posexplode(F.split(F.col(text_col), marker, -1))
                            .alias("page_ord", "chunk")).filter(F.col("page_ord") > 0)
    head = F.regexp_extract(F.col("chunk"), r"^([^>]*)>", 1)
    link = _attr(F.concat(F.lit(" "), head), link_attr) if link_attr else F.lit(None).cast("string")
    # the element list is computed once per page and then read by the lambdas
    pages = chunks.select(*keep, F.col("page_ord").cast("int").alias("page_ord"),
                          link.alias("page_link"),
                          found_elements(F.col("chunk"), tags, position_tags).alias("_found"))
    pages = pages.select(*keep, "page_ord", "page_link",
                         page_lines(F.col("_found"), id_attr, unescape).alias("lines"))
    if link_attr:
        pages = pages.filter(F.col("page_link").isNotNull())
    return pages.filter(F.size("lines") > 0)


def explode_segments(pages: DataFrame) -> DataFrame:
    """A3: one row per segment of the page table (order kept in ``line_ord``)."""
    keep = [c for c in pages.columns if c != "lines"]
    return (pages.select(*keep, F.posexplode("lines").alias("line_ord", "_s"))
            .select(*keep, F.col("line_ord").cast("int").alias("line_ord"),
                    "_s.id", "_s.text_line", "_s.elem_ord", "_s.elem_type"))


def record_head(records: DataFrame, text_col: str = "value", out: str = "pkg_name") -> DataFrame:
    """Package name of a record: the text of its ``head`` (one per record)."""
    h = F.regexp_extract(F.col(text_col), r"<head(?:\s[^>]*)?>([^<]*)", 1)
    return records.withColumn(out, F.nullif(normalise_text(xml_unescape(h)), F.lit("")))


def record_length(records: DataFrame, text_col: str = "value",
                  out: str = "last_page_link") -> DataFrame:
    """Link of the last ``pb`` of a record (F4: last following page break)."""
    links = F.regexp_extract_all(F.col(text_col), F.lit(r"<pb\s[^>]*facs\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return records.withColumn(out, F.try_element_at(links, F.lit(-1)))


def segments_table(pages: DataFrame, file_col: str = "file") -> DataFrame:
    """The annotation table of the sampled pages: id, file, page_link,
    page_number, marginal_text, merged, text_line (B2, B14)."""
    seg = explode_segments(pages)
    return seg.select(
        "id", F.col(file_col).alias("file"), "page_link",
        page_number_from_link(F.col("page_link")).alias("page_number"),
        F.lit(0.0).alias("marginal_text"), F.lit(0.0).alias("merged"), "text_line")
