"""ALTO layout source (A4).

Spark's XML source reads one row per ``Page`` with an explicit nested schema.
Children are homogeneous per level (blocks hold lines, lines hold strings), so
the array order is the reading order. The page key (package id, page index)
comes from the layout file name ``<package with _>-<NNN>.xml``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from pagecurate.operators.layout import block_box, block_text, block_words

STRING = StructType([StructField("_CONTENT", StringType()), StructField("_HPOS", DoubleType()),
                     StructField("_VPOS", DoubleType()), StructField("_WIDTH", DoubleType()),
                     StructField("_HEIGHT", DoubleType())])
TEXT_LINE = StructType([StructField("String", ArrayType(STRING))])
TEXT_BLOCK = StructType([StructField("_ID", StringType()), StructField("_HPOS", DoubleType()),
                         StructField("_VPOS", DoubleType()), StructField("_WIDTH", DoubleType()),
                         StructField("_HEIGHT", DoubleType()), StructField("TextLine", ArrayType(TEXT_LINE))])
PAGE = StructType([StructField("_WIDTH", DoubleType()), StructField("_HEIGHT", DoubleType()),
                   StructField("PrintSpace", StructType([StructField("TextBlock", ArrayType(TEXT_BLOCK))]))])

# Fixed value: layout file names, '<package with _>-<page index>.xml'.
LAYOUT_FILE = r"([^/]+)-(\d+)\.xml$"


def read_layout(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per layout page: (layout_file, package_id, page_index,
    page_width, page_height, blocks)."""
    df = (spark.read.format("xml").option("rowTag", "Page").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.xml").schema(PAGE).load(path))
    f = F.col("_metadata.file_path")
    stem = F.regexp_extract(f, LAYOUT_FILE, 1)
    return df.select(F.element_at(F.split(f, "/"), -1).alias("layout_file"),
                     F.replace(stem, F.lit("_"), F.lit("-")).alias("package_id"),
                     F.regexp_extract(f, LAYOUT_FILE, 2).cast("int").alias("page_index"),
                     F.col("_WIDTH").alias("page_width"), F.col("_HEIGHT").alias("page_height"),
                     F.coalesce(F.col("PrintSpace.TextBlock"), F.array()).alias("blocks"))


def explode_blocks(pages: DataFrame) -> DataFrame:
    """One row per text block: index, id, text (E8), box (B11) and words."""
    keep = [c for c in pages.columns if c != "blocks"]
    b = pages.select(*keep, F.posexplode("blocks").alias("block_idx", "_b"))
    return b.select(*keep, "block_idx", F.col("_b._ID").alias("block_id"),
                    block_words(F.col("_b")).alias("words"), block_box(F.col("_b")).alias("block_box")) \
        .withColumn("block_text", block_text(F.col("words")))
