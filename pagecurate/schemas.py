"""Declared schemas of the tables the library reads and writes (§1.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

SEGMENTS = StructType([
    StructField("id", StringType()), StructField("file", StringType()),
    StructField("page_link", StringType()), StructField("page_number", IntegerType()),
    StructField("marginal_text", DoubleType()), StructField("merged", DoubleType()),
    StructField("text_line", StringType()),
])
POSITION_FIELDS = [StructField(c, DoubleType()) for c in ("posLeft", "posUpper", "posRight", "posLower")] + [
    StructField("year", IntegerType()), StructField("relative_page_number", DoubleType()),
    StructField("even_page", IntegerType()), StructField("second_chamber", IntegerType()),
    StructField("unicameral", IntegerType())]
SEGMENTS_POS = StructType(SEGMENTS.fields + POSITION_FIELDS)
SEGMENTS_MULTI = StructType(SEGMENTS.fields + [StructField("final_target", IntegerType())])
ANNOTATIONS = StructType([StructField("id", StringType()), StructField("text_line", StringType()),
                          StructField("label", IntegerType())])


def validate(df: DataFrame, schema: StructType) -> DataFrame:
    """Fail early when a required column is missing; cast the rest to the
    declared types (extra columns pass through)."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cols = [df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)
