"""Dataset profiling (I5) and the flagship segment/label profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagecurate.functions.labels import final_target
from pagecurate.functions.text import normalise_text
from pagecurate.operators.filters import keep_nonempty
from pagecurate.operators.joins import update_by_id
from pagecurate.plans.splits import stratified_split


def profile_dataset(df: DataFrame, split_col: str = "split",
                    targets=("marginal_text", "merged"),
                    box_cols=("posLeft", "posUpper", "posRight", "posLower")) -> DataFrame:
    """I5 in one aggregation job: per split and in total (``rollup``) the row
    count and share, positives and share of every target, and — when the box
    columns are present — rows with a missing box value and the box extent."""
    cols = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("n"), F.grouping(split_col).alias("_g")]
    for t in targets:
        if t in cols:
            aggs += [F.coalesce(F.sum(t), F.lit(0)).cast("double").alias(f"{t}_positives")]
    has_box = all(c in cols for c in box_cols)
    if has_box:
        floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
        miss = None
        for c in box_cols:
            m = (F.col(c).isNull() | F.isnan(F.col(c))) if c in floats else F.col(c).isNull()
            miss = m if miss is None else (miss | m)
        left, upper, right, lower = box_cols
        aggs += [F.count_if(miss).alias("null_rows"), F.min(left).alias("min_left"),
                 F.min(upper).alias("min_upper"), F.max(right).alias("max_right"), F.max(lower).alias("max_lower")]
    r = df.rollup(split_col).agg(*aggs)
    # the rollup has one row per split + 1: the global window over it is bounded
    total = F.max(F.when(F.col("_g") == 1, F.col("n"))).over(Window.partitionBy())
    out = [F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col(split_col).cast("string")).alias(split_col),
           "n", (F.col("n") / total).alias("share")]
    for t in targets:
        if t in cols:
            out += [f"{t}_positives", (F.col(f"{t}_positives") / F.col("n")).alias(f"{t}_share")]
    if has_box:
        out += ["null_rows", "min_left", "min_upper", "max_right", "max_lower"]
    return r.select(*out)


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment table of the ``documents`` corpus: one row per non-blank line."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    seg = lines.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("id"),
                       "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                       normalise_text("raw").alias("text_line"))
    return keep_nonempty(seg)


def segment_label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: segments of labelled documents, the stratified split of the
    annotated documents, and per split the segment count and the share of
    marginal / merged / 3-class targets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("quality").alias("marginal_text"), F.col("toxic").alias("merged"))
    split = stratified_split(labels, "marginal_text", "doc_id", seed=42)
    # segments are counted per document before labels and splits come in
    per_doc = document_segments(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    joined = update_by_id(per_doc, split, key="doc_id").filter(F.col("split").isNotNull())
    third = (final_target("marginal_text", "merged") == 2).cast("double")

    def share(value):
        return F.sum(value * F.col("n")) / F.sum(F.when(value.isNotNull(), F.col("n")))

    r = joined.rollup("split").agg(
        F.sum("n").alias("segments"),
        F.count(F.lit(1)).alias("documents"),
        share(F.col("marginal_text")).alias("marginal_share"),
        share(F.col("merged")).alias("merged_share"),
        share(third).alias("merged_class_share"),
        F.grouping("split").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("split")).alias("split"),
                    "segments", "documents",
                    *[F.round(c, 6).alias(c) for c in ("marginal_share", "merged_share", "merged_class_share")])
