"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. It begins
with one bucket; a bucket that is larger than the byte limit splits on its next
bit, and only such a bucket does, until every shard fits. Since a bucket's
bytes are the sum of its halves, the outcome needs no row-by-row inserts: bytes
are summed once per prefix of ``d`` bits, rolled up to all shorter prefixes,
and a document's shard is the shortest prefix that fits. Prefixes that do not
fit at ``d`` bits are taken up again with further bits.

Rows whose 60 hash bits agree (identical rows) cannot be split by bits; if
together they exceed the limit they fill overflow pages of their bucket, in
order. A document larger than the limit is a shard of its own. NULL text has 0
bytes; an empty table gives no rows; existing columns of the output's names are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecurate.llm.common import hinted, with_ordinal, written

BITS = 60
#: UTF-8 bytes of text in one shard.
SHARD_BYTES = 32 << 20
#: The same in the query, so that tables of any size split.
QUERY_BYTES = 16 << 10


def _hash_bits(id_col: Column, text: Column) -> Column:
    """60 bits of md5 over the id and the text's md5."""
    digest = F.md5(F.concat_ws(":", id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def build_directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Leaves of the directory as (index bits, table): the table maps each
    prefix of that many bits to its shard's depth, bytes and documents.
    ``rows``: h, n_bytes."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    above, width = 0, min(BITS, max(4, math.ceil(math.log2(max(1.0, total / limit))) + 4))
    pending, levels = rows, []
    while True:
        cells = written(pending.groupBy(_prefix(F.col("h"), width).alias("cell"))
                        .agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")), "shard-cells")
        first = above + 1 if above else 0
        per_depth = cells.select("cell", "n_bytes", "n_docs", F.explode(F.sequence(F.lit(first), F.lit(width))).alias("depth"))
        up = F.call_function("shiftright", F.col("cell"), (F.lit(width) - F.col("depth")).cast("int"))
        buckets = per_depth.groupBy("depth", up.alias("bucket")).agg(F.sum("n_bytes").alias("bytes"), F.sum("n_docs").alias("docs"))
        fits = buckets.filter((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        found = (per_depth.select("cell", "depth", up.alias("bucket")).join(fits, ["depth", "bucket"])
                 .groupBy("cell").agg(F.min(F.struct("depth", "bytes", "docs")).alias("leaf"))
                 .select("cell", "leaf.depth", F.col("leaf.bytes").alias("shard_bytes"), F.col("leaf.docs").alias("shard_docs")))
        found = written(found, "shard-directory")
        levels.append((width, found))
        open_cells = cells.join(found, "cell", "left_anti").select(F.col("cell").alias("_cell"))
        if not open_cells.limit(1).count():
            return levels
        pending = pending.join(hinted(open_cells, 1_000_000), _prefix(F.col("h"), width) == F.col("_cell"), "left_semi")
        above, width = width, min(BITS, width + 8)


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append n_bytes, shard (its bits, ``.page`` on overflow), depth,
    shard_bytes and shard_docs to every row."""
    out = ["n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    # the columns of docs travel in one, so that none clashes with a helper
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in out]
    rows = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       _hash_bits(F.col(id_col), F.col(text_col)).alias("_h"))
    narrow = written(rows.select(F.col("_h").alias("h"), "n_bytes"), "shard-rows")
    for i, (width, table) in enumerate(build_directory(narrow, limit)):
        leaf = table.select(F.col("cell").alias(f"_cell{i}"), F.struct("depth", "shard_bytes", "shard_docs").alias(f"_leaf{i}"))
        rows = rows.join(hinted(leaf, 1_000_000), _prefix(F.col("_h"), width) == F.col(f"_cell{i}"), "left").drop(f"_cell{i}")
    rows = rows.withColumn("_leaf", F.coalesce(*[F.col(f"_leaf{k}") for k in range(i + 1)]))
    rows = rows.select(*[c for c in rows.columns if not c.startswith("_leaf") and c != "_h"], "_h", "_leaf.*")
    bits = F.lpad(F.bin(_prefix(F.col("_h"), F.col("depth"))), F.col("depth"), F.lit("0"))
    rows = rows.withColumn("shard", F.when(F.col("depth") > 0, bits).otherwise(""))
    over = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    if narrow.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > limit) & (F.col("n") > 1)).limit(1).count():
        paged = with_ordinal(rows.filter(over), [F.col("_h"), F.col("n_bytes")], "_at")
        first = paged.groupBy("_h").agg(F.min("_at").alias("_first"), F.max("n_bytes").alias("_most"))
        page = F.floor((F.col("_at") - F.col("_first")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_most"))))
        paged = paged.join(first, "_h").withColumn("shard", F.concat_ws(".", "shard", page.cast("string")))
        sums = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
        paged = paged.drop("shard_bytes", "shard_docs").join(sums, "shard").drop("_at", "_first", "_most")
        rows = rows.filter(~over).unionByName(paged)
    return rows.select("_row.*", *out)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, **cols) -> None:
    """Write one folder of Parquet per shard. Rows are dealt by shard, and a
    shard fits its limit, so every task writes whole shards."""
    assign_shards(docs, limit, **cols).repartition("shard").write.partitionBy("shard").parquet(path)


def op7_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs, QUERY_BYTES).drop("text")


def op7_sql(limit: int = QUERY_BYTES) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
b AS (
  SELECT depth, h >> (60 - depth) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, range(0, 61) r(depth) GROUP BY 1, 2),
leaf AS (
  SELECT d.doc_id, n_bytes, h, min({{'depth': b.depth, 'bytes': shard_bytes, 'docs': shard_docs}}) AS l
  FROM d JOIN b ON b.bucket = h >> (60 - b.depth) AND (shard_bytes <= {limit} OR b.depth = 60)
  GROUP BY d.doc_id, n_bytes, h)
SELECT doc_id, n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - l.depth)), l.depth::INT, '0') END AS shard,
       l.depth::INT AS depth, l.bytes AS shard_bytes, l.docs AS shard_docs FROM leaf
"""
