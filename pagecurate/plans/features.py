"""Feature building.

* ``standardise`` — (x - mean) / population std, a zero std divides by 1.
  Default: statistics fitted on one subset (the train split) and applied to
  all rows; ``per_split`` refits per split (the reference's behaviour).
* ``build_vocabulary`` / ``encode_text`` — token ids with the special ids of a
  BERT-style encoder: 0 pad, 1 unknown, 2 start, 3 end; corpus tokens ranked by
  frequency (ties by token) from 4 on.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pagecurate.operators.ordering import Desc, global_index
from pagecurate.session import scratch_dir

# ship this module's code with the lookup, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Special token ids.
PAD_ID, UNK_ID, START_ID, END_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4
#: Vocabulary rows that a join may broadcast (some 30 bytes each).
BROADCAST_TOKENS = 1_000_000
TOKEN_SPLIT = r"[^\p{L}\p{N}]++"  # possessive: same split, no backtracking


def standardise(df: DataFrame, cols: list[str], fit_on: Column | None = None,
                per_split: str | None = None) -> DataFrame:
    src = df.filter(fit_on) if fit_on is not None else df

    def scale(sd):
        return F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)

    if per_split:
        stats = src.groupBy(per_split).agg(
            *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
        # one row per split: a bounded broadcast
        out = df.join(F.broadcast(stats), per_split, "left")
        for c in cols:
            out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / scale(F.col(f"_s_{c}")))
        return out.drop(*[f"_{p}_{c}" for c in cols for p in "ms"])
    out = df
    for c in cols:
        # scalar subqueries over the same relation are merged into one scan
        m = src.agg(F.avg(c)).scalar()
        s = src.agg(F.stddev_pop(c)).scalar()
        out = out.withColumn(c, (F.col(c) - m) / scale(s))
    return out


def tokenize(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT, -1), lambda x: x != "")


def build_vocabulary(df: DataFrame, text_col: str, min_count: int = 1,
                     max_size: int | None = None) -> DataFrame:
    """(token, n, token_id): the tokens of the corpus, counted with map-side
    combine; ids by (count desc, token) from a distributed global rank.

    ``max_size`` keeps the most frequent tokens only (a fixed-size encoder
    vocabulary; the rest encode as unknown): a top-N (TakeOrderedAndProject)
    whose N rows are then numbered."""
    counts = (df.select(F.explode(tokenize(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    if min_count > 1:
        counts = counts.filter(F.col("n") >= min_count)
    if max_size is not None:
        top = counts.orderBy(F.desc("n"), "token").limit(max_size)
        # at most max_size rows: the global window is bounded
        w = Window.orderBy(F.desc("n"), "token")
        return top.withColumn("token_id", (F.row_number().over(w) - 1 + FIRST_TOKEN_ID).cast("bigint"))
    ranked = global_index(counts, [Desc("n"), "token"], "_r")
    return ranked.withColumn("token_id", (F.col("_r") + F.lit(FIRST_TOKEN_ID)).cast("bigint")).drop("_r")


def encode_text(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame,
                max_len: int = 128, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(id, input_ids, attention_mask) of fixed length ``max_len``, one row per
    input row: start id, the first ``max_len - 2`` token ids, end id, then padding.

    Tokens are looked up inside the row, so no token of a text is shuffled and ids
    may repeat or be NULL. The lookup table holds a
    vocabulary of at most ``broadcast_tokens`` rows (counted), or the most frequent
    ones of a larger one. Then only the distinct other tokens of a row are
    shuffled, to meet the rest of the vocabulary, and come back as a small map per
    row."""
    body_len = max_len - 2
    tokens = F.slice(tokenize(text_col), 1, body_len)
    v = vocab.select("token", "token_id")
    if vocab.limit(broadcast_tokens + 1).count() <= broadcast_tokens:
        head, tail = v, None
    else:
        # ids follow the frequency, so the first ids are the frequent tokens
        frequent = F.col("token_id") < FIRST_TOKEN_ID + broadcast_tokens
        head, tail = v.filter(frequent), v.filter(~frequent)
    found = lookup(head)(tokens)
    if tail is None:
        rows = df.select(F.col(id_col), F.transform(F.coalesce(found, F.array().cast("array<bigint>")), lambda i: F.coalesce(i, F.lit(UNK_ID).cast("bigint"))).alias("_ids"))
    else:
        rows = _with_tail(df.select(F.col(id_col).alias("_id"), tokens.alias("_tokens"), found.alias("_ids")), tail).withColumnRenamed("_id", id_col)
    body = F.concat(F.array(F.lit(START_ID).cast("bigint")), "_ids", F.array(F.lit(END_ID).cast("bigint")))
    n = F.size("_ids") + 2
    ids_col = F.concat(body, F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), n),
                    F.array_repeat(F.lit(0).cast("bigint"), F.lit(max_len) - n))
    return rows.select(id_col, ids_col.alias("input_ids"), mask.alias("attention_mask"))


def lookup(vocab: DataFrame):
    """Column function: array of tokens -> array of their ids (NULL where a token
    is not in ``vocab``, a table of a size that has been checked). The table is
    read by every task from the shared folder, once per worker."""
    path = scratch_dir(vocab.sparkSession, "vocabulary")
    vocab.coalesce(1).write.parquet(path)

    @F.arrow_udf(ArrayType(LongType()))
    def ids(tokens: pa.Array) -> pa.Array:
        names, numbers = read_vocabulary(path)
        flat = tokens.flatten()
        at = pc.index_in(flat, value_set=names)
        found = pc.take(numbers, at)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, found, mask=tokens.is_null())

    return ids


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> tuple[pa.Array, pa.Array]:
    """(tokens, ids) of a vocabulary table in the shared folder."""
    import pyarrow.dataset as ds
    store, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    table = ds.dataset(inner, filesystem=store, format="parquet").to_table()
    return table.column("token").combine_chunks(), table.column("token_id").combine_chunks()


def _with_tail(rows: DataFrame, tail: DataFrame) -> DataFrame:
    """(_id, _ids) with the tokens that the head did not know looked up in the
    rest of the vocabulary. A row is named by its number in the written table."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "encoded")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    missing = F.filter(F.arrays_zip("_tokens", "_ids"), lambda x: x["_ids"].isNull())
    rare = rows.select("_row", F.explode(F.array_distinct(F.transform(missing, lambda x: x["_tokens"]))).alias("token"))
    known = rare.join(tail, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("_rare"))
    unknown = F.lit(UNK_ID).cast("bigint")
    every = F.transform(F.coalesce(F.arrays_zip("_tokens", "_ids"), F.array().cast("array<struct<_tokens:string,_ids:bigint>>")),
                        lambda x: F.coalesce(x["_ids"], F.col("_rare")[x["_tokens"]], unknown))
    return rows.join(known, "_row", "left").select("_id", every.alias("_ids"))
