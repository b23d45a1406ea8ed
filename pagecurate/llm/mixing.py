"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget in proportion to its weight, but no
more than ``max_epochs`` times its own size. Water-filling: with a level
``lam``, a source's target is ``min(cap, lam * weight)``; sources whose cap
lies below the level are clamped, what they leave over raises the level for
the others, until no further source is clamped. Each round is one aggregate
over the table of sources.

A target is met by seeded whole and fractional repetitions: a source taken
``e`` times over is taken ``floor(e)`` times whole, and the rest is filled with
documents in the order of a seeded hash, up to the document whose middle passes
the remaining number of words. The hash order is cut by a histogram over hash
prefixes, refined three hex digits at a time, so no source is ever sorted in
one task, however large.

Defined results: a NULL text has size 0; NULL is a source like any other (last
in order); identical rows (same id and text) stand or fall together; an empty
table gives an empty mix; a source without words gets the target 0. Existing
columns of the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecurate.llm.common import hinted, n_words, with_ordinal, written

#: Rows of one source and hash prefix that one task may order.
EDGE_ROWS = 2_000
KEY_DIGITS = 15


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Append ``target`` to a table (source, source_size, weight)."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    full_at = F.when(F.col("weight") > 0, cap / F.col("weight"))  # level at which a source is full
    level, n_clamped = None, 0
    while True:
        clamped = F.lit(False) if level is None else F.coalesce(full_at <= F.lit(level), F.lit(False))
        r = sources.agg(F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("free"),
                        F.sum(F.when(clamped, cap).otherwise(0.0)).alias("spent"),
                        F.count_if(clamped).alias("n")).first()
        if level is not None and r["n"] == n_clamped:
            break
        n_clamped = r["n"]
        if not r["free"]:
            level = float("inf")
            break
        level = (budget - r["spent"]) / r["free"]
    target = F.when(F.col("weight") > 0, F.least(cap, F.lit(level) * F.col("weight"))).otherwise(0.0)
    return sources.withColumn("target", target.cast("double"))


def _fill_order_edges(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source with a fractional repetition, the last hash key taken:
    (source, last_key). ``rows``: source, size, key."""
    need = targets.filter("rest > 0").select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    digits = 0
    w = Window.partitionBy("source").orderBy("part")

    def crossing(parts: DataFrame) -> DataFrame:
        """Running words before each part of a source."""
        return parts.withColumn("before", F.col("before") + F.coalesce(
            F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    while True:
        edge = hinted(need.select(F.col("source").alias("_s"), "rest", "prefix", "before"), 100_000)
        inside = rows.join(edge, rows["source"].eqNullSafe(F.col("_s"))
                           & (F.substring("key", 1, digits) == F.col("prefix"))).drop("_s")
        last = digits >= KEY_DIGITS or not inside.groupBy("source").count().filter(F.col("count") > EDGE_ROWS).limit(1).count()
        width = KEY_DIGITS if last else digits + 3
        parts = (inside.groupBy("source", F.substring("key", 1, width).alias("part"))
                 .agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before")))
        parts = crossing(parts)
        if last:
            taken = F.col("before") * 2 + F.col("size") <= F.col("rest") * 2
            return parts.filter(taken).groupBy("source").agg(F.max("part").alias("last_key")).union(
                # nothing of the edge prefix fits: all keys before it are taken
                need.select("source", F.col("prefix").alias("last_key"))).groupBy("source").agg(F.max("last_key").alias("last_key"))
        need = written(parts.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
                       .select("source", "rest", F.col("part").alias("prefix"), "before"), "mix-edge")
        digits = width


def plan_mix(docs: DataFrame, weights: Sequence[float], share: float = 1.0, max_epochs: float = 3.0, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document. ``weights`` go to the sources in
    code-point order (NULL last), repeating; ``share`` of all words is the
    budget. Returns ``docs`` with size, source_size, target, repeats, taken."""
    out = ["size", "source_size", "target", "repeats", "taken"]
    text = F.col(text_col)
    key = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"),
                                        F.md5(F.coalesce(text, F.lit("")).cast("binary")))), 1, KEY_DIGITS)
    # the columns of docs travel in one, so that none clashes with a column of the plan
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in out]
    sized = docs.select(F.struct(*kept).alias("_row"), F.col(source_col).alias("source"), n_words(text).alias("size"), key.alias("_key"))
    rows = written(sized.select("source", "size", F.col("_key").alias("key")), "mix-rows")
    ranked = with_ordinal(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                          [F.col("source").isNull().cast("int"), F.col("source")], "rank")
    sources = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                       (F.col("rank") % len(weights) + 1).cast("int")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    epochs = F.floor(F.col("target") / F.col("source_size"))
    targets = written(water_fill(sources, float(total) * share, max_epochs)
                      .withColumn("whole", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("long"))
                      .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    edges = _fill_order_edges(rows, targets)
    plan = targets.alias("t").join(edges.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select(
        F.col("t.source").alias("_source"), "source_size", "target", "whole", "last_key")
    plan = hinted(written(plan, "mix-plan"), 100_000)
    extra = F.coalesce((F.substring("_key", 1, F.length("last_key")) <= F.col("last_key")) & (F.length("last_key") == KEY_DIGITS)
                       | (F.substring("_key", 1, F.length("last_key")) < F.col("last_key")), F.lit(False))
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("repeats", F.col("whole") + extra.cast("long"))
            .withColumn("taken", F.col("size") * F.col("repeats")).select("_row.*", *out))


def mix(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **options) -> DataFrame:
    """The mixed table itself: every document as often as the mix takes it,
    with the columns of ``docs`` as they were."""
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return plan_mix(packed, weights, **options).filter("repeats > 0").select("_row", copies.alias("_copy")).select("_row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan_mix(docs, (5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken", "repeats")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(concat_ws(':', '42', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
f AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS full_at, (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (
  -- level if the sources that fill first, up to and without this one, are clamped
  SELECT *, (budget - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size,
    weight * (SELECT coalesce(arg_min(level, full_at) FILTER (WHERE level < full_at), 'infinity'::DOUBLE) FROM l)) AS target FROM f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
k AS (
  SELECT source, key, sum(size)::BIGINT AS size FROM d GROUP BY source, key),
c AS (
  SELECT k.source, key, target - whole * source_size AS rest, k.size,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
x AS (
  SELECT source, max(key) AS last_key FROM c WHERE rest > 0 AND 2 * before + size <= 2 * rest GROUP BY source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + coalesce(key <= last_key, false)::BIGINT))::BIGINT AS taken, (whole + coalesce(key <= last_key, false)::BIGINT)::BIGINT AS repeats
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
