"""Layout linkage.

``match_blocks`` links each text segment to the most similar OCR block of the
same page without scoring every (segment, block) pair. Each text carries its
length and the number of its characters of each of a few classes; two texts
whose counts differ by P characters on one side and N on the other are at least
P + N insertions and deletions, or max(P, N) edits apart. A first pass takes up
to three candidates per segment (the blocks at the segment's on-page ordinal and
its neighbours) and scores the one whose bound is best; the second pass only scores
blocks whose length and counts can still reach that seed. Both bounds are exact,
so the argmax is unchanged. Blocks are bucketed by length on a geometric scale
and the segment side lists the buckets its band covers, which turns the band into
an equi-join on (page, bucket).

Segments are told apart by all that is matched (id, ordinal, text), so ids may
repeat on a page or be NULL; every segment row gets its own result row.

``nearest_following`` is a forward as-of join by sorting.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecurate.functions.boxes import box_corners
from pagecurate.operators.fuzzy import indel_ratio
from pagecurate.operators.ordering import Desc, running_scan
from pagecurate.session import shuffle_partitions

_BUCKET_BASE = 1.25
_FAR = (1 << 31) - 1

# Fixed value: the left and upper edge that a box union starts from. A scan wider
# or higher than this keeps it as the edge of boxes that lie wholly beyond it.
BOX_START = 9999.0


#: Disjoint classes of characters whose counts bound distances from below.
COUNTED = [" .,", "aA", "eE", "iI", "nN", "oO", "rR", "sS", "tT", "lLmM", "dDgG", "uUvV", "0123456789"]


def _counts(text: Column) -> list[Column]:
    """Characters of each class of COUNTED, and all others."""
    of = [F.length(text) - F.length(F.translate(text, c, "")) for c in COUNTED]
    return [*of, F.length(text) - reduce(add, of)]


def _excess(a: str, b: str) -> tuple[Column, Column]:
    """Characters that text ``a`` has more of than ``b``, and the other way round."""
    pairs = [(F.col(f"{a}{i}"), F.col(f"{b}{i}")) for i in range(len(COUNTED) + 1)]
    return (reduce(add, [F.greatest(x - y, F.lit(0)) for x, y in pairs]), reduce(add, [F.greatest(y - x, F.lit(0)) for x, y in pairs]))


def _most(scorer: str) -> Column:
    """Upper bound of the score of a pair (columns _a*, _la of one text, _b*, _lb of the other)."""
    more, less = _excess("_a", "_b")
    if scorer == "levenshtein":
        return -F.greatest(more, less).cast("double")
    total = F.col("_la") + F.col("_lb")  # rounding adds half a point at most
    return F.when(total == 0, 100.0).otherwise(100.0 * (1 - (more + less) / total) + 0.5)


def _bucket(length: Column) -> Column:
    return F.floor(F.log(_BUCKET_BASE, length.cast("double") + F.lit(1.0))).cast("int")


def _score(scorer: str, a: Column, b: Column, least: Column | None = None) -> Column:
    """Similarity of two texts; with ``least``, any lower number below that score
    where the scorer can stop early."""
    if scorer == "indel":
        return indel_ratio(a, b).cast("double")
    if scorer == "levenshtein":
        if least is None:
            return (-F.levenshtein(a, b)).cast("double")
        limit = F.coalesce(-least, F.greatest(F.length(a), F.length(b)).cast("double")).cast("int")
        # Spark's banded distance gives -1 beyond its limit; used once, or it is computed again
        return (-F.pmod(F.call_function("levenshtein", a, b, limit), F.lit(_FAR))).cast("double")
    raise ValueError(f"unknown scorer {scorer!r}")


def _band(scorer: str, la: Column, best: Column) -> tuple[Column, Column]:
    """Block lengths [lo, hi] that can still reach ``best`` for a segment of
    length ``la``; NULL best = no bound."""
    la = la.cast("double")
    if scorer == "indel":
        # rounded ratio >= best needs 200*min/(la+lb) >= best - 0.5
        t = best - F.lit(0.5)
        lo = F.when(t > 0, F.ceil(t * la / (F.lit(200.0) - t) - F.lit(1e-9)))
        hi = F.when(t > 0, F.floor(la * (F.lit(200.0) - t) / t + F.lit(1e-9)))
    else:
        # -levenshtein >= best needs |la - lb| <= -best
        d = -best
        lo, hi = F.ceil(la - d), F.floor(la + d)
    return F.coalesce(F.greatest(lo, F.lit(0)), F.lit(0)).cast("bigint"), hi.cast("bigint")


def match_blocks(segments: DataFrame, blocks: DataFrame, keys: list[str],
                 seg_id: str = "id", seg_text: str = "text", seg_ord: str = "elem_ord",
                 blk_id: str = "block_id", blk_text: str = "block_text", blk_idx: str = "block_idx",
                 scorer: str = "indel", seg_colons: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """D4 + G1: per segment the best block of the same ``keys`` (page).

    Best = highest score; ties -> block index nearest to the segment ordinal,
    then the lowest index. Returns keys, seg_id, blk_id, blk_idx, score and the
    segment columns ``carry``, one row per segment row; segments without any
    block on their page are absent.

    ``seg_colons`` (speaker notes): name of a segment column with the colon
    count n; each block text is cut to its first n+1 colon pieces before
    scoring. The cut length depends on the pair, so this mode scores every
    block of the page (speaker notes are a few per page).
    """
    text, carry = F.col(seg_text), carry or []
    # all that tells a segment row from another one of its page
    own = F.struct(F.col(seg_id).alias("sid"), F.md5(text).alias("text"), F.col(seg_ord).alias("ord"),
                   (F.col(seg_colons) if seg_colons else F.lit(None)).alias("colons"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    seg = segments.select(*keys, own.alias("_own"), text.alias("_st"), F.col(seg_ord).alias("_so"))
    blk = blocks.select(*keys, F.col(blk_id).alias("_bid"), F.col(blk_text).alias("_bt"),
                        F.col(blk_idx).alias("_bi"), F.length(blk_text).alias("_lb"))
    if seg_colons:
        from pagecurate.functions.text import speaker_prefix
        cand = (seg.join(blk, keys)
                .withColumn("_score", _score(scorer, F.col("_st"), speaker_prefix(F.col("_bt"), F.col("_own.colons")))))
        return _best(cand, seg, keys, seg_id, blk_id, blk_idx, carry)
    counts_a = {f"_a{i}": c for i, c in enumerate(_counts(F.col("_st")))}
    counts_b = {f"_b{i}": c for i, c in enumerate(_counts(F.col("_bt")))}
    texts = seg.withColumns(counts_a | {"_la": F.length("_st")})
    blk = blk.withColumns(counts_b)
    # pass 1: the blocks at the segment's own ordinal and its two neighbours
    # (a constant number of equi-join probes); the one with the best bound is scored
    at = F.explode(F.array(F.col("_so") - 1, F.col("_so"), F.col("_so") + 1)).alias("_bi")
    probed = texts.select(*keys, "_own", "_st", *counts_a, "_la", at).join(blk.drop("_bid"), [*keys, "_bi"])
    # scoring costs far more than moving the two texts, so the pairs are dealt out
    # evenly before it, whatever the pages they come from
    dealt = shuffle_partitions(segments.sparkSession)
    seed = probed.groupBy(*keys, "_own").agg(F.max_by(F.struct("_st", "_bt"), _most(scorer)).alias("_p")).repartition(dealt, "_own")
    seed = seed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_own").alias("_o"),
                       _score(scorer, F.col("_p._st"), F.col("_p._bt")).alias("_seed"))
    # pass 2: blocks that can reach it; without one, up to the longest block of the page
    longest = blk.groupBy(*keys).agg(F.max("_lb").alias("_longest"))
    lo, hi = _band(scorer, F.col("_la"), F.col("_seed"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]) & (F.col("_own") == F.col("_o"))
    seeded = texts.join(longest, keys).join(seed, same, "left").drop(*[f"_k{i}" for i in range(len(keys))], "_o")
    banded = (seeded.withColumn("_lo", lo).withColumn("_hi", F.least(F.coalesce(hi, F.col("_longest")), F.col("_longest")))
              .filter(F.col("_lo") <= F.col("_hi")).drop("_longest")
              .withColumn("_bk", F.explode(F.sequence(_bucket(F.col("_lo")), _bucket(F.col("_hi"))))))
    cand = (banded.join(blk.withColumn("_bk", _bucket(F.col("_lb"))), [*keys, "_bk"])
            .filter(F.col("_lb").between(F.col("_lo"), F.col("_hi")) & F.coalesce(_most(scorer) >= F.col("_seed"), F.lit(True)))
            .select(*keys, "_own", "_st", "_so", "_bid", "_bt", "_bi", "_seed").repartition(dealt, "_own", "_bi")
            .withColumn("_score", _score(scorer, F.col("_st"), F.col("_bt"), F.col("_seed"))))
    return _best(cand, seg, keys, seg_id, blk_id, blk_idx, carry)


def _best(cand: DataFrame, seg: DataFrame, keys, seg_id, blk_id, blk_idx, carry) -> DataFrame:
    """G1: highest score, then the block index nearest the element ordinal,
    then the lowest block index; the block id travels with the winner. Segment
    rows that are equal in all that is matched get a row each."""
    rank = F.struct("_score", (-F.abs(F.col("_bi") - F.col("_so"))).alias("_near"), (-F.col("_bi")).alias("_low"))
    winner = F.max_by(F.struct("_bid", "_bi", "_score"), rank).alias("_w")
    copies = seg.groupBy(*keys, "_own").agg(F.count("*").alias("_n")).filter("_n > 1")
    best = cand.groupBy(*keys, "_own").agg(winner)
    same = [F.col(f"_k{i}") == F.col(k) for i, k in enumerate(keys)]
    copies = copies.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_own").alias("_o"), "_n")
    best = best.join(copies, reduce(lambda x, y: x & y, same) & (F.col("_own") == F.col("_o")), "left")
    best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))))
    return best.select(*keys, F.col("_own.sid").alias(seg_id), F.col("_w._bid").alias(blk_id), F.col("_w._bi").alias(blk_idx),
                       F.col("_w._score").alias("score"), *[F.col(f"_own.c{i}").alias(c) for i, c in enumerate(carry)])


def nearest_following(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str,
                      max_offset: int = 10, right_cols: list[str] | None = None) -> DataFrame:
    """For each left row the right row of the same ``keys`` at the smallest
    position in [pos, pos + max_offset]; none -> NULL columns. Of several right
    rows at one position the least in ``right_cols`` counts.

    A forward as-of join: both sides are sorted together, from the last position
    to the first, over range partitions, and the last right row seen so far
    (carried from one partition to the next) is the nearest one that follows. Left
    rows are never looked up again, so ids may repeat or be NULL; rows with a NULL
    key or position find nothing."""
    rc = right_cols or []
    side, pos, found = "_asof_side", "_asof_pos", "_asof_found"
    known = right.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, right_pos)]))
    known = known.groupBy(*keys, F.col(right_pos).alias(pos)).agg(F.min(F.struct(F.col(right_pos).alias("_p"), *rc)).alias(found))
    rows = left.select(*[F.col(k).alias(f"_asof_k{i}") for i, k in enumerate(keys)], F.col(left_pos).alias(pos), F.lit(1).alias(side),
                       F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_asof_row"))
    marks = known.select(*[F.col(k).alias(f"_asof_k{i}") for i, k in enumerate(keys)], pos, F.lit(0).alias(side), found)
    both = rows.unionByName(marks, allowMissingColumns=True)
    names = [f"_asof_k{i}" for i in range(len(keys))]
    near = running_scan(both, names, [Desc(pos), side], lasts={"_asof_near": F.col(found)}).filter(F.col(side) == 1)
    reached = F.col("_asof_near._p") <= F.col(pos) + F.lit(max_offset)
    near = near.withColumn("_m", F.when(reached, F.col("_asof_near"))).select("_asof_row.*", "_m")
    return near.select(*left.columns, F.col("_m._p").alias("found_pos"), (F.col("_m._p") - F.col(left_pos)).alias("page_offset"),
                       *[F.col(f"_m.{c}").alias(c) for c in rc])


def box_union_agg(df: DataFrame, group_cols: list[str], left: str, upper: str,
                  right: str, lower: str) -> DataFrame:
    """E7 (grouped form): running min/min/max/max from (BOX_START, BOX_START, 0, 0)."""
    return df.groupBy(*group_cols).agg(
        F.least(F.lit(BOX_START), F.min(left)).alias("left"),
        F.least(F.lit(BOX_START), F.min(upper)).alias("upper"),
        F.greatest(F.lit(0.0), F.max(right)).alias("right"),
        F.greatest(F.lit(0.0), F.max(lower)).alias("lower"))


def box_union(boxes: Column) -> Column:
    """E7 (array form): union box of an ARRAY<STRUCT<left,upper,right,lower>>."""
    start = F.struct(F.lit(BOX_START).alias("left"), F.lit(BOX_START).alias("upper"),
                     F.lit(0.0).alias("right"), F.lit(0.0).alias("lower"))
    return F.aggregate(boxes, start, lambda acc, b: F.struct(
        F.least(acc["left"], b["left"]).alias("left"), F.least(acc["upper"], b["upper"]).alias("upper"),
        F.greatest(acc["right"], b["right"]).alias("right"),
        F.greatest(acc["lower"], b["lower"]).alias("lower")))


def block_words(block: Column) -> Column:
    """Words of an ALTO text block in reading order: ARRAY<STRUCT<CONTENT, box>>."""
    return F.flatten(F.transform(block["TextLine"], lambda line: F.transform(
        F.coalesce(line["String"], F.array()), lambda s: F.struct(
            s["_CONTENT"].alias("content"),
            box_corners(s["_HPOS"], s["_VPOS"], s["_WIDTH"], s["_HEIGHT"]).alias("box")))))


def block_text(words: Column) -> Column:
    """Words of a block joined by one blank, in order."""
    return F.array_join(F.transform(words, lambda w: w["content"]), " ")


def words_to_nth_colon(words: Column, n_colons) -> Column:
    """the words up to and including the n-th word holding ':'; n = 0 (or
    fewer colon words than n) keeps all words."""
    n = n_colons if isinstance(n_colons, Column) else F.lit(n_colons)
    flagged = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"),
                                                       w["content"].contains(":").alias("c")))
    colon_idx = F.transform(F.filter(flagged, lambda x: x["c"]), lambda x: x["i"])
    cut = F.when((n > 0) & (F.size(colon_idx) >= n), F.try_element_at(colon_idx, n) + F.lit(1))
    return F.when(cut.isNull(), words).otherwise(F.slice(words, 1, cut))


def speaker_box(words: Column, n_colons) -> Column:
    """Box of a speaker note: union of the word boxes up to the n-th colon word."""
    return box_union(F.transform(words_to_nth_colon(words, n_colons), lambda w: w["box"]))


def block_box(block: Column) -> Column:
    return box_corners(block["_HPOS"], block["_VPOS"], block["_WIDTH"], block["_HEIGHT"])
