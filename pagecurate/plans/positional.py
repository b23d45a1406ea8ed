"""Positional features of annotated segments (I4).

annotated segments + TEI records + ALTO layouts -> segments + posLeft/Upper/
Right/Lower (per mille of the page) + year, relative_page_number, even_page,
second_chamber, unicameral.

No table rewrite per record: records and layouts are read and cut once, every
(record, page) of the table is processed (not only the first page of each
file), layouts are looked up by hash join on (package, page index), segments
are matched to blocks inside their page (``match_blocks``), and the features
are attached by id with a left join — rows that were never matched keep NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.functions import meta
from pagecurate.functions.boxes import box_normalise
from pagecurate.functions.links import package_id, page_index_from_facs, page_stem_from_link
from pagecurate.operators.joins import update_by_id
from pagecurate.operators.layout import match_blocks, nearest_following, speaker_box
from pagecurate.session import ensure_checkpoint_dir
from pagecurate.sources.alto import explode_blocks
from pagecurate.sources.tei import explode_pages, explode_segments, record_head, record_length

# Output columns of the positional feature set.
POSITION_COLS = ["posLeft", "posUpper", "posRight", "posLower"]
RECORD_COLS = ["year", "relative_page_number", "even_page", "second_chamber", "unicameral"]


def record_segments(records: DataFrame) -> DataFrame:
    """Every seg/note segment with its record metadata."""
    rec = record_length(record_head(records))
    pages = explode_pages(rec.select("file", "value", "pkg_name", "last_page_link"),
                          tags=("seg", "note"))
    seg = explode_segments(pages)
    page_idx = page_index_from_facs("page_link")
    rec_len = F.coalesce(page_index_from_facs("last_page_link"), page_idx)
    chamber = meta.record_chamber("pkg_name")
    return seg.select(
        "id", "file", "page_ord", "page_link", "elem_ord", "elem_type", "text_line",
        package_id(page_stem_from_link("page_link")).alias("package_id"),
        page_idx.alias("page_index"),
        meta.record_year("pkg_name").alias("year"),
        meta.relative_page_number(page_idx, rec_len).alias("relative_page_number"),
        meta.even_page(page_idx).alias("even_page"),
        meta.second_chamber(chamber).alias("second_chamber"),
        meta.unicameral(chamber).alias("unicameral"))


def positional_features(annotated: DataFrame, records: DataFrame, layouts: DataFrame,
                        max_page_offset: int = 0, speaker_colons: bool | str = False) -> DataFrame:
    """I4. ``max_page_offset`` > 0 looks for the layout of the following pages
    when a page's own layout is missing (D5). ``speaker_colons`` matches with
    block texts cut at the segment's colon count and boxes the words up to that
    colon: ``True`` for every segment, ``"by_type"`` for elements whose
    ``type`` attribute is ``speaker`` (the others match whole blocks)."""
    segs = record_segments(records)
    ids = annotated.select("id").distinct()
    ensure_checkpoint_dir(annotated.sparkSession)
    # cut once: the segments and the blocks are each read several times below
    segs = segs.join(ids, "id", "left_semi").checkpoint()
    pages = layouts.select("package_id", "page_index", "page_width", "page_height")
    if max_page_offset > 0:
        located = nearest_following(segs, pages, ["package_id"], "page_index", "page_index",
                                    max_page_offset, ["page_width", "page_height"])
        located = located.withColumn("layout_index", F.col("found_pos")).checkpoint()
    else:
        located = segs.join(pages, ["package_id", "page_index"], "left") \
            .withColumn("layout_index", F.when(F.col("page_width").isNotNull(), F.col("page_index")))
    blocks = explode_blocks(layouts).withColumnRenamed("page_index", "layout_index").checkpoint()
    seg_text = located.withColumn("n_colons", F.size(F.split("text_line", ":", -1)) - 1)
    if speaker_colons == "by_type":
        is_speaker = F.coalesce(F.col("elem_type") == "speaker", F.lit(False))
    else:
        is_speaker = F.lit(bool(speaker_colons))
    seg_text = seg_text.withColumn("_speaker", is_speaker)
    usable = seg_text.filter(F.col("layout_index").isNotNull())
    keys = ["package_id", "layout_index"]
    usable = usable.withColumn("_at", F.struct("file", "page_ord", "elem_ord"))
    carry = ["_at", "n_colons", "_speaker", "page_width", "page_height"]

    def matched(speaker: bool) -> DataFrame:
        return match_blocks(usable.filter(F.col("_speaker") == speaker), blocks, keys, "id", "text_line", "elem_ord",
                            "block_id", "block_text", "block_idx", scorer="indel", seg_colons="n_colons" if speaker else None, carry=carry)

    if speaker_colons == "by_type":
        match = matched(False).unionByName(matched(True))
    else:
        match = matched(bool(speaker_colons))
    m = match.join(blocks.select("package_id", "layout_index", "block_idx", "block_box", "words"),
                   ["package_id", "layout_index", "block_idx"])
    box = F.when(F.col("_speaker"), speaker_box(F.col("words"), F.col("n_colons"))).otherwise(F.col("block_box"))
    norm = box_normalise(box, "page_width", "page_height")
    feats = m.select("id", "_at", *[norm[k].alias(c) for k, c in
                             zip(("left", "upper", "right", "lower"), POSITION_COLS)])
    # an id that occurs on several pages takes its last place
    meta_cols = segs.select("id", *RECORD_COLS, F.struct("file", "page_ord", "elem_ord").alias("_at"))
    upd = meta_cols.join(feats, ["id", "_at"], "left")
    return update_by_id(annotated, upd, key="id", order_col="_at")
