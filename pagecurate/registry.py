"""Registered queries: each library operator run over the driver's tables.

Every entry pairs a Spark query ``(spark, sf_dir) -> DataFrame`` with, where
SQL can express it, the DuckDB SQL that must give the same rows. The role each
table plays (segments, labels, logits, boxes, ...) follows the stand-in

Conventions shared by both sides: integers are BIGINT, floating results are
rounded to 6 decimals, every computed column carries an alias.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagecurate import functions as fx
from pagecurate.functions.text import WHITESPACE_RUN
from pagecurate.operators import aggregates as agg
from pagecurate.operators import filters, joins, metrics, ordering, sampling, setops
from pagecurate.operators.layout import box_union_agg, match_blocks, nearest_following
from pagecurate.plans import splits
from pagecurate.sources.tei import explode_pages, explode_segments, element_pattern

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


# ---------------------------------------------------------------- SQL pieces
WS = WHITESPACE_RUN


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(10), ''), '{WS}', ' ', 'g'))"


def unescape_sql(x: str) -> str:
    s = x
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")]:
        s = f"replace({s}, '{ent}', '{ch}')"
    return s


def hash_sql(seed, *parts) -> str:
    inner = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5('{seed}|' || {inner})"


DOC_LINES_SQL = """
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS line_no, raw FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
  FROM documents)
"""


def doc_lines(spark, sf) -> DataFrame:
    d = T(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")) \
        .withColumn("line_no", F.col("line_no").cast("bigint"))


# ---------------------------------------------------------------- B1, C1, B14
@register("normalise_text", f"""
SELECT doc_id, line_no, {norm_sql('raw')} AS text_line FROM ({DOC_LINES_SQL})
""")
def q_normalise_text(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "line_no", fx.normalise_text("raw").alias("text_line"))


@register("segments_from_documents", f"""
SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS id,
       CAST(doc_id AS VARCHAR) AS file, line_no, text_line,
       0.0::DOUBLE AS marginal_text, 0.0::DOUBLE AS merged
FROM (SELECT doc_id, line_no, {norm_sql('raw')} AS text_line FROM ({DOC_LINES_SQL}))
WHERE length(text_line) > 0
""")
def q_segments_from_documents(spark, sf):
    lines = doc_lines(spark, sf).select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("id"),
        F.col("doc_id").cast("string").alias("file"), "line_no",
        fx.normalise_text("raw").alias("text_line"),
        F.lit(0.0).alias("marginal_text"), F.lit(0.0).alias("merged"))
    return filters.keep_nonempty(lines)


# ---------------------------------------------------------------- A2, A3, F1, F8 on pages.html
HTML_TAGS = ("b", "a", "li", "h1", "div", "footer", "title", "span")
HTML_POS_TAGS = ("b", "a")
HTML_CHUNKS_SQL = """
SELECT page_id, CAST(pos - 1 AS BIGINT) AS page_ord, chunk FROM (
  SELECT page_id, unnest(string_split(html, '<p')) AS chunk,
         unnest(generate_series(1, len(string_split(html, '<p')))) AS pos
  FROM pages)
WHERE pos > 1
"""
HTML_ELEMS_SQL = f"""
SELECT page_id, page_ord, k, m,
       CASE WHEN regexp_matches(m, '^<(?:{'|'.join(HTML_POS_TAGS)})[\\s/>]') THEN 1 ELSE 0 END AS is_pos,
       CASE WHEN regexp_extract(m, '^(<[^>]*>)', 1) LIKE '%/>' THEN ''
            ELSE {norm_sql(unescape_sql("regexp_extract(m, '(?s)^<[^>]*>(.*)$', 1)"))} END AS text_line
FROM (
  SELECT page_id, page_ord, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS k FROM (
    SELECT page_id, page_ord, regexp_extract_all(chunk, '{element_pattern(HTML_TAGS)}') AS ms
    FROM ({HTML_CHUNKS_SQL})))
"""
HTML_SEGS_SQL = f"""
SELECT page_id, page_ord, text_line, k,
       CAST(coalesce(sum(is_pos) OVER (PARTITION BY page_id, page_ord ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS elem_ord
FROM ({HTML_ELEMS_SQL})
"""


def html_pages(spark, sf):
    p = T(spark, sf, "pages").select("page_id", "html")
    return explode_pages(p, text_col="html", marker="<p", link_attr=None, tags=HTML_TAGS,
                         id_attr=None, position_tags=HTML_POS_TAGS, unescape=True)


@register("explode_pages", f"""
SELECT page_id, page_ord, count(*) AS n_lines FROM ({HTML_SEGS_SQL})
WHERE length(text_line) > 0 GROUP BY page_id, page_ord
""")
def q_explode_pages(spark, sf):
    return html_pages(spark, sf).select("page_id", F.col("page_ord").cast("bigint").alias("page_ord"),
                                        F.size("lines").cast("bigint").alias("n_lines"))


@register("explode_segments", f"""
SELECT page_id, page_ord,
       CAST(row_number() OVER (PARTITION BY page_id, page_ord ORDER BY k) - 1 AS BIGINT) AS line_ord,
       text_line, elem_ord
FROM ({HTML_SEGS_SQL}) WHERE length(text_line) > 0
""")
def q_explode_segments(spark, sf):
    return explode_segments(html_pages(spark, sf)).select(
        "page_id", F.col("page_ord").cast("bigint").alias("page_ord"),
        F.col("line_ord").cast("bigint").alias("line_ord"), "text_line",
        F.col("elem_ord").cast("bigint").alias("elem_ord"))


# ---------------------------------------------------------------- B2-B8 on pages.url
URL_DIRECT = r"[?&]page=(\d{1,3})"
URL_INDEXED = r"/[a-z]{2}/(\d{3})(?:[^0-9]|$)"


def try_int_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\s*[+-]?\\d+\\s*$') THEN TRY_CAST(trim({x}) AS BIGINT) END"


@register("page_number_from_link", f"""
SELECT page_id, CAST(coalesce({try_int_sql(f"regexp_extract(url, '{URL_DIRECT}', 1)")},
                              {try_int_sql(f"regexp_extract(url, '{URL_INDEXED}', 1)")} + 1) AS BIGINT) AS page_number
FROM pages
""")
def q_page_number_from_link(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", fx.page_number_from_link("url", URL_DIRECT, URL_INDEXED)
                    .cast("bigint").alias("page_number"))


@register("page_stem_and_package", """
SELECT page_id, replace(string_split(url, '/')[-2], '.jp2', '') AS page_stem,
       regexp_replace(replace(string_split(url, '/')[3], '_', '-'), '-[^-]*$', '') AS package_id
FROM pages
""")
def q_page_stem_and_package(spark, sf):
    p = T(spark, sf, "pages")
    host = F.try_element_at(F.split("url", "/", -1), F.lit(3))
    return p.select("page_id", fx.page_stem_from_link("url").alias("page_stem"),
                    fx.package_id(host).alias("package_id"))


PKG_SQL = ("'prot-' || CAST(1850 + page_id % 30 AS VARCHAR) || "
           "CASE page_id % 3 WHEN 0 THEN '--ak--' WHEN 1 THEN '--fk--' ELSE '--' END || "
           "CAST(page_id AS VARCHAR)")


def pkg_col():
    pid = F.col("page_id")
    cham = F.when(F.pmod(pid, F.lit(3)) == 0, "--ak--").when(F.pmod(pid, F.lit(3)) == 1, "--fk--").otherwise("--")
    return F.concat(F.lit("prot-"), (F.lit(1850) + F.pmod(pid, F.lit(30))).cast("string"), cham,
                    pid.cast("string"))


def zfill_sql(x: str, w: int) -> str:
    return f"CASE WHEN length({x}) >= {w} THEN {x} ELSE lpad({x}, {w}, '0') END"


@register("layout_file_name", f"""
SELECT page_id, page_as_string,
       replace(CASE WHEN year BETWEEN 1860 AND 1869 AND len(string_split(pkg, '--')) >= 2
                    THEN split_part(pkg, '--', 1) || '--' || split_part(pkg, '--', 2) || '--' ||
                         {zfill_sql("string_split(pkg, '--')[-1]", 4)}
                    ELSE pkg END, '-', '_') || '-' || printf('%03d', page_no) || '.xml' AS layout_file
FROM (SELECT page_id, {PKG_SQL} AS pkg, 1850 + page_id % 30 AS year, CAST(page_id % 1200 AS INTEGER) AS page_no,
             {zfill_sql("CAST(page_id % 1200 AS VARCHAR)", 3)} AS page_as_string FROM pages)
""")
def q_layout_file_name(spark, sf):
    p = T(spark, sf, "pages").select("page_id", pkg_col().alias("pkg"),
                                     F.pmod("page_id", F.lit(1200)).alias("page_no"))
    return p.select("page_id", fx.page_as_string("page_no").alias("page_as_string"),
                    fx.layout_file_name("pkg", "page_no").alias("layout_file"))


@register("page_index_from_facs", f"""
SELECT page_id, CAST(coalesce({try_int_sql("right(string_split(url, '.')[-2], 3)")},
                              {try_int_sql("string_split(url, '=')[-1]")}) AS BIGINT) AS page_index
FROM pages
""")
def q_page_index_from_facs(spark, sf):
    return T(spark, sf, "pages").select("page_id", fx.page_index_from_facs("url").cast("bigint").alias("page_index"))


@register("record_meta", f"""
SELECT page_id, year, chamber,
       CAST(chamber = 'Andra kammaren' AS BIGINT) AS second_chamber,
       CAST(chamber = 'Enkammarriksdagen' AS BIGINT) AS unicameral
FROM (SELECT page_id,
             CAST(nullif(regexp_extract(pkg, '^prot-(\\d{{4}})', 1), '') AS BIGINT) AS year,
             CASE WHEN regexp_matches(pkg, '-ak-') THEN 'Andra kammaren'
                  WHEN regexp_matches(pkg, '-fk-') THEN 'Första kammaren'
                  ELSE 'Enkammarriksdagen' END AS chamber
      FROM (SELECT page_id, {PKG_SQL} AS pkg FROM pages))
""")
def q_record_meta(spark, sf):
    p = T(spark, sf, "pages").select("page_id", pkg_col().alias("pkg"))
    ch = fx.record_chamber("pkg")
    return p.select("page_id", fx.record_year("pkg").cast("bigint").alias("year"), ch.alias("chamber"),
                    fx.second_chamber(ch).cast("bigint").alias("second_chamber"),
                    fx.unicameral(ch).cast("bigint").alias("unicameral"))


@register("speaker_prefix", """
SELECT page_id, split_part(url, ':', 1) AS prefix0,
       CASE WHEN len(string_split(url, ':')) >= 2 THEN split_part(url, ':', 1) || ':' ELSE url END AS prefix1,
       CASE WHEN len(string_split(url, ':')) >= 2
            THEN string_split(url, ':')[1] || ':' || string_split(url, ':')[2] ELSE url END AS prefix2
FROM pages
""")
def q_speaker_prefix(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", *[fx.speaker_prefix("url", n).alias(f"prefix{n}") for n in range(3)])


# ---------------------------------------------------------------- B9-B13 on lineitem / orders
@register("relative_page_number", """
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS page,
       round(coalesce(l.l_linenumber / nullif(m.len, 0) * 1000, 0.0), 6) AS relative_page_number,
       CAST(CASE WHEN l.l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS even_page
FROM lineitem l JOIN (SELECT l_orderkey, max(l_linenumber) - 1 AS len FROM lineitem GROUP BY l_orderkey) m
  ON l.l_orderkey = m.l_orderkey
""")
def q_relative_page_number(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    lens = li.groupBy("l_orderkey").agg((F.max("l_linenumber") - 1).alias("len"))
    j = li.join(lens, "l_orderkey")
    return j.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("page"),
                    r6(fx.relative_page_number("l_linenumber", "len")).alias("relative_page_number"),
                    fx.even_page("l_linenumber").cast("bigint").alias("even_page"))


BOX_SQL = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
       l_quantity AS "left", l_discount * 100 AS upper,
       l_quantity + l_tax * 100 AS "right", l_discount * 100 + l_linenumber AS lower,
       l_extendedprice / 100 AS pw, l_quantity AS ph
FROM lineitem
"""


def boxes(spark, sf) -> DataFrame:
    li = T(spark, sf, "lineitem")
    b = fx.box_corners(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                     b.alias("box"), (F.col("l_extendedprice") / 100).alias("pw"), F.col("l_quantity").alias("ph"))


@register("box_corners_normalised", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round("left", 6) AS box_left, round(upper, 6) AS box_upper, round("right", 6) AS box_right,
       round(lower, 6) AS box_lower,
       round("left" / nullif(pw, 0) * 1000, 6) AS pos_left, round(upper / nullif(ph, 0) * 1000, 6) AS pos_upper,
       round("right" / nullif(pw, 0) * 1000, 6) AS pos_right, round(lower / nullif(ph, 0) * 1000, 6) AS pos_lower
FROM ({BOX_SQL})
""")
def q_box_corners_normalised(spark, sf):
    b = boxes(spark, sf)
    n = fx.box_normalise("box", "pw", "ph")
    return b.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                    r6(F.col("box.left")).alias("box_left"), r6(F.col("box.upper")).alias("box_upper"),
                    r6(F.col("box.right")).alias("box_right"), r6(F.col("box.lower")).alias("box_lower"),
                    r6(n["left"]).alias("pos_left"), r6(n["upper"]).alias("pos_upper"),
                    r6(n["right"]).alias("pos_right"), r6(n["lower"]).alias("pos_lower"))


@register("decade", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year,
       CAST(year(o_orderdate) - year(o_orderdate) % 10 AS BIGINT) AS decade
FROM orders
""")
def q_decade(spark, sf):
    o = T(spark, sf, "orders")
    y = F.year("o_orderdate")
    return o.select("o_orderkey", y.cast("bigint").alias("year"), fx.decade(y).cast("bigint").alias("decade"))


@register("distinct_decades", """
SELECT DISTINCT CAST(year(o_orderdate) - year(o_orderdate) % 10 AS BIGINT) AS decade,
       CAST(year(o_orderdate) AS BIGINT) AS year
FROM orders
""")
def q_distinct_decades(spark, sf):
    o = T(spark, sf, "orders").select(F.year("o_orderdate").alias("y"))
    return setops.distinct_values(o.select(fx.decade("y").cast("bigint").alias("decade"),
                                           F.col("y").cast("bigint").alias("year")),
                                  F.struct("decade", "year"), "s").select("s.decade", "s.year")


@register("year_window", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders
WHERE year(o_orderdate) BETWEEN 1992 AND 1997 AND NOT year(o_orderdate) BETWEEN 1990 AND 1993
""")
def q_year_window(spark, sf):
    o = filters.date_year_window(T(spark, sf, "orders"), "o_orderdate", 1992, 1997)
    return o.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))


# ---------------------------------------------------------------- labels: B15-B17, B22, C4, C5
@register("final_target", """
SELECT doc_id, CAST(coalesce(quality, 0) + coalesce(toxic, 0) AS BIGINT) AS final_target,
       CASE WHEN quality = 0 AND toxic = 0 THEN 'non-marginal'
            WHEN quality = 1 AND toxic = 0 THEN 'marginal' ELSE 'merged' END AS category,
       CASE coalesce(quality, 0) + coalesce(toxic, 0) WHEN 0 THEN 'other' WHEN 1 THEN 'marginal_text'
            WHEN 2 THEN 'merged' END AS label_name,
       0.0::DOUBLE AS init_label,
       CAST(CAST(quality AS DOUBLE) AS BIGINT) AS quality_int
FROM labels
""")
def q_final_target(spark, sf):
    lb = T(spark, sf, "labels")
    ft = fx.final_target("quality", "toxic")
    return lb.select("doc_id", ft.cast("bigint").alias("final_target"),
                     fx.segment_category("quality", "toxic").alias("category"),
                     fx.label_name(ft).alias("label_name"), F.lit(0.0).alias("init_label"),
                     fx.label_to_int(F.col("quality").cast("double")).cast("bigint").alias("quality_int"))


@register("exclude_merged", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def q_exclude_merged(spark, sf):
    lb = T(spark, sf, "labels").select("doc_id", "quality", F.col("toxic").alias("merged"))
    return filters.exclude_merged(lb).select("doc_id", "quality")


@register("valid_annotations", """
SELECT doc_id, CAST(quality + toxic AS BIGINT) AS label,
       (quality + toxic) IN (0, 1) AS accepted
FROM labels
""")
def q_valid_annotations(spark, sf):
    lb = T(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).cast("bigint").alias("label"))
    ok, bad = filters.valid_annotations(lb, "label")
    return ok.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@register("rows_with_nulls", """
SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.quality IS NULL OR l.toxic IS NULL
""")
def q_rows_with_nulls(spark, sf):
    d = T(spark, sf, "documents").select("doc_id")
    j = joins.update_by_id(d, T(spark, sf, "labels"), key="doc_id")
    out = filters.rows_with_nulls(j, ["doc_id", "quality", "toxic"])
    return out.select("doc_id", F.col("quality").cast("bigint").alias("quality"),
                      F.col("toxic").cast("bigint").alias("toxic"))


@register("update_by_id", """
SELECT d.doc_id, CAST(l.quality AS BIGINT) AS marginal_text, CAST(l.toxic AS BIGINT) AS merged
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_update_by_id(spark, sf):
    d = T(spark, sf, "documents").select("doc_id")
    upd = T(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("marginal_text"),
                                        F.col("toxic").cast("bigint").alias("merged"))
    return joins.update_by_id(d, upd, key="doc_id")


@register("drop_incomplete", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
WHERE nullif(l_discount, 0.0) IS NOT NULL AND nullif(l_tax, 0.0) IS NOT NULL AND l_quantity IS NOT NULL
""")
def q_drop_incomplete(spark, sf):
    li = T(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity",
        F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    return filters.drop_incomplete(li, ["l_quantity", "d", "t"]).select("l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- logits on embeddings: B18-B21
def emb(spark, sf, n: int | None = None) -> DataFrame:
    """The embedding vector as logits: the whole vector, or exactly ``n``
    entries where a model with ``n`` classes is meant."""
    e = T(spark, sf, "embeddings")
    v = F.col("embedding") if n is None else F.slice("embedding", 1, n)
    return e.select("vec_id", "label", F.transform(v, lambda x: x.cast("double")).alias("logits"))


EMB_ALL = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@register("argmax_class", f"""
SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS pred,
       CAST(CASE WHEN 1.0 / (1.0 + exp(-l[1])) > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS sigmoid_pred,
       round(l[1], 6) AS logits1, round(l[2], 6) AS logits2
FROM (SELECT vec_id, {EMB_ALL} AS l FROM embeddings)
""")
def q_argmax_class(spark, sf):
    e = emb(spark, sf)
    l1, l2 = fx.logit_columns("logits")
    return e.select("vec_id", fx.argmax_class("logits").cast("bigint").alias("pred"),
                    fx.sigmoid_decision(F.col("logits")[0]).cast("bigint").alias("sigmoid_pred"),
                    r6(l1).alias("logits1"), r6(l2).alias("logits2"))


UNC_SQL = f"""
SELECT vec_id, label, 1.0 - 1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS u
FROM (SELECT vec_id, label, {EMB_ALL} AS l FROM embeddings)
"""


@register("softmax_uncertainty", f"SELECT vec_id, round(u, 6) AS uncertainty FROM ({UNC_SQL})")
def q_softmax_uncertainty(spark, sf):
    return emb(spark, sf).select("vec_id", r6(fx.softmax_uncertainty("logits")).alias("uncertainty"))


@register("top_k_uncertain", f"""
SELECT vec_id, round(u, 6) AS uncertainty FROM ({UNC_SQL}) ORDER BY u DESC, vec_id LIMIT 10
""")
def q_top_k_uncertain(spark, sf):
    e = emb(spark, sf).withColumn("u", fx.softmax_uncertainty("logits"))
    return e.orderBy(F.desc("u"), "vec_id").limit(10).select("vec_id", r6("u").alias("uncertainty"))


# ---------------------------------------------------------------- sampling G3, G4, G7, H3
@register("sample_rows", f"""
SELECT vec_id FROM embeddings ORDER BY {hash_sql(42, 'vec_id')}, vec_id LIMIT 50
""")
def q_sample_rows(spark, sf):
    return sampling.sample_rows(T(spark, sf, "embeddings").select("vec_id"), "vec_id", 50, 42)


@register("sample_per_group", f"""
SELECT source, doc_id FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS rn
  FROM documents) WHERE rn <= 3
""")
def q_sample_per_group(spark, sf):
    d = T(spark, sf, "documents").select("source", "doc_id")
    return sampling.sample_per_group(d, ["source"], "doc_id", 3, 42)


@register("seeded_order", f"""
SELECT vec_id, CAST(row_number() OVER (ORDER BY {hash_sql(7, 'vec_id')}, vec_id) - 1 AS BIGINT) AS position
FROM embeddings
""")
def q_seeded_order(spark, sf):
    e = T(spark, sf, "embeddings").select("vec_id")
    return ordering.global_index(e, [sampling.hash_key(7, "vec_id"), F.col("vec_id")], "position")


DRAWS_SQL = f"""
WITH items AS (SELECT n_regionkey AS g, n_nationkey AS item,
                      row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i,
                      count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
sizes AS (SELECT DISTINCT g, n FROM items),
draws AS (SELECT g, d AS draw_no,
                 (('0x' || substr({hash_sql(42, 'g', 'd')}, 1, 8))::BIGINT) % n AS i
          FROM sizes, range(0, 5) r(d))
SELECT draws.g AS n_regionkey, CAST(draw_no AS BIGINT) AS draw_no, CAST(item AS BIGINT) AS n_nationkey
FROM draws JOIN items ON draws.g = items.g AND draws.i = items.i
"""


def nation_draws(spark, sf):
    n = T(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    return sampling.sample_with_replacement(n, "n_regionkey", "n_nationkey", 5, 42)


@register("sample_with_replacement", DRAWS_SQL)
def q_sample_with_replacement(spark, sf):
    d = nation_draws(spark, sf)
    return d.select("n_regionkey", F.col("draw_no").cast("bigint").alias("draw_no"),
                    F.col("n_nationkey").cast("bigint").alias("n_nationkey"))


@register("draw_unseen", f"""
WITH d AS ({DRAWS_SQL}),
dj AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY draw_no) AS j FROM d),
f AS (SELECT c_nationkey, c_custkey,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY {hash_sql(42, 'c_custkey')}, c_custkey) AS j
      FROM customer)
SELECT dj.n_regionkey, dj.draw_no, dj.n_nationkey, f.c_custkey
FROM dj JOIN f ON dj.n_nationkey = f.c_nationkey AND dj.j = f.j
""")
def q_draw_unseen(spark, sf):
    d = q_sample_with_replacement(spark, sf).withColumn("draw_key", F.col("draw_no"))
    files = T(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("n_nationkey"), "c_custkey")
    out = sampling.draw_unseen(d, files, "n_nationkey", "c_custkey", seed=42)
    return out.select("n_regionkey", "draw_no", "n_nationkey", "c_custkey")


# ---------------------------------------------------------------- splits: I2, E1, E3, E4, F3, E25
STRAT_SQL = """
WITH src AS (SELECT doc_id, quality, toxic FROM labels),
counts AS (SELECT quality AS cls, count(*) AS n FROM src GROUP BY quality),
t1 AS (SELECT *, sum(n) OVER () AS total FROM counts),
t2 AS (SELECT *, total - ceil(CAST(0.3 AS DOUBLE) * total) AS draws FROM t1),
t3 AS (SELECT *, CAST(n AS DOUBLE) / total * draws AS cont FROM t2),
t4 AS (SELECT *, floor(cont) AS fl FROM t3),
t5 AS (SELECT *, draws - sum(fl) OVER () AS need,
              row_number() OVER (ORDER BY cont - fl DESC, cls) AS rk FROM t4),
q1 AS (SELECT cls, n, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM t5),
r1 AS (SELECT *, n - n_train AS rest, sum(n - n_train) OVER () AS rest_total FROM q1),
r2 AS (SELECT *, rest_total - ceil(CAST(0.5 AS DOUBLE) * rest_total) AS vdraws FROM r1),
r3 AS (SELECT *, CAST(rest AS DOUBLE) / rest_total * vdraws AS cont FROM r2),
r4 AS (SELECT *, floor(cont) AS fl FROM r3),
r5 AS (SELECT *, vdraws - sum(fl) OVER () AS need,
              row_number() OVER (ORDER BY cont - fl DESC, cls) AS rk FROM r4),
quota AS (SELECT cls, n_train, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS n_val FROM r5),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY quality
             ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM src s),
split AS (SELECT ranked.doc_id, ranked.quality, ranked.toxic,
                 CASE WHEN r < n_train THEN 'train' WHEN r < n_train + n_val THEN 'val' ELSE 'test' END AS split
          FROM ranked JOIN quota ON ranked.quality IS NOT DISTINCT FROM quota.cls)
"""


def strat(spark, sf) -> DataFrame:
    return splits.stratified_split(T(spark, sf, "labels"), "quality", "doc_id", seed=42)


@register("stratified_split", STRAT_SQL + "SELECT doc_id, split FROM split")
def q_stratified_split(spark, sf):
    return strat(spark, sf).select("doc_id", "split")


@register("class_distribution", STRAT_SQL + """
SELECT split, CAST(quality AS BIGINT) AS class, count(*) AS n FROM split
WHERE quality IS NOT NULL GROUP BY split, quality
""")
def q_class_distribution(spark, sf):
    d = agg.class_distribution(strat(spark, sf), "quality", "split")
    return d.select("split", F.col("quality").cast("bigint").alias("class"), "n")


@register("class_distribution_with_nulls", """
SELECT CAST(l.quality AS BIGINT) AS class, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality
""")
def q_class_distribution_with_nulls(spark, sf):
    j = joins.update_by_id(T(spark, sf, "documents").select("doc_id"), T(spark, sf, "labels"), key="doc_id")
    d = agg.class_distribution(j, "quality", dropna=False)
    return d.select(F.col("quality").cast("bigint").alias("class"), "n")


@register("split_sizes", STRAT_SQL + """
SELECT coalesce(split, 'total') AS split, count(*) AS n,
       round(count(*) / sum(count(*)) FILTER (WHERE grouping(split) = 1) OVER (), 6) AS share
FROM split GROUP BY ROLLUP (split)
""")
def q_split_sizes(spark, sf):
    s = agg.split_sizes(strat(spark, sf), "split")
    return s.select("split", "n", r6("share").alias("share"))


@register("label_shares", STRAT_SQL + """
SELECT coalesce(split, 'total') AS split, count(*) AS n,
       CAST(coalesce(sum(toxic), 0) AS DOUBLE) AS positives,
       CAST(count(*) - coalesce(sum(toxic), 0) AS DOUBLE) AS negatives,
       round(coalesce(sum(toxic), 0) / count(*), 6) AS share
FROM split GROUP BY ROLLUP (split)
""")
def q_label_shares(spark, sf):
    s = agg.label_shares(strat(spark, sf), "toxic", "split")
    return s.select("split", "n", "positives", "negatives", r6("share").alias("share"))


@register("split_contiguous", """
SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS BIGINT) AS part FROM orders
""")
def q_split_contiguous(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey")
    return splits.split_contiguous(o, 7, ["o_orderkey"], "part")


# ---- the same operators where the order key repeats: every row once, exact sizes
REPEATED_STRAT_SQL = STRAT_SQL.replace("SELECT doc_id, quality, toxic FROM labels",
                                       "SELECT l_orderkey AS doc_id, l_returnflag AS quality, 0 AS toxic FROM lineitem")


@register("split_repeated_keys", """
SELECT part, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys
FROM (SELECT l_orderkey, CAST(ntile(7) OVER (ORDER BY l_orderkey DESC) AS BIGINT) AS part FROM lineitem) GROUP BY part
""")
def q_split_repeated_keys(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    parts = splits.split_contiguous(li, 7, [ordering.Desc("l_orderkey")], "part")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@register("renumber_repeated_keys", """
SELECT l_orderkey, min(i) AS first, max(i) AS last, count(DISTINCT i) AS n
FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS i FROM lineitem) GROUP BY l_orderkey
""")
def q_renumber_repeated_keys(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    i = ordering.global_index(li, ["l_orderkey"], "i")
    return i.groupBy("l_orderkey").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.countDistinct("i").alias("n"))


@register("batch_accuracy_repeated_keys", """
SELECT round(avg(a), 6) AS batch_accuracy FROM (
  SELECT avg(CAST(l_orderkey % 2 = l_orderkey % 3 AS INT)) AS a
  FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey) - 1) // 16 AS b FROM lineitem) GROUP BY b)
""")
def q_batch_accuracy_repeated_keys(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 2).alias("y"), (F.col("l_orderkey") % 3).alias("p"))
    return metrics.batch_accuracy(li, "y", "p", ["l_orderkey"]).select(r6("batch_accuracy").alias("batch_accuracy"))


@register("stratified_repeated_keys", REPEATED_STRAT_SQL + """
SELECT quality AS class, split, count(*) AS n FROM split GROUP BY quality, split
""")
def q_stratified_repeated_keys(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    s = splits.stratified_split(li, "l_returnflag", "l_orderkey", seed=42)
    return s.groupBy(F.col("l_returnflag").alias("class"), "split").agg(F.count(F.lit(1)).alias("n"))


@register("row_counts", """
SELECT 'part_' || CAST(part AS VARCHAR) AS part, count(*) AS n FROM
  (SELECT ntile(7) OVER (ORDER BY o_orderkey) AS part FROM orders) GROUP BY part
UNION ALL SELECT 'whole', count(*) FROM orders
""")
def q_row_counts(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey")
    parts = splits.split_contiguous(o, 7, ["o_orderkey"], "part")
    per = parts.groupBy(F.concat(F.lit("part_"), F.col("part").cast("string")).alias("part")) \
        .agg(F.count(F.lit(1)).alias("n"))
    whole = agg.row_counts({"whole": o})
    return setops.concat(per, whole)


@register("concat_parts", """
SELECT o_orderkey, o_custkey FROM orders
""")
def q_concat_parts(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = splits.split_contiguous(o, 3, ["o_orderkey"], "part")
    pieces = [parts.filter(F.col("part") == i).drop("part") for i in (1, 2, 3)]
    return setops.concat(*pieces)


@register("renumber_rows", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx FROM labels
""")
def q_renumber_rows(spark, sf):
    return ordering.global_index(T(spark, sf, "labels").select("doc_id"), ["doc_id"], "row_idx")


# ---------------------------------------------------------------- file holdout: E23, F2, D1, D2, I3
HOLD_SQL = """
WITH rows AS (SELECT o.o_orderkey, o.o_custkey AS file, c.c_nationkey AS decade
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
firsts AS (SELECT decade, file, min(o_orderkey) AS first_idx FROM rows GROUP BY decade, file),
ranked AS (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY first_idx DESC, file DESC) AS rk FROM firsts),
roles AS (SELECT decade, file, CASE WHEN rk <= 3 THEN 'test' ELSE 'val' END AS role FROM ranked WHERE rk <= 6)
"""


def holdout_src(spark, sf) -> DataFrame:
    o = T(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("file"))
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("decade"))
    return o.join(c, "file")


@register("files_by_decade", HOLD_SQL + "SELECT CAST(decade AS BIGINT) AS decade, file, first_idx FROM firsts")
def q_files_by_decade(spark, sf):
    f = agg.files_by_decade(holdout_src(spark, sf), "decade", "file", "o_orderkey")
    return f.select(F.col("decade").cast("bigint").alias("decade"), "file", "first_idx")


@register("last_n_groups", HOLD_SQL + "SELECT CAST(decade AS BIGINT) AS decade, file, role FROM roles")
def q_last_n_groups(spark, sf):
    f = agg.files_by_decade(holdout_src(spark, sf), "decade", "file", "o_orderkey")
    r = splits.holdout_roles(f, "decade", "file")
    return r.select(F.col("decade").cast("bigint").alias("decade"), "file", "role")


@register("holdout_rows", HOLD_SQL + """
SELECT o_orderkey, file FROM rows WHERE file IN (SELECT file FROM roles WHERE role = 'test')
""")
def q_holdout_rows(spark, sf):
    return splits.holdout_parts(holdout_src(spark, sf), "decade", "file", "o_orderkey")["test"] \
        .select("o_orderkey", "file")


@register("train_rows", HOLD_SQL + """
SELECT o_orderkey, file FROM rows WHERE file NOT IN (SELECT file FROM roles)
""")
def q_train_rows(spark, sf):
    return splits.holdout_parts(holdout_src(spark, sf), "decade", "file", "o_orderkey")["train"] \
        .select("o_orderkey", "file")


@register("file_holdout_split", HOLD_SQL + """
SELECT rows.o_orderkey, rows.file, coalesce(roles.role, 'train') AS role
FROM rows LEFT JOIN roles ON rows.file = roles.file
""")
def q_file_holdout_split(spark, sf):
    s = splits.file_holdout_split(holdout_src(spark, sf), "decade", "file", "o_orderkey")
    return s.select("o_orderkey", "file", "role")


# ---------------------------------------------------------------- metrics E9-E20 on labels / embeddings
@register("class_weights", """
SELECT CAST(cls AS BIGINT) AS class, n, round(sum(n) OVER () / n, 6) AS weight
FROM (SELECT coalesce(quality, 0) + coalesce(toxic, 0) AS cls, count(*) AS n FROM labels GROUP BY cls)
""")
def q_class_weights(spark, sf):
    lb = T(spark, sf, "labels").withColumn("cls", fx.final_target("quality", "toxic"))
    w = metrics.class_weights(lb, "cls")
    return w.select(F.col("cls").cast("bigint").alias("class"), "n", r6("weight").alias("weight"))


@register("pos_weight", """
SELECT round(count(*) FILTER (WHERE quality = 0) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS pos_weight
FROM labels
""")
def q_pos_weight(spark, sf):
    return metrics.pos_weight(T(spark, sf, "labels"), "quality").select(r6("pos_weight").alias("pos_weight"))


BIN_SQL = STRAT_SQL + """
, m AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS correct,
          count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
          count(*) FILTER (WHERE toxic = 1) AS pred_pos, count(*) FILTER (WHERE quality = 1) AS label_pos
   FROM split GROUP BY split)
SELECT split, round(correct / n, 6) AS accuracy, round(tp / nullif(pred_pos, 0), 6) AS precision,
       round(tp / nullif(label_pos, 0), 6) AS recall,
       round(CASE WHEN pred_pos = 0 OR label_pos = 0 THEN NULL WHEN tp = 0 THEN 0.0
             ELSE 2.0 / (1.0 / (tp / pred_pos) + 1.0 / (tp / label_pos)) END, 6) AS f1
FROM m
"""


@register("binary_metrics", BIN_SQL)
def q_binary_metrics(spark, sf):
    m = metrics.binary_metrics(strat(spark, sf), "quality", "toxic", ["split"])
    return m.select("split", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


MC_SRC = "SELECT doc_id, CAST(coalesce(quality, 0) + coalesce(toxic, 0) AS BIGINT) AS y, doc_id % 3 AS p FROM labels"
PER_CLASS_SQL = f"""
WITH src AS ({MC_SRC}),
cls AS (SELECT y AS c FROM src UNION SELECT p FROM src),
per AS (SELECT c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE y = c AND p = c) AS tp,
               count(*) FILTER (WHERE p = c) AS predicted
        FROM cls, src GROUP BY c),
pm AS (SELECT c, support, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
              coalesce(tp / nullif(support, 0), 0.0) AS recall FROM per),
pm2 AS (SELECT *, coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pm)
"""


def mc_src(spark, sf):
    lb = T(spark, sf, "labels")
    return lb.select("doc_id", fx.final_target("quality", "toxic").cast("bigint").alias("y"),
                     F.pmod("doc_id", F.lit(3)).cast("bigint").alias("p"))


@register("per_class_metrics", PER_CLASS_SQL + """
SELECT CAST(c AS BIGINT) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM pm2
""")
def q_per_class_metrics(spark, sf):
    m = metrics.per_class_metrics(mc_src(spark, sf), "y", "p")
    return m.select(F.col("class").cast("bigint").alias("class"),
                    *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("weighted_metrics", PER_CLASS_SQL + """
SELECT round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1,
       round(sum(recall * support) / sum(support), 6) AS accuracy FROM pm2
""")
def q_weighted_metrics(spark, sf):
    m = metrics.weighted_metrics(mc_src(spark, sf), "y", "p")
    return m.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@register("classification_report", PER_CLASS_SQL + """
SELECT CASE c WHEN 0 THEN 'other' WHEN 1 THEN 'marginal_text' WHEN 2 THEN 'merged' ELSE CAST(c AS VARCHAR) END AS "row",
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pm2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(recall * support) / sum(support), 6), sum(support) FROM pm2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM pm2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support) FROM pm2
""")
def q_classification_report(spark, sf):
    from pagecurate.functions.labels import ID2LABEL
    r = metrics.classification_report(mc_src(spark, sf), "y", "p", names=ID2LABEL)
    return r.select("row", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("batch_accuracy", """
SELECT round(avg(a), 6) AS batch_accuracy FROM (
  SELECT b, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS a FROM (
    SELECT quality, toxic, floor((row_number() OVER (ORDER BY doc_id) - 1) / 16) AS b FROM labels) GROUP BY b)
""")
def q_batch_accuracy(spark, sf):
    m = metrics.batch_accuracy(T(spark, sf, "labels"), "quality", "toxic", ["doc_id"], 16)
    return m.select(r6("batch_accuracy").alias("batch_accuracy"))


NLL_SQL = f"""
SELECT vec_id, label, l, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS lse
FROM (SELECT vec_id, label, {EMB_ALL} AS l FROM embeddings)
"""


@register("log_loss", f"""
SELECT round(avg(lse - l[label + 1]), 6) AS log_loss FROM ({NLL_SQL})
""")
def q_log_loss(spark, sf):
    return metrics.log_loss(emb(spark, sf), "logits", "label").select(r6("log_loss").alias("log_loss"))


@register("batch_log_loss", f"""
SELECT round(sum(m), 6) AS value FROM (
  SELECT b, avg(nll) AS m FROM (
    SELECT lse - l[label + 1] AS nll, floor((row_number() OVER (ORDER BY vec_id) - 1) / 16) AS b
    FROM ({NLL_SQL})) GROUP BY b)
""")
def q_batch_log_loss(spark, sf):
    e = emb(spark, sf)
    m = metrics.batch_mean(e, metrics.nll("logits", "label"), ["vec_id"], 16, how="sum")
    return m.select(r6("value").alias("value"))


@register("weighted_log_loss", f"""
WITH w AS (SELECT label, sum(count(*)) OVER () / count(*) AS weight FROM embeddings GROUP BY label)
SELECT round(sum(weight * (lse - l[n.label + 1])) / sum(weight), 6) AS log_loss
FROM ({NLL_SQL}) n JOIN w ON n.label = w.label
""")
def q_weighted_log_loss(spark, sf):
    e = metrics.with_class_weights(emb(spark, sf), "label", "weight")
    return metrics.weighted_log_loss(e, "logits", "label", "weight").select(r6("log_loss").alias("log_loss"))


@register("smoothed_log_loss", """
WITH s AS (SELECT label AS y, l, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS lse,
                  list_transform(range(0, 64), lambda c: 1.0 + c % 3) AS w
           FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings))
SELECT round(sum(0.8 * w[y + 1] * (lse - l[y + 1])
                 + 0.2 / 64 * list_sum(list_transform(range(1, 65), lambda c: w[c] * (lse - l[c]))))
             / sum(w[y + 1]), 6) AS log_loss
FROM s
""")
def q_smoothed_log_loss(spark, sf):
    # the whole vector: 64 classes, weights 1, 2, 3 in turn
    m = metrics.smoothed_log_loss(emb(spark, sf), "logits", "label", [1.0 + c % 3 for c in range(64)], 0.2)
    return m.select(r6("log_loss").alias("log_loss"))


@register("binary_logit_loss", """
SELECT round(avg(y * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) + (1 - y) * (greatest(z, 0) + ln(1 + exp(-abs(z))))), 6)
       AS log_loss
FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS z, CAST(label % 2 AS DOUBLE) AS y FROM embeddings)
""")
def q_binary_logit_loss(spark, sf):
    # every entry of the vector is a logit
    e = T(spark, sf, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("z"),
                                          F.pmod("label", F.lit(2)).alias("y"))
    return metrics.binary_logit_loss(e, "z", "y").select(r6("log_loss").alias("log_loss"))


# ---------------------------------------------------------------- profile aggregates on boxes
@register("null_count", """
SELECT l_returnflag AS split, count(*) FILTER (WHERE nullif(l_discount, 0.0) IS NULL OR nullif(l_tax, 0.0) IS NULL)
       AS null_rows
FROM lineitem GROUP BY l_returnflag
""")
def q_null_count(spark, sf):
    li = T(spark, sf, "lineitem").select(F.col("l_returnflag").alias("split"),
                                         F.nullif("l_discount", F.lit(0.0)).alias("a"),
                                         F.nullif("l_tax", F.lit(0.0)).alias("b"))
    return agg.null_count(li, ["a", "b"], "split")


@register("extent", f"""
SELECT l_returnflag, round(min("left"), 6) AS min_left, round(min(upper), 6) AS min_upper,
       round(max("right"), 6) AS max_right, round(max(lower), 6) AS max_lower
FROM ({BOX_SQL}) GROUP BY l_returnflag
""")
def q_extent(spark, sf):
    b = boxes(spark, sf).select("l_returnflag", "box.*")
    e = agg.extent(b, "left", "upper", "right", "lower", ["l_returnflag"])
    return e.select("l_returnflag", *[r6(c).alias(c) for c in ("min_left", "min_upper", "max_right", "max_lower")])


@register("box_union", f"""
SELECT l_orderkey, round(least(9999.0, min("left")), 6) AS "left", round(least(9999.0, min(upper)), 6) AS upper,
       round(greatest(0.0, max("right")), 6) AS "right", round(greatest(0.0, max(lower)), 6) AS lower
FROM ({BOX_SQL}) GROUP BY l_orderkey
""")
def q_box_union(spark, sf):
    b = boxes(spark, sf).select("l_orderkey", "box.*")
    u = box_union_agg(b, ["l_orderkey"], "left", "upper", "right", "lower")
    return u.select("l_orderkey", *[r6(c).alias(c) for c in ("left", "upper", "right", "lower")])


@register("position_histogram", f"""
SELECT l_linestatus AS category, CAST(floor(("left" / nullif(pw, 0) * 1000) / 50) AS BIGINT) AS x_bin,
       CAST(floor((upper / nullif(ph, 0) * 1000) / 50) AS BIGINT) AS y_bin, count(*) AS n
FROM ({BOX_SQL}) GROUP BY ALL
""")
def q_position_histogram(spark, sf):
    b = boxes(spark, sf)
    n = fx.box_normalise("box", "pw", "ph")
    pos = b.select(F.col("l_linestatus").alias("category"), n["left"].alias("x"), n["upper"].alias("y"))
    h = agg.position_histogram(pos, "category", "x", "y", 50.0)
    return h.select("category", F.col("x_bin").cast("bigint").alias("x_bin"),
                    F.col("y_bin").cast("bigint").alias("y_bin"), "n")


@register("standardise", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
                  stddev_pop(l_discount) AS sd FROM lineitem WHERE l_returnflag = 'N')
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round((l_quantity - mq) / CASE WHEN sq = 0 OR sq IS NULL THEN 1.0 ELSE sq END, 6) AS quantity_z,
       round((l_discount - md) / CASE WHEN sd = 0 OR sd IS NULL THEN 1.0 ELSE sd END, 6) AS discount_z
FROM lineitem, s
""")
def q_standardise(spark, sf):
    from pagecurate.plans.features import standardise
    li = T(spark, sf, "lineitem")
    z = standardise(li, ["l_quantity", "l_discount"], fit_on=F.col("l_returnflag") == "N")
    return z.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                    r6("l_quantity").alias("quantity_z"), r6("l_discount").alias("discount_z"))


# ---------------------------------------------------------------- ordered scans: F4, F5, F6
@register("record_positions", """
SELECT event_id,
       round(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 6) AS last_view_value,
       last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_event
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_record_positions(spark, sf):
    ev = T(spark, sf, "events")
    s = ordering.running_scan(ev, ["user_id"], ["ts", "event_id"],
                              lasts={"last_view_value": F.when(F.col("event_type") == "view", F.col("value"))})
    last = ev.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return s.join(last, "user_id").select("event_id", r6("last_view_value").alias("last_view_value"), "last_event")


@register("colon_cut", """
SELECT event_id FROM (
  SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM events) WHERE before < 2
""")
def q_colon_cut(spark, sf):
    ev = T(spark, sf, "events")
    s = ordering.running_scan(ev, ["user_id"], ["ts", "event_id"],
                              sums={"before": (F.col("event_type") == "error").cast("int")}, inclusive=False)
    return s.filter(F.col("before") < 2).select("event_id")


def greedy_pairs_sql(table_sql: str) -> str:
    """Walk the distinct (file, link) pairs in order of their first row; keep a
    pair when neither its file nor its link has been kept."""
    return f"""
WITH RECURSIVE p AS ({table_sql}),
d AS (SELECT file, link, min(row_id) AS row_id FROM p GROUP BY file, link),
n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS i FROM d),
w AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS files, CAST([] AS VARCHAR[]) AS links, CAST(NULL AS BIGINT) AS row_id
  UNION ALL
  SELECT n.i, CASE WHEN k THEN list_append(files, n.file) ELSE files END, CASE WHEN k THEN list_append(links, n.link) ELSE links END,
         CASE WHEN k THEN n.row_id END
  FROM (SELECT n.*, w.files, w.links, NOT (list_contains(w.files, n.file) OR list_contains(w.links, n.link)) AS k
        FROM w JOIN n ON n.i = w.i + 1) n)
SELECT d.file, d.link, d.row_id FROM w JOIN d ON d.row_id = w.row_id
"""


@register("first_distinct_pairs", greedy_pairs_sql(
    "SELECT page_id AS row_id, split_part(url, '/', 4) AS file, split_part(url, '/', 3) AS link FROM pages"))
def q_first_distinct_pairs(spark, sf):
    p = T(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.split_part("url", F.lit("/"), F.lit(4)).alias("file"),
                                     F.split_part("url", F.lit("/"), F.lit(3)).alias("link"))
    return setops.first_distinct_pairs(p, "file", "link", "row_id")


@register("first_distinct_pairs_events", greedy_pairs_sql(
    "SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS file, event_type || CAST(user_id % 7 AS VARCHAR) AS link FROM events"))
def q_first_distinct_pairs_events(spark, sf):
    # many pairs share a file or a link, so later pairs fill in for skipped ones
    e = T(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("file"),
                                      F.concat("event_type", F.pmod("user_id", F.lit(7)).cast("string")).alias("link"))
    return setops.first_distinct_pairs(e, "file", "link", "row_id")


# ---------------------------------------------------------------- D4/G1, D5 on conversations / pages
CONV_SQL = """
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS txt FROM conversations),
seg AS (SELECT conv_id, turn AS sid, turn AS so, txt AS st FROM t WHERE role = 'user'),
blk AS (SELECT conv_id, turn AS bi, txt AS bt FROM t WHERE role <> 'user'),
sc AS (SELECT seg.conv_id, sid, bi, -levenshtein(st, bt) AS score, abs(bi - so) AS dist
       FROM seg JOIN blk ON seg.conv_id = blk.conv_id)
SELECT conv_id, sid AS turn, bi AS block_turn, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, sid ORDER BY score DESC, dist, bi) AS rn FROM sc)
WHERE rn = 1
"""


def conv_parts(spark, sf):
    c = T(spark, sf, "conversations").select(
        "conv_id", "turn", "role",
        # whole turns; non-ASCII characters become '?' (one character each), so a
        # byte-based and a character-based edit distance agree
        F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("txt"))
    seg = c.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("sid"),
                                                  F.col("turn").alias("so"), F.col("txt").alias("st"))
    blk = c.filter(F.col("role") != "user").select("conv_id", F.col("turn").alias("bi"),
                                                  F.col("turn").alias("bid"), F.col("txt").alias("bt"))
    return seg, blk


def indel_ctes(pairs: str) -> str:
    """SQL tables for the Indel ratio of the texts ``st`` and ``bt`` of ``pairs``: the
    longest common subsequence by its ends. ``ends[k]`` is the least end in bt of a
    common subsequence of length k; each character of st moves every end to the next
    place of that character after the end before it. Result: ``il(st, bt, n)``."""
    return f"""
ip AS (SELECT DISTINCT st, bt FROM {pairs} WHERE length(st) > 0 AND length(bt) > 0),
ic AS (SELECT bt, c, list(i ORDER BY i) AS m FROM (
  SELECT bt, unnest(string_split(bt, '')) AS c, unnest(range(1, length(bt) + 1)) AS i FROM (SELECT DISTINCT bt FROM ip)) GROUP BY bt, c),
inx AS (SELECT bt, c, flatten(list_transform(range(1, len(m) + 1), lambda j:
  list_resize([]::INTEGER[], m[j] - coalesce(m[j - 1], 0), m[j]::INTEGER))) AS nx FROM ic),
iw AS (SELECT st, bt, list(nx ORDER BY i) AS steps FROM (
  SELECT st, bt, unnest(string_split(st, '')) AS c, unnest(range(1, length(st) + 1)) AS i FROM ip) JOIN inx USING (bt, c) GROUP BY st, bt),
il AS (SELECT st, bt, len(list_reduce(steps, lambda ends, nx: list_filter(list_transform(range(1, len(ends) + 2), lambda k:
  least(coalesce(ends[k], {_NO_END}), coalesce(nx[coalesce(ends[k - 1], 0) + 1], {_NO_END}))::INTEGER), lambda e: e < {_NO_END}), []::INTEGER[])) AS n FROM iw)"""


_NO_END = 2147483647
INDEL_SCORE_SQL = """CASE WHEN length(st) + length(bt) = 0 THEN 100.0 ELSE round_even(100.0 * (1.0 -
  (length(st) + length(bt) - 2 * coalesce(n, 0))::DOUBLE / (length(st) + length(bt))), 0) END"""


@register("match_blocks", CONV_SQL)
def q_match_blocks(spark, sf):
    seg, blk = conv_parts(spark, sf)
    m = match_blocks(seg, blk, ["conv_id"], "sid", "st", "so", "bid", "bt", "bi", scorer="levenshtein")
    return m.select("conv_id", F.col("sid").alias("turn"), F.col("bi").alias("block_turn"), "score")


@register("match_blocks_indel", f"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS txt FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS bi, a.txt AS st, b.txt AS bt
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role <> 'user'),
{indel_ctes('p')}
SELECT conv_id, turn, bi AS block_turn, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, abs(bi - turn), bi) AS rn
  FROM (SELECT p.*, {INDEL_SCORE_SQL} AS score FROM p LEFT JOIN il USING (st, bt)))
WHERE rn = 1
""")
def q_match_blocks_indel(spark, sf):
    seg, blk = conv_parts(spark, sf)
    m = match_blocks(seg, blk, ["conv_id"], "sid", "st", "so", "bid", "bt", "bi", scorer="indel")
    return m.select("conv_id", F.col("sid").alias("turn"), F.col("bi").alias("block_turn"), "score")


@register("nearest_following_page", """
SELECT p.page_id, min(l.doc_id) AS found_pos, min(l.doc_id) - p.page_id AS page_offset
FROM pages p LEFT JOIN labels l ON l.doc_id BETWEEN p.page_id AND p.page_id + 10
GROUP BY p.page_id
""")
def q_nearest_following_page(spark, sf):
    p = T(spark, sf, "pages").select("page_id")
    lb = T(spark, sf, "labels").select("doc_id")
    return nearest_following(p, lb, [], "page_id", "doc_id", 10)


@register("nearest_following_repeated", """
SELECT k.g, k.page_id, (SELECT min(l.doc_id) FROM labels l WHERE l.doc_id % 3 = k.g AND l.doc_id BETWEEN k.page_id AND k.page_id + 4) AS found_pos
FROM (SELECT page_id % 3 AS g, page_id FROM pages UNION ALL SELECT page_id % 3, page_id FROM pages UNION ALL SELECT NULL, page_id FROM pages) k
""")
def q_nearest_following_repeated(spark, sf):
    """Ids that repeat or are NULL, several right rows of one position, keys in groups."""
    p = T(spark, sf, "pages").select((F.col("page_id") % 3).alias("g"), "page_id")
    left = p.unionAll(p).unionAll(p.select(F.lit(None).cast("bigint").alias("g"), "page_id"))
    lb = T(spark, sf, "labels").select((F.col("doc_id") % 3).alias("g"), "doc_id")
    return nearest_following(left, lb.unionAll(lb), ["g"], "page_id", "doc_id", 4).drop("page_offset")


# ---------------------------------------------------------------- J1 vocabulary / encoding on documents
TOKEN_RE = r"[^\p{L}\p{N}]+"


@register("vocabulary", f"""
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS token_id FROM (
  SELECT token, count(*) AS n FROM (
    SELECT unnest(regexp_split_to_array(lower(text), '{TOKEN_RE}')) AS token FROM documents)
  WHERE token <> '' GROUP BY token)
""")
def q_vocabulary(spark, sf):
    from pagecurate.plans.features import build_vocabulary
    return build_vocabulary(T(spark, sf, "documents"), "text").select("token", "n", "token_id")


@register("encode_text", f"""
WITH tok AS (SELECT doc_id, unnest(tl) AS token, unnest(generate_series(1, len(tl))) AS pos FROM (
               SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{TOKEN_RE}'), lambda x: x <> '') AS tl
               FROM documents)),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS token_id FROM (
            SELECT token, count(*) AS n FROM tok GROUP BY token)),
ids AS (SELECT doc_id, list(token_id ORDER BY pos) AS l FROM tok JOIN vocab USING (token) GROUP BY doc_id),
enc AS (SELECT d.doc_id, [2] || coalesce(ids.l, [])[1:126] || [3] AS body FROM documents d LEFT JOIN ids USING (doc_id))
SELECT doc_id, array_to_string(body || list_transform(range(128 - len(body)), lambda x: 0), ' ') AS input_ids,
       CAST(len(body) AS BIGINT) AS mask_len
FROM enc
""")
def q_encode_text(spark, sf):
    from pagecurate.plans.features import build_vocabulary, encode_text
    d = T(spark, sf, "documents").select("doc_id", "text")
    vocab = build_vocabulary(d, "text")
    enc = encode_text(d, "doc_id", "text", vocab, max_len=128)
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_len"))


@register("encode_text_fixed_vocab", f"""
WITH tok AS (SELECT doc_id, unnest(tl) AS token, unnest(generate_series(1, len(tl))) AS pos FROM (
               SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{TOKEN_RE}'), lambda x: x <> '') AS tl
               FROM documents)),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS token_id FROM (
            SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 5000)),
ids AS (SELECT doc_id, list(coalesce(token_id, 1) ORDER BY pos) AS l FROM tok LEFT JOIN vocab USING (token)
        WHERE pos <= 126 GROUP BY doc_id),
enc AS (SELECT d.doc_id, [2] || coalesce(ids.l, []) || [3] AS body FROM documents d LEFT JOIN ids USING (doc_id))
SELECT doc_id, array_to_string(body || list_transform(range(128 - len(body)), lambda x: 0), ' ') AS input_ids,
       CAST(len(body) AS BIGINT) AS mask_len
FROM enc
""")
def q_encode_text_fixed_vocab(spark, sf):
    from pagecurate.plans.features import build_vocabulary, encode_text
    d = T(spark, sf, "documents").select("doc_id", "text")
    vocab = build_vocabulary(d, "text", max_size=5000)
    enc = encode_text(d, "doc_id", "text", vocab, max_len=128)
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_len"))


# ---------------------------------------------------------------- active learning: G2, G3, D8, H4, H5, I6
def al_round(pool: DataFrame, annotations: DataFrame, seed: int):
    from pagecurate.plans.active import select_batch
    picked = select_batch(pool, "vec_id", "logits", pool_size=50, batch=10, seed=seed)
    got = joins.apply_annotations(picked, annotations, key="vec_id", label_col="label")
    return got, setops.pool_minus(pool, picked, key="vec_id")


AL_SQL = f"""
WITH pool0 AS (SELECT vec_id, label, {EMB_ALL} AS l FROM embeddings),
s1 AS (SELECT * FROM pool0 ORDER BY {hash_sql(1, 'vec_id')}, vec_id LIMIT 50),
u1 AS (SELECT vec_id, 1.0 - 1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS u FROM s1),
a1 AS (SELECT vec_id FROM u1 ORDER BY u DESC, vec_id LIMIT 10),
pool1 AS (SELECT * FROM pool0 WHERE vec_id NOT IN (SELECT vec_id FROM a1)),
s2 AS (SELECT * FROM pool1 ORDER BY {hash_sql(2, 'vec_id')}, vec_id LIMIT 50),
u2 AS (SELECT vec_id, 1.0 - 1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS u FROM s2),
a2 AS (SELECT vec_id FROM u2 ORDER BY u DESC, vec_id LIMIT 10)
"""


def al_two_rounds(spark, sf):
    e = emb(spark, sf)
    ann = e.select("vec_id", "label")
    pool = e.select("vec_id", "logits")
    got1, pool1 = al_round(pool, ann, 1)
    got2, pool2 = al_round(pool1, ann, 2)
    return got1, got2, pool2


@register("apply_annotations", AL_SQL + """
SELECT a1.vec_id, CAST(e.label AS BIGINT) AS label FROM a1 JOIN embeddings e ON a1.vec_id = e.vec_id
""")
def q_apply_annotations(spark, sf):
    got1, _, _ = al_two_rounds(spark, sf)
    return got1.select("vec_id", F.col("label").cast("bigint").alias("label"))


@register("labelled_union", AL_SQL + """
SELECT a.vec_id, CAST(e.label AS BIGINT) AS label, CAST(a.round AS BIGINT) AS round FROM
  (SELECT vec_id, 1 AS round FROM a1 UNION ALL SELECT vec_id, 2 FROM a2) a JOIN embeddings e ON a.vec_id = e.vec_id
""")
def q_labelled_union(spark, sf):
    got1, got2, _ = al_two_rounds(spark, sf)
    u = setops.labelled_union(got1.withColumn("round", F.lit(1).cast("bigint")),
                              got2.withColumn("round", F.lit(2).cast("bigint")))
    return u.select("vec_id", F.col("label").cast("bigint").alias("label"), "round")


@register("pool_minus", AL_SQL + """
SELECT vec_id FROM pool1 WHERE vec_id NOT IN (SELECT vec_id FROM a2)
""")
def q_pool_minus(spark, sf):
    _, _, pool2 = al_two_rounds(spark, sf)
    return pool2.select("vec_id")


# ---------------------------------------------------------------- learning J2-J9, I6, I7, A10 (rows-only)
def labelled_docs(spark, sf, target="quality") -> DataFrame:
    d = T(spark, sf, "documents").select("doc_id", "text", "n_chars", "lang")
    lb = T(spark, sf, "labels").select("doc_id", F.col("quality").alias("marginal_text"),
                                       F.col("toxic").alias("merged"))
    j = d.join(lb, "doc_id")
    tcol = {"quality": "marginal_text", "toxic": "merged"}.get(target, target)
    return splits.stratified_split(j, tcol, "doc_id", seed=42)


@register("text_classifier")
def q_text_classifier(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf)
    model = learn.fit_text_classifier(data.filter(F.col("split") == "train"), "text", "marginal_text")
    return learn.predictions(model, data, ["doc_id", "split", "marginal_text"])


@register("weighted_text_classifier")
def q_weighted_text_classifier(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf)
    model = learn.fit_text_classifier(data.filter(F.col("split") == "train"), "text", "marginal_text",
                                      weighted=True, reg=0.01)
    return learn.predictions(model, data, ["doc_id", "split", "marginal_text"])


@register("merged_classifier")
def q_merged_classifier(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf, target="toxic")
    model = learn.fit_text_classifier(data.filter(F.col("split") == "train"), "text", "merged",
                                      weighted=True, reg=0.01)
    return learn.predictions(model, data, ["doc_id", "split", "merged"])


@register("multiclass_classifier")
def q_multiclass_classifier(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf).withColumn("final_target", fx.final_target("marginal_text", "merged"))
    model = learn.fit_text_classifier(data.filter(F.col("split") == "train"), "text", "final_target",
                                      family="multinomial", fixed_weights={0: 1.0, 1: 2.0, 2: 5.0})
    return learn.predictions(model, data, ["doc_id", "split", "final_target"], n_logits=3)


POS_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "ship_year"]
POS_FLAGS = ["flag_a", "status_f", "even_line"]


def positional_rows(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", *POS_NUMERIC[:5],
        F.year("l_shipdate").cast("double").alias("ship_year"),
        (F.col("l_returnflag") == "A").alias("flag_a"), (F.col("l_linestatus") == "F").alias("status_f"),
        fx.even_page("l_linenumber").alias("even_line"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.when(F.year("l_shipdate") < 1997, "train").otherwise("test").alias("split"))


@register("positional_classifier")
def q_positional_classifier(spark, sf):
    from pagecurate.plans import learn
    rows = filters.drop_incomplete(positional_rows(spark, sf), POS_NUMERIC)
    feats = learn.positional_features(rows, POS_NUMERIC, POS_FLAGS, fit_on=F.col("split") == "train")
    net = learn.fit_positional_classifier(feats.filter(F.col("split") == "train"), "label")
    return learn.positional_predictions(net, feats, ["l_orderkey", "l_partkey", "split", "label"])


# a network with fixed weights: its logit is 1 * quantity - 8 * line number + 2 * returned - 0.5
FIXED_NET_SQL = """
WITH z AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_returnflag = 'R' AS BIGINT) AS y,
                  CAST(l_quantity AS DOUBLE) AS h1, 4.0 * l_linenumber - CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END + 0.25 AS h2
           FROM lineitem),
s AS (SELECT *, h1 - 2.0 * h2 AS z FROM z)
"""


def fixed_net_rows(spark, sf):
    """Rows of lineitem with their inputs and the network, saved and loaded again."""
    import numpy as np
    from pagecurate.plans import network
    from pagecurate.session import scratch_dir
    li = T(spark, sf, "lineitem")
    rows = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"),
                             (F.col("l_linestatus") == "F").cast("double")).alias("x"))
    first = [1.0, 0.0, 0.0, 4.0, 0.0, -1.0, 0.0, 0.25]       # three inputs, two units, their biases
    net = network.Network([3, 2, 1], np.array(first + [1.0, -2.0, 0.0]))
    path = network.save_network(net, spark, scratch_dir(spark, "net"))
    return rows, network.load_network(spark, path)


@register("evaluate_saved_network", FIXED_NET_SQL + """,
per AS (SELECT c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE (z > 0) = (c = 1)) AS predicted,
               count(*) FILTER (WHERE y = c AND (z > 0) = (c = 1)) AS tp FROM s, (SELECT unnest([0, 1]) AS c) GROUP BY c),
pm AS (SELECT c, support, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall FROM per),
pm2 AS (SELECT *, coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pm)
SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1, round(sum(recall * support) / sum(support), 6) AS accuracy,
       (SELECT round(avg(CASE WHEN y = 1 THEN 3.0 * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) ELSE greatest(z, 0) + ln(1 + exp(-abs(z))) END), 6)
        FROM s) AS log_loss
FROM pm2
""")
def q_evaluate_saved_network(spark, sf):
    """I7 on a network with known weights: load, score, weighted metrics, E20."""
    from pagecurate.plans import network
    rows, net = fixed_net_rows(spark, sf)
    scored = network.with_logit(rows, net, "x").select("y", "logits", (F.col("logits") > 0).cast("int").alias("p"))
    m = metrics.weighted_metrics(scored, "y", "p")
    loss = metrics.binary_logit_loss(scored, "logits", "y", pos_weight=3.0)
    return m.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")],
                    r6(loss.select("log_loss").scalar()).alias("log_loss"))


@register("hidden_vector", FIXED_NET_SQL + """
SELECT l_orderkey, l_linenumber, h1, CAST(h2 AS DOUBLE) AS h2 FROM s
""")
def q_hidden_vector(spark, sf):
    """The activations that the combined model gets from the positional network."""
    from pyspark.ml.functions import vector_to_array
    from pagecurate.plans import network
    rows, net = fixed_net_rows(spark, sf)
    h = vector_to_array("_hidden")
    return network.with_hidden(rows, net, "x").select("l_orderkey", "l_linenumber", h[0].alias("h1"), h[1].alias("h2"))


@register("combined_classifier")
def q_combined_classifier(spark, sf):
    from pagecurate.plans import learn
    # read several times below: the split and the hidden vectors are made once
    data = learn.kept(labelled_docs(spark, sf), "labelled")
    pos = data.select("doc_id", "split", F.col("n_chars").cast("double").alias("n_chars"),
                      F.size(F.split("text", "\n", -1)).cast("double").alias("n_lines"),
                      (F.col("lang") == "en").alias("is_en"))
    pos = learn.positional_features(pos, ["n_chars", "n_lines"], ["is_en"], fit_on=F.col("split") == "train")
    train = F.col("split") == "train"
    net = learn.fit_positional_classifier(pos.join(data.select("doc_id", "marginal_text"), "doc_id").filter(train),
                                          "marginal_text", n_inputs=3)
    both = learn.kept(learn.combined_features(data, pos, net, "doc_id"), "combined")
    model = learn.fit_combined_classifier(both.filter(train), "text", "marginal_text")
    return learn.predictions(model, both, ["doc_id", "split", "marginal_text"])


@register("model_selection")
def q_model_selection(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf)
    _, table = learn.choose_model(data.filter(F.col("split") == "train"), data.filter(F.col("split") == "val"),
                                  "text", "marginal_text")
    return table


@register("evaluate_saved_model")
def q_evaluate_saved_model(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf)
    model = learn.fit_text_classifier(data.filter(F.col("split") == "train"), "text", "marginal_text",
                                      weighted=True)
    path = learn.save_model(model, "weighted_text_classifier")
    loaded = learn.load_model(path)
    preds = learn.predictions(loaded, data.filter(F.col("split") == "test"), ["doc_id", "marginal_text"])
    return metrics.weighted_metrics(preds, "marginal_text", "preds")


def al_rounds_sql(rounds: int) -> str:
    """CTE ``picks`` (vec_id, round): every round draws 50 of what is left and picks 10."""
    u = "1.0 - 1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l))))"
    parts, picks = [f"p0 AS (SELECT vec_id, {EMB_ALL} AS l FROM embeddings)"], []
    for r in range(1, rounds + 1):
        parts += [f"s{r} AS (SELECT * FROM p{r - 1} ORDER BY {hash_sql(41 + r, 'vec_id')}, vec_id LIMIT 50)",
                  f"u{r} AS (SELECT vec_id, {u} AS u FROM s{r})",
                  f"a{r} AS (SELECT vec_id FROM u{r} ORDER BY u DESC, vec_id LIMIT 10)",
                  f"p{r} AS (SELECT * FROM p{r - 1} WHERE vec_id NOT IN (SELECT vec_id FROM a{r}))"]
        picks.append(f"SELECT vec_id, {r} AS round FROM a{r}")
    return f"WITH {', '.join(parts)}, picks AS ({' UNION ALL '.join(picks)})"


@register("active_learning", al_rounds_sql(5) + """
SELECT e.vec_id, CAST(e.label % 2 AS BIGINT) AS label, CAST(a.round AS BIGINT) AS round
FROM picks a JOIN embeddings e ON e.vec_id = a.vec_id
""")
def q_active_learning(spark, sf):
    from pagecurate.plans.active import active_learning
    e = emb(spark, sf)
    # labels 0/1 for every row: each pick is accepted
    done = active_learning(e.select("vec_id", "logits"), e.select("vec_id", F.pmod("label", F.lit(2)).alias("label")),
                           id_col="vec_id", rounds=5)
    return done.labelled.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("round").cast("bigint").alias("round"))


@register("active_learning_states", al_rounds_sql(5) + """
SELECT e.vec_id, CAST(coalesce(a.round, 0) AS BIGINT) AS round,
       CASE WHEN a.round IS NULL THEN 'pool' WHEN e.label IN (0, 1) THEN 'labelled' ELSE 'rejected' END AS state
FROM embeddings e LEFT JOIN picks a ON e.vec_id = a.vec_id
""")
def q_active_learning_states(spark, sf):
    from pagecurate.plans.active import active_learning
    e = emb(spark, sf)
    # the raw labels 0..9: picks with another label than 0/1 are rejected
    done = active_learning(e.select("vec_id", "logits"), e.select("vec_id", "label"), id_col="vec_id", rounds=5)
    states = [(done.labelled, "labelled"), (done.rejected, "rejected"), (done.pool.withColumn("round", F.lit(0)), "pool")]
    return setops.concat(*[t.select("vec_id", F.col("round").cast("bigint").alias("round"), F.lit(s).alias("state")) for t, s in states])


# ---- checks of the fitted models (J2-J7, A10): every row is predicted, the
# predicted class is the argmax of the logits, splits have their exact sizes
def prediction_check(preds: DataFrame, label_col: str, n_logits: int) -> DataFrame:
    logits = F.array(*[F.col(f"logits{i + 1}") for i in range(n_logits)])
    off = F.col("preds") != fx.argmax_class(logits)
    return preds.groupBy("split", F.col(label_col).cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"),
        F.count_if(off | F.col("preds").isNull()).alias("not_argmax"),
        F.count_if(F.exists(logits, lambda x: x.isNull() | F.isnan(x))).alias("no_logits"))


def prediction_check_sql(stratum: str, label: str) -> str:
    src = STRAT_SQL.replace("SELECT doc_id, quality, toxic FROM labels",
                            f"SELECT l.doc_id, l.{stratum} AS quality, l.quality AS q, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
    return src + f"""
SELECT s.split, CAST({label} AS BIGINT) AS label, count(*) AS n, count(DISTINCT s.doc_id) AS docs, 0 AS not_argmax, 0 AS no_logits
FROM split s JOIN labels l ON s.doc_id = l.doc_id GROUP BY ALL
"""


@register("text_classifier_check", prediction_check_sql("quality", "l.quality"))
def q_text_classifier_check(spark, sf):
    return prediction_check(q_text_classifier(spark, sf), "marginal_text", 2)


@register("weighted_text_classifier_check", prediction_check_sql("quality", "l.quality"))
def q_weighted_text_classifier_check(spark, sf):
    return prediction_check(q_weighted_text_classifier(spark, sf), "marginal_text", 2)


@register("merged_classifier_check", prediction_check_sql("toxic", "l.toxic"))
def q_merged_classifier_check(spark, sf):
    return prediction_check(q_merged_classifier(spark, sf), "merged", 2)


@register("multiclass_classifier_check", prediction_check_sql("quality", "coalesce(l.quality, 0) + coalesce(l.toxic, 0)"))
def q_multiclass_classifier_check(spark, sf):
    return prediction_check(q_multiclass_classifier(spark, sf), "final_target", 3)


@register("combined_classifier_check", prediction_check_sql("quality", "l.quality"))
def q_combined_classifier_check(spark, sf):
    return prediction_check(q_combined_classifier(spark, sf), "marginal_text", 2)


@register("positional_classifier_check", """
SELECT CASE WHEN year(l_shipdate) < 1997 THEN 'train' ELSE 'test' END AS split, CAST(l_returnflag = 'R' AS BIGINT) AS label,
       count(*) AS n, 0 AS off
FROM lineitem GROUP BY ALL
""")
def q_positional_classifier_check(spark, sf):
    off = (F.col("preds") != (F.col("logits") > 0).cast("int")) | F.col("logits").isNull()
    return q_positional_classifier(spark, sf).groupBy("split", F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))


@register("saved_model_check", """
SELECT count(*) AS n, 0 AS differing FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")
def q_saved_model_check(spark, sf):
    from pagecurate.plans import learn
    data = labelled_docs(spark, sf)
    model = learn.fit_text_classifier(data.filter(F.col("split") == "train"), "text", "marginal_text", weighted=True)
    loaded = learn.load_model(learn.save_model(model, "check"))
    a, b = (learn.predictions(m, data, ["doc_id"]).select("doc_id", F.struct("preds", "logits1", "logits2").alias(c))
            for m, c in ((model, "a"), (loaded, "b")))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


# ---- A1-A3 over files: documents written as TEI records below the shared folder
def escaped(x):
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tei_text():
    """A record: four lines to a page, notes and segs in turn, links and ids."""
    doc = F.col("doc_id").cast("string")

    def line(x, k):
        page = F.lpad((k / 4).cast("int").cast("string"), 3, "0")
        pb = F.when(k % 4 == 0, F.concat(F.lit('<pb facs="https://a.b/c/prot_1900_'), doc, F.lit("-"), page, F.lit('.jp2/_view"/>')))
        tag = F.when(k % 2 == 0, "note").otherwise("seg")
        ident = F.concat(F.lit("d"), doc, F.lit("-l"), k.cast("string"))
        return F.concat(F.coalesce(pb, F.lit("")), F.lit("<"), tag, F.lit(' xml:id="'), ident, F.lit('">'), escaped(x), F.lit("</"), tag, F.lit(">"))

    body = F.array_join(F.transform(F.split("text", "\n", -1), line), "")
    return F.concat(F.lit("<TEI><head>Prot. "), doc, F.lit("</head><body>"), body, F.lit("</body></TEI>"))


@register("tei_records", f"""
SELECT 'd' || CAST(doc_id AS VARCHAR) || '-l' || CAST(line_no AS VARCHAR) AS id,
       CAST((line_no // 4) % 1000 + 1 AS BIGINT) AS page_number, text_line
FROM (SELECT doc_id, line_no, {norm_sql('raw')} AS text_line FROM ({DOC_LINES_SQL})) WHERE length(text_line) > 0
""")
def q_tei_records(spark, sf):
    from pagecurate.session import scratch_dir
    from pagecurate.sources.tables import write_files
    from pagecurate.sources.tei import read_records, segments_table
    root = scratch_dir(spark, "tei")
    d = T(spark, sf, "documents").filter("doc_id IS NOT NULL").select("doc_id", tei_text().alias("value"))
    # one file per record; a document that occurs again is a record of its own
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5("value")))
    doc = F.col("doc_id").cast("string")
    name = F.format_string("%03d/%s-%d.xml", F.crc32(doc.cast("binary")) % 1000, doc, copy)
    write_files(d.select(name.alias("name"), "value"), root, "name", "value")
    seg = segments_table(explode_pages(read_records(spark, root)))
    return seg.select("id", F.col("page_number").cast("bigint").alias("page_number"), "text_line")


# ---------------------------------------------------------------- A4, A9 on files written from the tables
def alto_text(turns):
    """A layout page: a block per turn of the array ``turns``, a line per line."""
    def attribute(x):
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(sign), F.lit(name))
        return x

    def line(x):
        words = F.transform(F.filter(F.split(x, " ", -1), lambda w: w != ""), lambda w, i: F.concat(
            F.lit('<String CONTENT="'), attribute(w), F.lit('" HPOS="'), (i * 10).cast("string"), F.lit('" VPOS="5" WIDTH="8" HEIGHT="15"/>')))
        return F.concat(F.lit("<TextLine>"), F.array_join(words, ""), F.lit("</TextLine>"))

    def block(t, i):
        place = F.concat(F.lit('" HPOS="100" VPOS="'), (i * 1000).cast("string"), F.lit('" WIDTH="900" HEIGHT="500">'))
        return F.concat(F.lit('<TextBlock ID="B'), i.cast("string"), place,
                        F.array_join(F.transform(F.split(t["text"], "\n", -1), line), ""), F.lit("</TextBlock>"))

    return F.concat(F.lit('<alto><Layout><Page WIDTH="2000" HEIGHT="3000"><PrintSpace>'), F.array_join(F.transform(turns, block), ""),
                    F.lit("</PrintSpace></Page></Layout></alto>"))


@register("layout_blocks", """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS block_idx FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT *, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS words FROM t)
SELECT 'prot-2000--ak--' || conv_id AS package_id, CAST(conv_id % 7 + 1 AS BIGINT) AS page_index,
       CAST(block_idx AS BIGINT) AS block_idx, 'B' || block_idx AS block_id, array_to_string(words, ' ') AS block_text,
       CAST(len(words) AS BIGINT) AS n_words, 100.0::DOUBLE AS box_left, (1000.0 * block_idx)::DOUBLE AS box_upper,
       1000.0::DOUBLE AS box_right, (1000.0 * block_idx + 500)::DOUBLE AS box_lower, 2000.0::DOUBLE AS page_width
FROM w
""")
def q_layout_blocks(spark, sf):
    """Conversations as layout pages: a file each, a block per turn, a line per line."""
    from pagecurate.session import scratch_dir
    from pagecurate.sources.alto import explode_blocks, read_layout
    from pagecurate.sources.tables import write_files

    turns = T(spark, sf, "conversations").filter("conv_id IS NOT NULL")
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    name = F.format_string("%1$s/prot_2000__ak__%1$s-%2$03d.xml", F.col("conv_id").cast("string"), F.col("conv_id") % 7 + 1)
    root = scratch_dir(spark, "alto")
    write_files(pages.select(name.alias("name"), alto_text("t").alias("value")), root, "name", "value")
    b = explode_blocks(read_layout(spark, root))
    return b.select("package_id", F.col("page_index").cast("bigint").alias("page_index"), F.col("block_idx").cast("bigint").alias("block_idx"),
                    "block_id", "block_text", F.size("words").cast("bigint").alias("n_words"),
                    *[F.col(f"block_box.{k}").cast("double").alias(f"box_{k}") for k in ("left", "upper", "right", "lower")], "page_width")


@register("materialised_records", """
SELECT CAST(1900 + doc_id % 50 AS VARCHAR) AS folder, 'prot-' || (1900 + doc_id % 50) || '--ak--' || doc_id || '.xml' AS name, md5(text) AS digest
FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0
""")
def q_materialised_records(spark, sf):
    """Every document as a record file of a year folder, read back by A1 (which
    gives no row for an empty file)."""
    from pagecurate.session import scratch_dir
    from pagecurate.sources.tables import materialise_subset
    from pagecurate.sources.tei import read_records
    year = (F.col("doc_id") % 50 + 1900).cast("string")
    file = F.concat(F.lit("prot-"), year, F.lit("--ak--"), F.col("doc_id").cast("string"), F.lit(".xml"))
    root = scratch_dir(spark, "records")
    materialise_subset(T(spark, sf, "documents").filter("doc_id IS NOT NULL").select(year.alias("folder"), file.alias("file"), F.col("text").alias("value")), root)
    rec = read_records(spark, root)
    return rec.select("folder", F.element_at(F.split("file", "/"), -1).alias("name"), F.md5("value").alias("digest"))


@register("corpus_sample", f"""
WITH doc AS (SELECT doc_id, text, CAST(1900 + doc_id % 50 AS VARCHAR) AS folder,
                    'prot-' || (1900 + doc_id % 50) || '--ak--' || doc_id || '.xml' AS name FROM documents WHERE doc_id IS NOT NULL),
fol AS (SELECT folder, CAST(folder AS INTEGER) // 10 * 10 AS decade FROM (SELECT DISTINCT folder FROM doc)
        WHERE CAST(folder AS INTEGER) BETWEEN 1905 AND 1944),
r AS (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY folder) - 1 AS i, count(*) OVER (PARTITION BY decade) AS n FROM fol),
dr AS (SELECT decade, n, j, CAST('0x' || substr({hash_sql(42, 'decade', 'j')}, 1, 8) AS BIGINT) % n AS i
       FROM (SELECT DISTINCT decade, n FROM r), (SELECT unnest(range(20)) AS j)),
df AS (SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY j) AS nth FROM dr JOIN r USING (decade, i)),
fi AS (SELECT doc_id, text, folder, name, row_number() OVER (PARTITION BY folder ORDER BY {hash_sql(42, 'name')}, name) AS nth FROM doc),
ln AS (SELECT doc_id, folder, name, pos - 1 AS line_no, (pos - 1) // 4 + 1 AS page, {norm_sql('raw')} AS text_line FROM (
  SELECT doc_id, folder, name, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
  FROM fi JOIN df USING (folder, nth))),
pg AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY {hash_sql(42, "folder || '#' || name || '#' || page")}, page) AS rk
       FROM (SELECT DISTINCT doc_id, folder, name, page FROM ln WHERE length(text_line) > 0))
SELECT name, 'd' || ln.doc_id || '-l' || line_no AS id, CAST((page - 1) % 1000 + 1 AS BIGINT) AS page_number, text_line
FROM ln JOIN pg USING (doc_id, page) WHERE rk <= 2 AND length(text_line) > 0
""")
def q_corpus_sample(spark, sf):
    """I1 end to end: every document as a record of a year folder; twenty files a decade
    and two pages a file are drawn, copied and cut."""
    from pagecurate.plans.corpus import sample_corpus
    from pagecurate.session import scratch_dir
    from pagecurate.sources.tables import write_files
    year = (F.col("doc_id") % 50 + 1900).cast("string")
    name = F.concat(year, F.lit("/prot-"), year, F.lit("--ak--"), F.col("doc_id").cast("string"), F.lit(".xml"))
    root = scratch_dir(spark, "corpus")
    write_files(T(spark, sf, "documents").filter("doc_id IS NOT NULL").select(name.alias("name"), tei_text().alias("value")), f"{root}/all", "name", "value")
    seg = sample_corpus(spark, f"{root}/all", 1905, 1944, files_per_decade=20, pages_per_file=2, output=f"{root}/sample")
    return seg.select(F.element_at(F.split("file", "/"), -1).alias("name"), "id", F.col("page_number").cast("bigint").alias("page_number"), "text_line")


# ---------------------------------------------------------------- I4 on TEI and ALTO files written from the tables
def clean_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^\\x20-\\x7E\\n]', '?', 'g')"


@register("positional_features", f"""
WITH t AS (SELECT conv_id, turn // 4 + 1 AS page, turn, role, {clean_sql('text')} AS txt
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
seg AS (SELECT *, row_number() OVER (PARTITION BY conv_id, page ORDER BY turn, txt) - 1 AS so, {norm_sql('txt')} AS st,
               max(page) OVER (PARTITION BY conv_id) AS pages FROM t WHERE role = 'user'),
blk AS (SELECT conv_id, page + CASE WHEN conv_id % 4 = 3 THEN 1 ELSE 0 END AS layout,
               row_number() OVER (PARTITION BY conv_id, page ORDER BY turn, txt) - 1 AS bi,
               array_to_string(list_filter(string_split(replace(txt, chr(10), ' '), ' '), lambda w: w <> ''), ' ') AS bt
        FROM t WHERE role <> 'user'),
loc AS (SELECT seg.*, (SELECT min(layout) FROM blk WHERE blk.conv_id = seg.conv_id AND layout BETWEEN page AND page + 1) AS layout
        FROM seg WHERE length(st) > 0),
p AS (SELECT loc.conv_id, page, so, st, bi, bt FROM loc JOIN blk ON loc.conv_id = blk.conv_id AND loc.layout = blk.layout),
{indel_ctes('p')},
best AS (SELECT conv_id, page, so, bi FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, page, so ORDER BY score DESC, abs(bi - so), bi) AS rn
  FROM (SELECT p.*, {INDEL_SCORE_SQL} AS score FROM p LEFT JOIN il USING (st, bt))) WHERE rn = 1)
SELECT 's' || conv_id || '-' || page || '-' || so AS id,
       CASE WHEN bi IS NOT NULL THEN 50.0 END::DOUBLE AS left_pos, round(bi * 1000.0 / 3000 * 1000, 6)::DOUBLE AS upper_pos,
       CASE WHEN bi IS NOT NULL THEN 500.0 END::DOUBLE AS right_pos, round((bi * 1000.0 + 500) / 3000 * 1000, 6)::DOUBLE AS lower_pos,
       CAST(1900 + conv_id % 50 AS BIGINT) AS year, round(page * 1000.0 / pages, 6)::DOUBLE AS relative_page_number,
       CAST(page % 2 = 0 AS BIGINT) AS even_page, CAST(conv_id % 3 = 0 AS BIGINT) AS second_chamber, CAST(conv_id % 3 = 2 AS BIGINT) AS unicameral
FROM loc LEFT JOIN best USING (conv_id, page, so)
""")
def q_positional_features(spark, sf):
    """User turns as records, a page per four turns, the other turns as the blocks of the
    page's layout; a quarter of the layouts lies on the following page (D5)."""
    from pagecurate.plans.positional import positional_features
    from pagecurate.session import scratch_dir
    from pagecurate.sources.alto import read_layout
    from pagecurate.sources.tables import write_files
    from pagecurate.sources.tei import read_records, segments_table
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\n]", "?")
    turns = T(spark, sf, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", F.floor(F.col("turn") / 4).cast("int").alias("p"), "turn", "role", clean.alias("text"))
    turns = turns.withColumn("p", F.col("p") + 1)
    number = F.col("conv_id").cast("string")
    year = (F.col("conv_id") % 50 + 1900).cast("string")
    chamber = F.element_at(F.array(F.lit("--ak--"), F.lit("--fk--"), F.lit("--")), (F.col("conv_id") % 3 + 1).cast("int"))
    package = F.concat(F.lit("prot-"), year, chamber, number)
    pages = turns.groupBy("conv_id", "p", (F.col("role") == "user").alias("said")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    root = scratch_dir(spark, "positions")
    # layouts: a file per page
    layout = F.col("p") + F.when(F.col("conv_id") % 4 == 3, 1).otherwise(0)
    name = F.concat(number, F.lit("/"), F.replace(package, F.lit("-"), F.lit("_")), F.format_string("-%03d.xml", layout))
    write_files(pages.filter("NOT said").select(name.alias("name"), alto_text("t").alias("value")), f"{root}/alto", "name", "value")

    # records: a file per conversation
    def segment(t, i):
        ident = F.concat(F.lit("s"), number, F.lit("-"), F.col("p").cast("string"), F.lit("-"), i.cast("string"))
        return F.concat(F.lit('<seg xml:id="'), ident, F.lit('">'), escaped(t["text"]), F.lit("</seg>"))

    link = F.concat(F.lit("https://a.b/c/"), F.replace(package, F.lit("-"), F.lit("_")), F.format_string("-%03d.jp2/_view", F.col("p")))
    page = F.concat(F.lit('<pb facs="'), link, F.lit('"/>'), F.array_join(F.transform("t", segment), ""))
    records = pages.filter("said").select("conv_id", F.struct("p", page.alias("page")).alias("page"))
    records = records.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x["page"]), "").alias("body"))
    value = F.concat(F.lit("<TEI><head>"), package, F.lit("</head><body>"), F.col("body"), F.lit("</body></TEI>"))
    write_files(records.select(F.concat(year, F.lit("/"), package, F.lit(".xml")).alias("name"), value.alias("value")), f"{root}/tei", "name", "value")

    rec = read_records(spark, f"{root}/tei")
    found = positional_features(segments_table(explode_pages(rec)), rec, read_layout(spark, f"{root}/alto"), max_page_offset=1)
    return found.select("id", *[r6(f"pos{c}").alias(f"{c.lower()}_pos") for c in ("Left", "Upper", "Right", "Lower")],
                        r6("relative_page_number").alias("relative_page_number"),
                        *[F.col(c).cast("bigint").alias(c) for c in ("year", "even_page", "second_chamber", "unicameral")])


# ---------------------------------------------------------------- E8, E22 per split, I5, flagship
@register("block_text", """
SELECT conv_id, turn, array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''), ' ')
       AS block_text
FROM conversations
""")
def q_block_text(spark, sf):
    from pagecurate.operators.layout import block_text
    c = T(spark, sf, "conversations")
    words = F.transform(F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1), lambda w: w != ""),
                        lambda w: F.struct(w.alias("content")))
    return c.select("conv_id", "turn", block_text(words).alias("block_text"))


@register("standardise_per_split", """
WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM lineitem GROUP BY l_returnflag)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l.l_returnflag,
       round((l_quantity - mq) / CASE WHEN sq = 0 OR sq IS NULL THEN 1.0 ELSE sq END, 6) AS quantity_z
FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag
""")
def q_standardise_per_split(spark, sf):
    from pagecurate.plans.features import standardise
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    z = standardise(li, ["l_quantity"], per_split="l_returnflag")
    return z.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_returnflag",
                    r6("l_quantity").alias("quantity_z"))


@register("profile_dataset", STRAT_SQL + """
SELECT coalesce(split, 'total') AS split, count(*) AS n,
       round(count(*) / sum(count(*)) FILTER (WHERE grouping(split) = 1) OVER (), 6) AS share,
       CAST(sum(quality) AS DOUBLE) AS marginal_positives, round(avg(quality), 6) AS marginal_share,
       CAST(sum(toxic) AS DOUBLE) AS merged_positives, round(avg(toxic), 6) AS merged_share
FROM split GROUP BY ROLLUP (split)
""")
def q_profile_dataset(spark, sf):
    from pagecurate.plans.profile import profile_dataset
    s = strat(spark, sf).withColumnRenamed("quality", "marginal_text").withColumnRenamed("toxic", "merged")
    p = profile_dataset(s, "split", targets=("marginal_text", "merged"))
    return p.select("split", "n", r6("share").alias("share"),
                    F.col("marginal_text_positives").alias("marginal_positives"),
                    r6("marginal_text_share").alias("marginal_share"),
                    F.col("merged_positives").alias("merged_positives"), r6("merged_share").alias("merged_share"))


@register("segment_label_profile", STRAT_SQL + f"""
, seg AS (SELECT doc_id, {norm_sql('raw')} AS text_line FROM ({DOC_LINES_SQL})),
j AS (SELECT seg.doc_id, split.split, split.quality AS m, split.toxic AS g
      FROM seg JOIN split ON seg.doc_id = split.doc_id WHERE length(seg.text_line) > 0)
SELECT coalesce(split, 'total') AS split, count(*) AS segments, count(DISTINCT doc_id) AS documents,
       round(avg(m), 6) AS marginal_share, round(avg(g), 6) AS merged_share,
       round(avg(CASE WHEN coalesce(m, 0) + coalesce(g, 0) = 2 THEN 1.0 ELSE 0.0 END), 6) AS merged_class_share
FROM j GROUP BY ROLLUP (split)
""")
def q_segment_label_profile(spark, sf):
    from pagecurate.plans.profile import segment_label_profile
    return segment_label_profile(spark, sf)


@register("attach_predictions", f"""
SELECT e.vec_id, CAST(e.label AS BIGINT) AS label, p.preds, p.logits1
FROM embeddings e LEFT JOIN (
  SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS preds, round(l[1], 6) AS logits1
  FROM (SELECT vec_id, {EMB_ALL} AS l FROM embeddings)) p ON e.vec_id = p.vec_id
""")
def q_attach_predictions(spark, sf):
    e = emb(spark, sf)
    preds = e.select("vec_id", fx.argmax_class("logits").cast("bigint").alias("preds"),
                     r6(F.col("logits")[0]).alias("logits1"))
    base = T(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    return joins.attach_predictions(base, preds, key="vec_id")


# ---------------------------------------------------------------- A5-A8 sinks and sources, round trip
def _scratch(spark: SparkSession, what: str) -> str:
    from pagecurate.session import scratch_dir
    return scratch_dir(spark, what)


@register("csv_roundtrip", """
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels
""")
def q_csv_roundtrip(spark, sf):
    from pyspark.sql.types import LongType, StructField, StructType
    from pagecurate.sources import tables
    path = _scratch(spark, "labels-csv")
    tables.write_table(T(spark, sf, "labels"), path, fmt="csv")
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "quality", "toxic")])
    return tables.read_annotations(spark, path, schema)


@register("parts_roundtrip", """
SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) AS BIGINT) AS part FROM orders
""")
def q_parts_roundtrip(spark, sf):
    from pagecurate.sources import tables
    path = _scratch(spark, "orders-parts")
    tables.write_parts(T(spark, sf, "orders").select("o_orderkey"), path, 5, ["o_orderkey"])
    back = tables.read_parts(spark, path)
    return back.select("o_orderkey", F.col("part").cast("bigint").alias("part"))
