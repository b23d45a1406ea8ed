"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
blocks, exact weighted-shingle similarity. DataFrame functions only.

Words are cut at blanks, A-Z in lower case; a shingle is five words (all words
of a shorter item). A window is as many consecutive words of a document as a
benchmark item has (the whole document if it is shorter).

1. Documents. All shingles of all texts are looked up among those of the items. A
   document is searched for windows of a length only if, for some item of that
   length, it holds so many of its shingles that a window could reach the
   threshold, and only from the first to the last window that holds one of
   them. That is all that shingles decide here.
2. Fingerprints. Every window of these lengths in these stretches gets a 64-bit
   SimHash, every occurrence of a shingle voting with weight one. It rolls: the
   votes of a document for each bit are summed up along its words once, several
   bits to a number, and a window's votes are the difference of two such sums. Long
   documents are summed in chunks that overlap by the longest item.
3. Blocks. A fingerprint has five blocks of 13 or 12 bits. Of two fingerprints
   within ``RADIUS`` bits at least one block differs in at most ``NEAR`` bits, so each
   item lists all values that near to its blocks, and an equi-join on (length,
   block, value) finds every item within the radius of a window. Nothing else ties
   windows to items.
4. Verification. Weighted Jaccard similarity of the two bags of shingles, each
   weighted by its number of occurrences: sum of the lesser over sum of the
   greater counts, on the shingles themselves.

At similarity 0.75 the fingerprints differ in 11 bits on average with a standard
deviation of 3, so a radius of 19 loses one window in 400 that lies exactly at the
threshold, one in 1,000 at 0.8 and none that can be measured at 0.9; a document is
lost only with all its windows of an item.

Broadcasts are hinted only below a counted number of rows; beyond it the same
joins are shuffled. Defined results: NULL and empty texts and items match
nothing; identical document rows are reported once, rows that share an id but
not the text each for themselves; a NULL id is reported as such; empty tables
give an empty report; extra columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecurate.llm.common import hinted, words, written

SHINGLE = 5
RADIUS = 19
#: Bits in which one block of two fingerprints within the radius differs at most.
NEAR = 3
MIN_SIMILARITY = 75  # per cent
BLOCK_BITS = [13, 13, 13, 13, 12]
MOST_BROADCAST = 500_000


def lower_words(text: Column) -> Column:
    """Words with A-Z in lower case. Of an ASCII text ``lower`` changes nothing else."""
    ascii_only = F.octet_length(text) == F.length(text)
    return words(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def _shingles(ws: Column, width: Column | int, make) -> Column:
    """``make(words of a shingle)`` for each position."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(ws) - width + 1
    return F.when((last > 0) & (width > 0), F.transform(F.sequence(F.lit(1), last), lambda i: make(F.slice(ws, i, width)))).otherwise(F.array())


def _hash_shingles(ws: Column, width) -> Column:
    return _shingles(ws, width, lambda s: F.xxhash64(s)).cast("array<bigint>")


def _text_shingles(ws: Column, width) -> Column:
    return _shingles(ws, width, lambda s: F.concat_ws(" ", s)).cast("array<string>")


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes; a bit is set when more
    hashes have it than not."""
    def bit(b):
        votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(
            F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def fingerprint_blocks(fp: Column) -> Column:
    """Array of (block, value) over RADIUS + 1 blocks."""
    out, at = [], 0
    for i, width in enumerate(BLOCK_BITS):
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def near_blocks(fp: Column) -> Column:
    """Array of (block, value) with all values within NEAR bits of the blocks."""
    out = []
    for i, width in enumerate(BLOCK_BITS):
        masks = [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(width), k)]
        own = F.element_at(fingerprint_blocks(fp), i + 1)
        out.append(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(own["block"].alias("block"), own["value"].bitwiseXOR(m).alias("value"))))
    return F.concat(*out)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, item (key), n_words, width, words of each distinct item."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), lower_words(F.col(text_col)).alias("words")).distinct()
    n = F.size("words")
    return (rows.filter(n > 0).withColumn("item", F.xxhash64("item_id", "words"))
            .withColumn("n_words", n).withColumn("width", F.least(F.lit(SHINGLE), n)))


def _enough(common: Column) -> Column:
    """Whether ``common`` shared shingles let a window reach the threshold."""
    n_a, n_b = F.least("n_doc", "n_words") - F.col("width") + 1, F.col("n_words") - F.col("width") + 1
    return (100 + MIN_SIMILARITY) * common >= MIN_SIMILARITY * (n_a + n_b)  # similarity common / (n_a + n_b - common)


def _lanes(longest: int) -> tuple[int, int]:
    """(bits of a lane, positions of a chunk): sums over a chunk and the longest
    window fit a lane, and as many lanes as possible a BIGINT."""
    bits = next(b for b in (16, 21, 31) if longest <= 1 << (b - 2))
    return bits, 1 << (bits - 2)


def window_fingerprints(found: DataFrame, widths: list[int], longest: int) -> DataFrame:
    """(doc_id, text_hash, n_words, width, start, fp) of the wanted windows that
    hold a shingle. ``found``: doc_id, text_hash, words, lengths (structs of width,
    n_words, and the first and last start), a row for each id and text."""
    bits, step = _lanes(longest)
    per = 63 // bits if bits > 16 else 4
    groups = [range(b, min(64, b + per)) for b in range(0, 64, per)]
    sums = [f"s{j}" for j in range(len(groups))]
    n_doc = F.size("words")

    def of(h: Column, b: int) -> Column:
        return F.shiftright(h, b).bitwiseAND(F.lit(1).cast("long"))

    votes = [reduce(add, [F.shiftleft(of(F.col("h"), b), bits * t) for t, b in enumerate(group)]).alias(c) for c, group in zip(sums, groups)]
    near = F.floor(F.greatest(F.col("at") - longest, F.lit(0)) / step)
    places = None
    for width in widths:
        own = F.filter("lengths", lambda x: x["width"] == width)
        low = F.array_min(F.transform(own, lambda x: x["first"]))
        high = F.array_max(F.transform(own, lambda x: F.least(n_doc, x["last"] + x["n_words"])))
        stretch = found.filter(F.size(own) > 0).select("doc_id", "text_hash", low.alias("low"), F.slice("words", low + 1, high - low).alias("words"))
        at = (stretch.select("doc_id", "text_hash", "low", F.posexplode(_hash_shingles(F.col("words"), width)).alias("at", "h"))
              .select("doc_id", "text_hash", F.lit(width).alias("width"), (F.col("low") + F.col("at")).alias("at"), "h")
              .select("doc_id", "text_hash", "width", "at", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / step), near))).alias("chunk"), *votes))
        places = at if places is None else places.unionByName(at)
    windows = (found.select("doc_id", "text_hash", n_doc.alias("n_doc"), F.inline("lengths"))
               .withColumn("last", F.least(F.col("last"), F.greatest(F.col("n_doc") - F.col("n_words"), F.lit(0))))
               .withColumn("start", F.explode(F.sequence(F.col("first"), F.col("last"))))
               .withColumn("chunk", F.floor(F.col("start") / step)).withColumn("m", F.least("n_doc", "n_words") - F.col("width") + 1).filter("m > 0"))
    # running votes before the first and after the last shingle of each window
    bounds = F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("turn")), F.struct((F.col("start") + F.col("m") - 1).alias("at"), F.lit(2).alias("turn"))))
    events = (windows.select("doc_id", "text_hash", "width", "chunk", "n_words", "start", "m", bounds)
              .unionByName(places.withColumn("turn", F.lit(1)), allowMissingColumns=True))
    so_far = Window.partitionBy("doc_id", "text_hash", "width", "chunk").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.select("doc_id", "text_hash", "width", "chunk", "n_words", "start", "m", "turn", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in sums])
    cast = summed.filter("turn <> 1").groupBy("doc_id", "text_hash", "width", "chunk", "n_words", "start", "m").agg(*[(F.max(c) - F.min(c)).alias(c) for c in sums])

    def bit(j: int, t: int, b: int) -> Column:
        count = F.shiftright(F.col(sums[j]), bits * t).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        return F.when(2 * count > F.col("m"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    fp = reduce(lambda x, y: x.bitwiseOR(y), [bit(j, t, b) for j, group in enumerate(groups) for t, b in enumerate(group)])
    return cast.select("doc_id", "text_hash", "n_words", "width", "start", fp.alias("fp"))


def near_items(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(the windows' columns, item, hamming) of the windows (n_words, fp, ..) and
    the items (item, n_words, item_fp) within RADIUS bits, each pair once."""
    index = hinted(written(items.select("item", "n_words", "item_fp", F.inline(near_blocks(F.col("item_fp")))), "leak-index"), MOST_BROADCAST)
    probes = windows.select("*", F.inline(fingerprint_blocks(F.col("fp"))))
    found = probes.join(index, ["n_words", "block", "value"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    return found.filter(F.col("hamming") <= RADIUS).select(*windows.columns, "item", "hamming").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, text_hash,
    item_id, and of the most similar window its start (in words), n_words,
    hamming distance and similarity."""
    items = written(_items(benchmark, item_col, item_text_col).withColumn("item_fp", simhash(_hash_shingles(F.col("words"), F.col("width")))), "leak-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    longest = items.agg(F.coalesce(F.max("n_words"), F.lit(1))).first()[0]
    wanted = items.select("item", "n_words", "width", F.explode(_hash_shingles(F.col("words"), F.col("width"))).alias("hash")).distinct()

    # 1. the key of a document row: its id and the hash of its text
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    worded = texts.select("doc_id", "text_hash", lower_words(F.col("text")).alias("words"))
    places = None
    for width in widths:
        at = worded.select("doc_id", "text_hash", F.size("words").alias("n_doc"), F.posexplode(_hash_shingles(F.col("words"), width)).alias("i", "hash"))
        places = at if places is None else places.unionByName(at)
    shared = (places.join(hinted(wanted, MOST_BROADCAST), "hash").groupBy("doc_id", "text_hash", "n_doc", "item", "n_words", "width")
              .agg(F.count("*").alias("count"), F.min("i").alias("low"), F.max("i").alias("high")))
    stretch = (shared.filter(_enough(F.col("count"))).groupBy("doc_id", "text_hash", "width", "n_words")
               .agg(F.greatest(F.lit(0), F.min("low") - F.first("n_words") + F.first("width")).alias("first"), F.max("high").alias("last")))
    lengths = written(stretch.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
                      .agg(F.collect_list(F.struct("width", "n_words", "first", "last")).alias("lengths")), "leak-lengths")
    # a row holds at most one entry per length of an item
    searched = F.broadcast(lengths) if lengths.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0))).first()[0] <= MOST_BROADCAST else lengths
    same_row = texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_hash"] == F.col("_hash"))
    # rows with one id and text count once
    found = texts.join(searched, same_row).dropDuplicates(["doc_id", "text_hash"])
    found = written(found.select("doc_id", "text_hash", lower_words(F.col("text")).alias("words"), "lengths"), "leak-texts")

    # 2. and 3.
    windows = window_fingerprints(found, widths, longest)
    near = written(near_items(windows, items.select("item", "n_words", "item_fp")), "leak-near")

    # 4. the words of the windows found, each distinct window and item once
    by_doc = near.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "n_words", "start", "hamming")).alias("at"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "at")
    at_text = found.join(by_doc, found["doc_id"].eqNullSafe(F.col("_id")) & (found["text_hash"] == F.col("_hash"))).select("doc_id", "text_hash", "words", F.explode("at").alias("w"))
    text = F.concat_ws(" ", F.slice("words", F.col("w.start") + 1, F.col("w.n_words")))
    seen = written(at_text.select("doc_id", "text_hash", "w.item", "w.start", "w.hamming", text.alias("text"))
                   .withColumn("window", F.md5(F.col("text").cast("binary"))).distinct(), "leak-windows")
    known = hinted(items.select("item", "item_id", "n_words", "width"), MOST_BROADCAST)
    distinct = seen.groupBy("item", "window").agg(F.first("text").alias("text")).join(known.select("item", "width"), "item").withColumn("words", F.split("text", " "))

    def bags(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.explode(_text_shingles(F.col("words"), F.col("width"))).alias("shingle")).groupBy(*keys, "shingle").count()

    both = (bags(distinct, "item", "window").withColumnRenamed("count", "a")
            .join(bags(items, "item").withColumnRenamed("count", "b"), ["item", "shingle"], "left"))
    common = both.groupBy("item", "window").agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("common"), F.sum("a").alias("n_a"))
    union = F.col("n_a") + F.col("n_words") - F.col("width") + 1 - F.col("common")
    verified = (common.join(known, "item").filter(100 * F.col("common") >= MIN_SIMILARITY * union)
                .select("item", "window", "item_id", "n_words", (F.col("common") / union).alias("similarity")))
    hits = seen.select("doc_id", "text_hash", "item", "window", "start", "hamming").join(verified, ["item", "window"])
    best = F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct(F.col("similarity"), -F.col("start")))
    return hits.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **items) -> DataFrame:
    """The rows in which no benchmark item is found."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, **items).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(hinted(leaks, MOST_BROADCAST), docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash")), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash", "hamming")


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: Every window of the documents that hold enough shingles of an item against that
#: item by the exact similarity, without fingerprints.
OP9_SQL = rf"""
WITH d AS (
  SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS th, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT *, least(5, len(w)) AS k FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, w, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM b)),
kk AS (SELECT DISTINCT k FROM b),
ds AS (
  SELECT doc_id, th, w, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, th, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, kk)),
near AS (
  SELECT ds.doc_id, ds.th, ds.w AS dw, bs.item_id, bs.w AS bw, bs.k FROM ds JOIN bs USING (s) GROUP BY ALL
  HAVING 175 * count(*) >= 75 * (least(len(dw), len(bw)) + len(bw) - 2 * bs.k + 2)),
win AS (SELECT *, unnest(range(0, greatest(len(dw) - len(bw), 0) + 1)) AS start FROM near),
numbered AS (SELECT row_number() OVER () AS id, *, dw[start + 1:start + len(bw)] AS ww FROM win),
a AS (
  SELECT id, s, count(*) AS n FROM (
    SELECT id, array_to_string(ww[i:i + k - 1], ' ') AS s FROM (SELECT id, ww, k, unnest(range(1, len(ww) - k + 2)) AS i FROM numbered)) GROUP BY 1, 2),
c AS (
  SELECT id, s, count(*) AS n FROM (
    SELECT id, array_to_string(bw[i:i + k - 1], ' ') AS s FROM (SELECT id, bw, k, unnest(range(1, len(bw) - k + 2)) AS i FROM numbered)) GROUP BY 1, 2),
m AS (SELECT a.id, sum(least(a.n, c.n)) AS common FROM a JOIN c ON a.id = c.id AND a.s = c.s GROUP BY 1),
v AS (
  SELECT doc_id, th, item_id, start::INT AS start, len(bw)::INT AS n_words, common::DOUBLE / (len(ww) - k + 1 + len(bw) - k + 1 - common) AS similarity
  FROM numbered JOIN m USING (id) WHERE 100 * common >= 75 * (len(ww) - k + 1 + len(bw) - k + 1 - common))
SELECT doc_id, item_id, start, n_words, similarity FROM v
QUALIFY row_number() OVER (PARTITION BY doc_id, th, item_id ORDER BY similarity DESC, start) = 1
"""
