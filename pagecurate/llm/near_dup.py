"""Near-duplicate groups by min-max hashing.

A document's set holds its distinct five-word shingles (words cut at blanks,
A-Z in lower case; all words as one shingle when there are fewer), as 64-bit
hashes: two different shingles of a pair of documents of a million words each
are taken for one with a probability of 1e-7, whatever the texts. Two documents are linked when ``100 * common >= 75 * union``, decided on
their full sets; a group is a connected component of links.

Signatures. Under each permutation both the smallest and the largest hash are
kept, so ``PERMUTATIONS`` hash evaluations per shingle give twice as many values.
Both agree between two sets with probability equal to their similarity, and
``ROWS`` values in a row make one of ``BANDS`` bands. A pair at similarity 0.75
shares no band with probability ``(1 - 0.75**4)**40 = 3e-7``, at 0.8 with 2e-9.
The low bytes of all values are a sketch; two sets at 0.75 agree in fewer than
``MIN_AGREEING`` of them with probability 3e-7 (five standard deviations).

Groups of copies. Documents with the same set are one node from the start. A
bucket of a band never emits all its pairs:

1. every member is paired with one node of the bucket (its pivot, drawn by
   hash); the pairs are verified, links make components, the pivot leaves the
   bucket;
2. a bucket whose remaining members lie in one component is done. In the
   others, members of different components are compared by their sketches, in
   blocks of ``BLOCK`` members by ``BLOCK``. A block returns no pairs but the
   areas that agreeing pairs connect, as a spanning forest;
3. the sets of an area are compared exactly, again in blocks, by one matrix
   product per block; a block returns one link per two components it joins.

A bucket of more than ``BUCKET_ROWS`` open members is first split by bands of
further permutations (pairs above the threshold meet again in a sub-bucket with
the probability above). So no step emits more rows than there are memberships
of nodes in buckets, however many pairs a group holds.

Texts are read twice: for signatures, and for the sets of nodes that occur in a
pair. Everything else moves nodes (64-bit numbers), band hashes and the sets of
candidate pairs. Joins by bucket or node are plain joins that adaptive execution
splits when a key is skewed.

Defined results: no words or NULL text: empty set, linked with nothing, its own
component. The component's id is its smallest id; NULL ids count only where a
component has no other. Repeated rows and equal texts form a component. An
empty table gives no rows. Ids are cast to long; one that is not a number fails
the job. Existing columns of the output's names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecurate.llm.common import WORD, hinted, small_batches, written
from pagecurate.llm.hashing import mix, window_hashes, word_hashes

SHINGLE = 5
MIN_SIMILARITY = 75  # per cent
ROWS, BANDS = 4, 40
PERMUTATIONS = 128
#: Bytes of 256 that agree, five standard deviations below the mean at 0.75.
MIN_AGREEING = 157
BLOCK = 512
BUCKET_ROWS = 16_384
MOST_SPLITS = 6
MOST_BROADCAST = 500_000
_CHUNK = 2048
_COLUMNS = 4096
_STEP = np.uint64(0xD6E8FEB86659FD93)


# ---- sets and signatures ---------------------------------------------------

def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes((text or "").encode().lower())  # bytes.lower() changes A-Z only
    return np.unique(window_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def _permutations(level: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919 + level)
    return (rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32))


def min_max(shingles: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation ``x * times + plus``
    modulo 2**32, side by side."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), _CHUNK):
        y = x[at:at + _CHUNK, None] * times + plus
        np.minimum(low, y.min(axis=0), out=low)
        np.maximum(high, y.max(axis=0), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def band_hashes(values: np.ndarray) -> np.ndarray:
    """The first ROWS * BANDS values, ROWS to a band."""
    rows = values[:ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = h * _STEP + rows[:, i]
    return mix(h).view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """One byte of each value (a high one: low bits of a product depend on few bits)."""
    return (values >> np.uint32(16)).astype(np.uint8).tobytes()


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if r is None else len(r) for r in rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    filled = [r for r in rows if r is not None and len(r)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(filled) if filled else np.empty(0, np.int64), pa.int64()))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (128 bits, NULL for the empty
    set), bands, sketch."""
    times, plus = _permutations(0)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, names, bands, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values = min_max(s, times, plus) if len(s) else None
                bands.append(band_hashes(values) if len(s) else None)
                sketches.append(sketch(values) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()), _lists(bands),
                                              pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_hash", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the given nodes (node, rep, set_hash), from the
    texts. A node's text is any row with its id whose set has its hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            kept, sets = [], []
            for node, name, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = shingle_set(text)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == name:
                    kept.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), _lists(sets)], names=["node", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    texts = rows.join(hinted(nodes, MOST_BROADCAST), F.col("_id").eqNullSafe(F.col("rep"))).select("node", "set_hash", "text")
    return texts.mapInArrow(read, "node long, shingles array<long>")


# ---- links -----------------------------------------------------------------

def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return pairs.join(left, "a").join(right, "b").filter(100 * common >= MIN_SIMILARITY * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (a, b); a component is
    named by its smallest node. Contraction: every node goes to the smallest of
    its neighbours if that is smaller, and on to where that one goes; edges
    follow their ends, and those within one node vanish, until none is left."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "dup-edges")
    names = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    while edges.limit(1).count():
        near = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "dup-near")
        up = written(near.join(near.toDF("up", "further"), "up", "left").select("node", F.coalesce("further", "up").alias("up")), "dup-up")
        moved = edges.join(up.toDF("b", "y"), "b").join(up.toDF("a", "x"), "a", "left").select(F.coalesce("x", "a").alias("x"), "y")
        edges = written(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "dup-edges")
        names = names.join(up.toDF("component", "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return written(names, "dup-names")


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links."""
    ends = links.join(found.toDF("a", "x"), "a", "left").join(found.toDF("b", "y"), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")), "dup-ends")
    up = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("component", "up")
    alone = ends.filter("a = x").select("a").union(ends.filter("b = y").select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    every = found.unionByName(alone.join(found, "node", "left_anti"))
    return written(every.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "dup-names")


@F.arrow_udf(T.IntegerType())
def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bytes that agree between two sketches."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


def _forest(labels: np.ndarray, i: int, hits: np.ndarray) -> list[int]:
    """Of ``hits``, one for each tree that ``i`` is not yet connected with; the
    trees become one."""
    trees, first = np.unique(labels[hits], return_index=True)
    new = trees != labels[i]
    if not new.any():
        return []
    labels[np.isin(labels, trees[new])] = labels[i]
    return hits[first[new]].tolist()


def _edges(node: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    a = np.array([node[i] for i, _ in found], np.int64)
    b = np.array([node[j] for _, j in found], np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _fitting(n: np.ndarray, component: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return others[(component[others] != component[i]) & (4 * np.minimum(n[others], n[i]) >= 3 * np.maximum(n[others], n[i]))]


def _columns(key: tuple, table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """node, component, n of a block, and its two sides (equal for a block with itself)."""
    node, component, n, part = (table.column(c).to_numpy() for c in ("node", "component", "n", "part"))
    return [node, component, n], np.flatnonzero(part == key[1].as_py()), np.flatnonzero(part == key[2].as_py())


def _agreeing_block(key: tuple, table: pa.Table) -> pa.Table:
    """Spanning forest of the pairs of a block whose sketches agree enough."""
    (node, component, n), left, right = _columns(key, table)
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    trees, found = np.arange(len(node)), []
    for i in left.tolist():
        others = _fitting(n, component, i, right)
        hits = others[(sketches[others] == sketches[i]).sum(axis=1) >= MIN_AGREEING]
        found += [(i, j) for j in _forest(trees, i, hits)] if len(hits) else []
    return _edges(node, found)


def _linked_block(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a block by the full sets, one per two components joined."""
    (node, component, n), left, right = _columns(key, table)
    shingles = table.column("shingles").combine_chunks()
    owner = np.repeat(np.arange(len(node)), np.diff(shingles.offsets.to_numpy()))
    values, column, uses = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = uses > 1  # others add to no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.full(len(node), -1)
    place[right] = np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        wide = np.zeros((len(node), _COLUMNS), np.float32)
        wide[owner[a:b], column[a:b] - at] = 1
        common += wide[left] @ wide[right].T
    # components that meet in this block grow together
    _, trees = np.unique(component, return_inverse=True)
    found = []
    for row, i in enumerate(left.tolist()):
        others = _fitting(n, trees, i, right)
        c = common[row, place[others]].astype(np.int64)
        hits = others[100 * c >= MIN_SIMILARITY * (n[i] + n[others] - c)]
        found += [(i, j) for j in _forest(trees, i, hits)] if len(hits) else []
    return _edges(node, found)


def _in_blocks(rows: DataFrame, group: str, size: str, compare) -> DataFrame:
    """Apply ``compare`` to the blocks of each group of rows: members are dealt
    to ``size / BLOCK`` parts, and every two parts meet once."""
    parts = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = (rows.withColumn("n", F.col("n").cast("long")).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")))
    return rows.drop("other", size).groupBy(group, "low", "high").applyInArrow(compare, "a long, b long")


def find_links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(links, components) between classes (node, rep, n_shingles, set_hash, bands, sketch)."""
    every = classes.select("node", "rep", "set_hash")
    sketches = classes.select("node", "sketch")
    banded = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    # a pivot by hash: the many buckets of a group of copies get many pivots, so that
    # hardly a member is without a link to one of them
    pivot = F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node", "n"))
    buckets = banded.groupBy("key").agg(pivot.alias("pivot"), F.count("*").alias("m")).filter("m > 1").select("key", "pivot")
    members = written(banded.join(buckets, "key").filter(F.col("node") != F.col("pivot.node")), "dup-members")

    # 1. members with their pivots
    fits = 4 * F.least("n", "pivot.n") >= 3 * F.greatest("n", "pivot.n")
    star = members.filter(fits).select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
    star = (star.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
            .filter(_agreeing("sa", "sb") >= MIN_AGREEING).select("a", "b"))
    links = _verified(star, docs, every, id_col, text_col)
    found = components(links)

    # 2. and 3. members of the buckets that still hold several components
    rest, times = members.select("key", "node", "n"), 0
    while True:
        named = rest.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        per = named.groupBy("key", "component").agg(F.count("*").alias("c"))
        per = per.groupBy("key").agg(F.sum("c").alias("m"), F.count("*").alias("parts")).filter("parts > 1").select("key", "m")
        opened = written(named.join(per, "key"), "dup-open")
        large = F.lit(False) if times == MOST_SPLITS else F.col("m") > BUCKET_ROWS
        alike = written(_in_blocks(opened.filter(~large).join(sketches, "node"), "key", "m", _agreeing_block).distinct(), "dup-alike")
        if alike.limit(1).count():
            areas = components(alike).withColumnRenamed("component", "area")
            sized = areas.join(areas.groupBy("area").agg(F.count("*").alias("m")), "area")
            known = (sized.join(classes.select("node", F.col("n_shingles").alias("n")), "node").join(found, "node", "left")
                     .withColumn("component", F.coalesce("component", "node")))
            sets = _sets(docs, every.join(areas.select("node"), "node"), id_col, text_col).dropDuplicates(["node"])
            fresh = written(_in_blocks(known.join(sets, "node"), "area", "m", _linked_block), "dup-links")
            if fresh.limit(1).count():
                links = links.unionByName(fresh)
                found = _grown(found, fresh)
        if times == MOST_SPLITS or not opened.filter(large).limit(1).count():
            return links, found
        times += 1
        rest = written(_split(opened.filter(large).select("key", "node", "n"), docs, every, id_col, text_col, times), "dup-split")


def _verified(pairs: DataFrame, docs: DataFrame, every: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    pairs = written(pairs, "dup-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = written(_sets(docs, every.join(nodes, "node"), id_col, text_col).dropDuplicates(["node"]), "dup-sets")
    return written(_verify(pairs, sets), "dup-links")


def _split(members: DataFrame, docs: DataFrame, every: DataFrame, id_col: str, text_col: str, level: int) -> DataFrame:
    """Sub-buckets (key, node, n) of buckets by the bands of further permutations."""
    times, plus = _permutations(level)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = batch.column(1).to_pylist()
            bands = [band_hashes(min_max(np.array(s, np.int64).view(np.uint64), times, plus)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bands)], names=["node", "bands"])

    nodes = every.join(members.select("node").distinct(), "node")
    bands = _sets(docs, nodes, id_col, text_col).dropDuplicates(["node"]).mapInArrow(sign, "node long, bands array<long>")
    return members.join(bands, "node").select(F.explode("bands").alias("band"), "key", "node", "n").select(F.xxhash64("key", "band").alias("key"), "node", "n")


# ---- groups ----------------------------------------------------------------

def near_dup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per document row (doc_id, text_hash, n_shingles, set_hash,
    component_id, component, kept), and the links between nodes by their smallest ids."""
    signed = written(signatures(docs, id_col, text_col), "dup-signatures")
    classes = written(signed.filter("set_hash IS NOT NULL").groupBy("set_hash")
                      .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
                           F.first("sketch").alias("sketch"))
                      .withColumn("node", F.monotonically_increasing_id()), "dup-classes")
    links, found = find_links(classes, docs, id_col, text_col)
    named = classes.select("set_hash", "rep", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = named.select("set_hash", "component").join(smallest, "component")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_hash").join(of_set, "set_hash", "left")
    rows = rows.withColumn("component_id", F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    rows = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = classes.select("node", "rep")
    named_links = (links.join(ids.toDF("a", "doc_a"), "a").join(ids.toDF("b", "doc_b"), "b").select("doc_a", "doc_b"))
    return rows, named_links


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays, the one with the smallest id (NULL last,
    then by the text's hash); rows without words all stay."""
    rows = written(near_dup_groups(docs, id_col, text_col)[0].filter("set_hash IS NOT NULL").select("doc_id", "text_hash", "component"), "dup-rows")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = rows.groupBy("component").agg(F.min(row).alias("best"))
    dropped = (rows.distinct().join(best, "component").filter(row != F.col("best"))
               .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    one_row = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    left = docs.join(hinted(dropped, MOST_BROADCAST), one_row, "left_anti")
    again = rows.groupBy("component", "doc_id", "text_hash").count().filter("count > 1")
    if not again.limit(1).count():
        return left
    # the row that stays occurs repeatedly: keep one of its copies
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    return left.filter(worded).dropDuplicates([id_col, text_col]).unionByName(left.filter(~worded))


def op8_near_dups(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, _ = near_dup_groups(docs)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")
