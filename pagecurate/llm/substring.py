"""Substring dedup with an FM-index per shard.

A window is ``WINDOW`` consecutive words of one document (words cut at blanks,
unchanged). Every word that lies in a window whose word sequence also starts
anywhere else in the corpus is removed, judged on the input.

Routing. Equal windows must meet in one shard, and a document must not be
streamed against the whole corpus. So each window is represented by the
smallest hash among its ``GRAM``-word runs (its anchor): equal windows have equal
anchors, and a text has about one anchor in 15 words. Anchors that occur once
in the corpus settle all their windows. For the others the words that their
windows can cover (``WINDOW`` to both sides of the run) are sent to the
anchor's shard.

Shards. A shard joins the pieces it got, each place of a document once, builds
a compressed FM-index over the word numbers (Burrows-Wheeler transform in a
wavelet matrix) and streams the pieces through it from right to left: backward
search gives the matching statistics, and runs of at least ``WINDOW`` words that
occur twice are reported. A task takes its anchors in order and closes a shard
at ``SHARD_WORDS``, so its memory does not grow with the input.

Hot groups. Documents with the same words are one class; if it has several
members all their windows are repeated, and one member stands for the class
elsewhere. An anchor with more than ``HOT`` places is split by content: its
windows are counted by a 128-bit hash of their text with map-side aggregation.

Hashes of words only route: a shard gets the words themselves and numbers
them anew, so words that share a hash are told apart. Defined results: NULL and empty texts have
no words; texts of fewer than ``WINDOW`` words keep all; repeated rows are
places of their own, so they remove each other; ids may repeat or be NULL; an
empty table gives no rows; extra columns are ignored; ids are cast to long, and
one that is not a number fails the job.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.llm.common import hinted, small_batches, written
from pagecurate.llm.fmindex import FMIndex, repeated_runs
from pagecurate.llm.hashing import window_hashes, word_hashes

WINDOW = 35
GRAM = 8
#: Words that one FM-index holds.
SHARD_WORDS = 500_000
#: Places of an anchor beyond which it is split by content. So many pieces hold
#: two million words, some 200 MB while their index is built.
HOT = 32_768
#: Longest piece that is streamed at once; pieces overlap by WINDOW - 1 words.
PIECE = 256
MOST_BROADCAST = 500_000
#: Places or runs (some 24 bytes each) that a join with the texts may broadcast.
MOST_PLACES = 2_000_000
_TWO_LONGS = struct.Struct("<qq")


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each run of ``width`` values, in log2(width) steps."""
    k = 1
    while 2 * k <= width:
        a = op(a[:-k], a[k:])
        k *= 2
    return op(a[:-(width - k)], a[width - k:]) if width > k else a


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the runs that are smallest in some window."""
    if len(words) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = window_hashes(words, GRAM)
    span = WINDOW - GRAM + 1
    least = np.zeros(len(grams) + span - 1, np.uint64)
    low = _slide(grams, span, np.minimum)
    least[span - 1:span - 1 + len(low)] = low
    places = np.flatnonzero(_slide(least, span, np.maximum) == grams)
    same = grams[places[1:]] == grams[places[:-1]]
    if same.any():
        places = places[_thinned(places, same, span)]
    return grams[places], places


def _thinned(places: np.ndarray, same: np.ndarray, span: int) -> np.ndarray:
    """Of places with one hash in a row (repeated words), as many as it takes
    that every window over one of them still holds one: places that are kept lie
    at most ``span`` apart. Equal windows need the same hash, not the same place."""
    keep, last = [True], int(places[0])
    after = [*same.tolist()[1:], False]
    for i, (equal, next_equal) in enumerate(zip(same.tolist(), after), 1):
        inner = equal and next_equal and places[i + 1] - last <= span
        keep.append(not inner)
        if not inner:
            last = int(places[i])
    return np.array(keep)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _list_column(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, words_hash, all_sha256, anchors, places of each row."""
    for batch in small_batches(batches):
        n, names, shas, hashes, places = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            data = (text or "").encode()
            words = data.split()
            joined = b" ".join(words)
            n.append(len(words))
            names.append(hashlib.blake2b(joined, digest_size=16).digest())
            shas.append(hashlib.sha256(joined).hexdigest())
            h, p = anchors(word_hashes(data) if len(words) >= WINDOW else np.empty(0, np.uint64))
            hashes.append(h.view(np.int64))
            places.append(p.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(shas),
                                          _list_column(hashes, pa.int64()), _list_column(places, pa.int32())],
                                         names=["doc_id", "n_words", "words_hash", "all_sha256", "anchors", "places"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces around the anchors of a class: route, node, start, words
    (joined by one space). Windows of hot anchors go out one by one, as the two
    halves of a 128-bit hash."""
    for batch in small_batches(batches):
        columns = {name: batch.column(name).to_pylist() for name in ("node", "words_hash", "text", "found")}
        rows: dict[str, list] = {c: [] for c in ("route", "second", "node", "start", "words")}
        for node, name, text, found in zip(*columns.values()):
            words = text.encode().split()
            joined = b" ".join(words)
            if hashlib.blake2b(joined, digest_size=16).digest() != name:
                continue
            n = len(words)
            at_byte = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)]).tolist()
            hot = set()
            for f in found:
                at = f["place"]
                if f["hot"]:
                    hot.update(range(max(0, at + GRAM - WINDOW), min(at, n - WINDOW) + 1))
                    continue
                a, b = max(0, at + GRAM - WINDOW), min(n, at + WINDOW)
                for key, v in zip(rows, (f["anchor"], None, node, a, joined[at_byte[a]:at_byte[b] - 1])):
                    rows[key].append(v)
            for s in sorted(hot):
                name = hashlib.blake2b(joined[at_byte[s]:at_byte[s + WINDOW] - 1], digest_size=16).digest()
                for key, v in zip(rows, (*_TWO_LONGS.unpack(name), node, s, None)):
                    rows[key].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["route"], pa.int64()), pa.array(rows["second"], pa.int64()), pa.array(rows["node"], pa.int64()),
             pa.array(rows["start"], pa.int32()), pa.array(rows["words"], pa.binary())], names=list(rows))


def shard_runs(nodes: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end) of the repeated runs of one shard."""
    order = np.lexsort((starts, nodes))
    parts, homes, here = [], [], 0  # homes: (node, start in the document, place in the text, length)
    known: dict[bytes, int] = {}
    last_node, last_end = None, 0
    for i in order.tolist():
        node, start = int(nodes[i]), int(starts[i])
        words = pieces[i].split(b" ")
        end = start + len(words)
        if node == last_node and start <= last_end:
            words = words[last_end - start:]
            if not words:
                continue
            homes[-1][3] += len(words)
        else:
            if parts:
                parts.append([0])  # a separator
                here += 1
            homes.append([node, start, here, len(words)])
        parts.append([known.setdefault(w, len(known) + 1) for w in words])
        here += len(words)
        last_node, last_end = node, end
    text = np.fromiter(chain.from_iterable(parts), np.int64, here)
    home = np.array(homes, np.int64)
    # long runs are streamed in pieces that overlap by a window less one
    step = PIECE - WINDOW + 1
    count = np.maximum(1, -(-(home[:, 3] - WINDOW + 1) // step))
    of = np.repeat(np.arange(len(home)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = home[of, 2] + nth * step
    end = np.minimum(begin + PIECE, home[of, 2] + home[of, 3])
    a, b = repeated_runs(FMIndex(text, len(known) + 1), text, begin, end, WINDOW)
    own = np.searchsorted(home[:, 2], a, "right") - 1
    shift = home[own, 1] - home[own, 2]
    return home[own, 0], a + shift, b + shift


def _indexer(shard_words: int):
    """Task over rows sorted by route; closes a shard at a route's end once it
    holds so many words."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, starts, pieces, held = None, [], [], [], 0

        def close() -> pa.RecordBatch:
            node, a, b = shard_runs(np.array(nodes), np.array(starts), pieces)
            nodes.clear(), starts.clear(), pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                                              names=["node", "start", "end"])

        for batch in batches:
            for route, node, start, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held >= shard_words and route != last:
                    yield close()
                    held = 0
                last = route
                nodes.append(node)
                starts.append(start)
                pieces.append(piece)
                held += piece.count(b" ") + 1
        if pieces:
            yield close()

    return index


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n_removed, kept_sha256, kept_text of the classes with repeated runs."""
    for batch in small_batches(batches):
        out = [], [], [], []
        for node, name, text, runs in zip(*(batch.column(c).to_pylist() for c in ("node", "words_hash", "text", "runs"))):
            words = text.encode().split()
            if hashlib.blake2b(b" ".join(words), digest_size=16).digest() != name:
                continue
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, [r["start"] for r in runs], 1)
            np.add.at(gone, [r["end"] for r in runs], -1)
            kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            for column, v in zip(out, (node, len(words) - len(kept), _digest(kept), b" ".join(kept).decode())):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                                          pa.array(out[3], pa.string())], names=["node", "n_removed", "kept_sha256", "kept_text"])


def _repeated_runs(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, start, end) of the repeated runs of the classes (node, rep, words_hash, anchors, places)."""
    at = classes.select("node", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("node", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    often = written(at.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")), "sub-anchors")
    places = written(at.join(hinted(often, MOST_BROADCAST), "anchor"), "sub-places")
    found = places.groupBy("node").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("found"))
    # a class is searched in one of its texts; the hash of its words is checked there
    rows = _of_classes(texts, classes, found, places)
    pieces = written(rows.mapInArrow(_cut, "route long, second long, node long, start int, words binary"), "sub-pieces")
    whole = pieces.filter("words IS NOT NULL").select("route", "node", "start", "words")
    runs = whole.repartition("route").sortWithinPartitions("route").mapInArrow(_indexer(SHARD_WORDS), "node long, start int, end int")
    single = pieces.filter("words IS NULL").select("route", "second", "node", "start").distinct()
    twice = single.groupBy("route", "second").count().filter("count > 1").drop("count")
    runs = runs.unionByName(single.join(twice, ["route", "second"]).select("node", "start", (F.col("start") + WINDOW).alias("end")))
    return written(runs.distinct(), "sub-runs")


def _of_classes(texts: DataFrame, classes: DataFrame, per_node: DataFrame, entries: DataFrame) -> DataFrame:
    """The texts of some classes, with what is known of each: ``per_node``, the
    lists of ``entries``. Broadcast when the entries are few enough."""
    keyed = written(per_node.join(classes.select("node", "rep", "words_hash"), "node"), "sub-nodes")
    few = entries.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    # rows without text may share an id with a class
    return texts.filter("text IS NOT NULL").join(F.broadcast(keyed) if few else keyed, F.col("id").eqNullSafe(F.col("rep"))).drop("id", "rep")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256, and
    kept_text where words were removed (the kept words joined by one space;
    NULL means that all words stay)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign, "doc_id long, n_words long, words_hash binary, all_sha256 string, anchors array<long>, places array<int>"), "sub-rows")
    classes = written(signed.filter(F.col("n_words") >= WINDOW).groupBy("words_hash")
                      .agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("anchors").alias("anchors"), F.first("places").alias("places"))
                      .withColumn("node", F.monotonically_increasing_id()), "sub-classes")
    runs = _repeated_runs(classes, texts)
    alone = classes.filter("copies = 1")
    per_node = runs.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    changed = _of_classes(texts, alone, per_node, runs).mapInArrow(_remove, "node long, n_removed long, kept_sha256 string, kept_text string")
    known = classes.select("words_hash", "copies", "node").join(changed, "node", "left").drop("node")
    rows = signed.select("doc_id", "n_words", "words_hash", "all_sha256").join(known, "words_hash", "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    return rows.select("doc_id", "n_words",
                       F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(copied, F.lit(_digest([]))).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
                       F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).drop("kept_text")
