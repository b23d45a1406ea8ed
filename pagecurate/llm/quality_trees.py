"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics. Each text gives ``STATISTICS``: shares of kinds of characters, of
words and of lines, and how much of it repeats. They are counted for all rows in
one pass over the texts and written as a narrow table.

Fit. Labelled rows outside the held-out ones are joined with their statistics; at
most ``MAX_LABELLED`` of them, chosen by hash, are learned from (a documented
sample; a few MB, so trees grow on the driver in numpy). Every statistic is cut
into at most ``BINS`` bins at quantiles. A tree of the boosted log-loss grows
level by level: one histogram of gradients per node, statistic and bin, and the
best cut of each node from its running sums.

Scoring. Trees are complete to ``DEPTH`` and flattened into three arrays (statistic
and last left bin of each inner node, value of each leaf): node ``i`` goes on to
``2 i + 1`` or ``2 i + 2``, and a node that was not cut sends everything to the
left. So all trees are walked at once by ``DEPTH`` gathers per batch of rows.

Defined results: NULL and empty texts have the statistics of an empty text and
get a score like any other; rows are judged alone; a NULL id is never labelled;
repeated label rows of an id count once, good if any is; label rows without id,
or with a value other than 0 and 1, are ignored; with labels of one kind only
every score is that label, without any it is 0.5; an empty table gives no rows;
existing columns of the output's names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecurate.llm.common import values, written

STATISTICS = ["words", "bytes", "word_bytes", "longest_word", "upper", "lower", "digits", "blanks", "symbols", "stops", "bangs", "quotes",
              "beyond_ascii", "top_byte", "distinct_words", "top_word", "same_as_before", "shouted", "capital", "unlettered", "long_words",
              "lines", "words_per_line", "repeated_lines", "ended_lines", "repeated_pairs"]
#: Labelled rows that are learned from.
MAX_LABELLED = 50_000
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.15
#: Least hessian of a leaf, and the penalty of its value.
LEAST_WEIGHT, PENALTY = 2.0, 1.0
THRESHOLD = 0.7

_ENDED = (b".", b"!", b"?", b":", b'"', b")")
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_KINDS = {"digits": b"0123456789", "blanks": b" \t\n\x0b\x0c\r", "symbols": b"#*$%&|<>{}[]~^=_\\/@+", "stops": b".,;:", "bangs": b"!?", "quotes": b"\"'()"}
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


# ---- statistics ------------------------------------------------------------

def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    data = (text or "").encode()
    words, raw = data.split(), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [s for line in data.split(b"\n") if (s := line.strip())]
    uses = Counter(words)
    n, size, n_lines = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    pairs = Counter(zip(words, words[1:]))
    shouted = sum(k for w, k in uses.items() if len(w) > 1 and w.isupper())
    capital = sum(k for w, k in uses.items() if w[:1].isupper())
    unlettered = sum(k for w, k in uses.items() if not _LETTER.search(w))
    long_words = sum(k for w, k in uses.items() if len(w) > 25)
    return [
        np.log1p(len(words)), np.log1p(len(data)), sum(map(len, words)) / n, np.log1p(max(map(len, uses), default=0)),
        raw[_UPPER].sum() / size, raw[_LOWER].sum() / size, *(raw[list(k)].sum() / size for k in _KINDS.values()), raw[128:].sum() / size,
        raw.max() / size, len(uses) / n, max(uses.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, shouted / n, capital / n,
        unlettered / n, long_words / n, np.log1p(len(lines)), len(words) / n_lines, (len(lines) - len(set(lines))) / n_lines,
        sum(line.endswith(_ENDED) for line in lines) / n_lines, sum(k for k in pairs.values() if k > 1) / n]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: pa.Array) -> pa.Array:
    return pa.array((statistics(t) for t in values(texts)), pa.list_(pa.float64()))


# ---- trees -----------------------------------------------------------------

def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Ascending cuts of each column: its quantiles, each value once, without the greatest."""
    edges = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges.append(cuts[cuts < column.max()])
    return edges


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds the values above cut b - 1 and up to cut b."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


def grow_tree(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistic, last left bin, leaf values, leaf of each row) of one tree."""
    n, width = bins.shape
    inner = (1 << DEPTH) - 1
    feature, last_left = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
    place = np.zeros(n, np.int64)  # node of each row, numbered within its level
    cell = np.arange(width) * BINS + bins
    for level in range(DEPTH):
        nodes = 1 << level
        at = (place[:, None] * (width * BINS) + cell).ravel()
        shape = (nodes, width, BINS)
        g = np.bincount(at, np.repeat(gradient, width), nodes * width * BINS).reshape(shape)
        h = np.bincount(at, np.repeat(hessian, width), nodes * width * BINS).reshape(shape)
        left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - all_g**2 / (all_h + PENALTY)
        gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, 0.0).reshape(nodes, -1)
        best = gain.argmax(axis=1)
        cut = gain[np.arange(nodes), best] > 1e-9
        own = slice(nodes - 1, 2 * nodes - 1)
        feature[own] = np.where(cut, best // BINS, 0)
        last_left[own] = np.where(cut, best % BINS, 255)
        node = nodes - 1 + place
        place = 2 * place + (bins[np.arange(n), feature[node]] > last_left[node])
    leaves = 1 << DEPTH
    value = -RATE * np.bincount(place, gradient, leaves) / (np.bincount(place, hessian, leaves) + PENALTY)
    return feature, last_left, value, place


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees of the log-loss of labels ``y`` (0 or 1), flattened."""
    model = {"edges": [np.empty(0)] * x.shape[1], "feature": np.zeros((0, (1 << DEPTH) - 1), np.int64),
             "last_left": np.zeros((0, (1 << DEPTH) - 1), np.int64), "value": np.zeros((0, 1 << DEPTH)), "start": 0.0}
    if not len(y) or y.min() == y.max():
        model["start"] = float(np.where(y[0], np.inf, -np.inf)) if len(y) else 0.0
        return model
    edges = bin_edges(x)
    bins = to_bins(x, edges)
    start = float(np.log(y.mean() / (1 - y.mean())))
    odds, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        feature, last_left, value, leaf = grow_tree(bins, p - y, p * (1 - p))
        odds += value[leaf]
        trees.append((feature, last_left, value))
    return {"edges": edges, "start": start} | {k: np.stack([t[i] for t in trees]) for i, k in enumerate(("feature", "last_left", "value"))}


def predict(model: dict, x: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Probability of label 1: all trees are walked at once."""
    out = np.empty(len(x))
    trees = np.arange(len(model["value"]))
    for a in range(0, len(x), rows):
        bins = to_bins(x[a:a + rows], model["edges"])
        row = np.arange(len(bins))[:, None]
        node = np.zeros((len(bins), len(trees)), np.int64)
        for _ in range(DEPTH if len(trees) else 0):
            node = 2 * node + 1 + (bins[row, model["feature"][trees, node]] > model["last_left"][trees, node])
        odds = model["start"] + model["value"][trees, node - ((1 << DEPTH) - 1)].sum(axis=1) if len(trees) else np.full(len(bins), model["start"])
        out[a:a + rows] = 1 / (1 + np.exp(-odds))
    return out


# ---- Spark -----------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a NULL id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(counted: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out ones, chosen by hash:
    (y, x). ``counted``: _id, _x."""
    usable = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).cast("int").alias("y")))
    rows = written(counted.join(usable, F.col("_id") == F.col("_labelled")).select("_id", "y", F.col("_x").alias("x")), "quality-labelled")
    n = rows.count()
    if n > most:  # rows with equal hashes stand or fall together, but for the last limit
        rows = rows.filter(F.pmod(F.xxhash64("_id", "x"), F.lit(1 << 30)) < int((1 << 30) * (most / n)))
    return rows.select("y", "x").limit(most)


def scored_udf(model: dict):
    @F.arrow_udf(T.DoubleType())
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(predict(model, x.flatten().to_numpy().reshape(-1, len(STATISTICS))))
    return scored


def score_quality_trees(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                        carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``held_out``, ``score``, ``predicted`` and ``statistics`` behind the columns
    ``carry`` (all by default; leave the text out where it is not needed, since
    the counted rows are written once)."""
    out = ["held_out", "score", "predicted", "statistics"]
    kept = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry) if c not in out]
    counted = written(docs.select(F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"), F.col(id_col).alias("_id"),
                                  text_statistics(F.col(text_col)).alias("_x")), "quality-statistics")
    sample = labelled_sample(counted.select("_id", "_x"), labels, id_col, label_col).toArrow()  # at most MAX_LABELLED rows
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y = sample.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the order in which rows arrive does not matter
    model = fit_trees(x[order], y[order])
    scored = counted.withColumn("_score", scored_udf(model)(F.col("_x")))
    return scored.select(*(["_row.*"] if kept else []), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_x").alias("statistics"))


def op11_quality_trees(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality_trees(docs, labels, carry=["doc_id"]).drop("statistics")
