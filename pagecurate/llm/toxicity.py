"""Toxicity by maximum-scoring segments.

Weights. A token is a run of letters and digits (A-Z in lower case). Its
features, the token and its first 4, 5 and 6 bytes, are hashed to ``BUCKETS``
buckets, which bounds the model. For each bucket the log-odds of toxic against clean labelled texts
carry a Dirichlet prior in proportion to the bucket's frequency in the whole
corpus; a feature counts once per text. The bucket counts when its z-score
reaches ``MIN_Z`` and its log-odds ``MIN_ODDS``. A token scores the log-odds
of its most significant toxic bucket, and ``-DRIFT`` without one.

Scan. All maximal scoring segments of a text are found in one pass, linear in
its tokens (runs of unmarked ones only add their length times the drift).

Calibration. Segment scores of clean text follow an extreme-value law: in n
tokens, ``K n exp(-lam S)`` segments reach the score S by chance, with ``lam``
the root of ``sum p_i exp(lam s_i) = 1`` over clean token scores and ``K`` from
the number of segments in clean labelled texts. A segment is a significant
toxic passage when that expectation is at most ``MAX_EXPECTED``. The
evidence of a text adds ``lam S - ln(K n)`` over its significant segments (or
takes the best one); an isotonic curve over the evidence of labelled texts
gives the probability.

Data flow. Labelled rows are a documented bounded sample (``MAX_LABELLED`` ids,
by hash), so they are broadcast to the texts; word counts run over all texts and
are summed per task, then per bucket. Texts are read twice, and never
shuffled.

Defined results: NULL or empty texts have no evidence and get the curve's value
there; rows are judged alone; repeated label rows of an id count once, toxic
if any is; label rows without id or value are ignored; without labelled toxic
and clean texts no bucket counts and every score is the prior, 0 for want of
labels; existing columns of the output's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecurate.llm.common import hinted, small_batches, values, written
from pagecurate.llm.hashing import token_features

BUCKETS = 1 << 20
MAX_LABELLED = 200_000
MOST_BROADCAST = 500_000
PREFIXES = (4, 5, 6)
#: Strength of the prior, as a share of the labelled word counts.
PRIOR_SHARE = 0.05
MIN_Z = 3.0
MIN_ODDS = 1.5
DRIFT = 0.25
MAX_EXPECTED = 0.01
#: Evidence of a text without any marked word.
NO_EVIDENCE = -30.0
MOST_EVIDENCE = 100.0


def token_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in UTF-8 bytes) of a text's tokens, and their buckets:
    a row for each token, -1 where it has no such prefix."""
    starts, ends, hashes = token_features((text or "").encode().lower(), PREFIXES)  # bytes.lower() changes A-Z only
    return starts, ends, np.where(hashes == 0, -1, (hashes % np.uint64(BUCKETS)).astype(np.int64))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a NULL id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fifth, chosen by
    hash of the id: (id, label)."""
    usable = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).cast("int").alias("_label")))
    n = usable.count()
    if n > most:
        usable = usable.filter(F.pmod(F.xxhash64("_labelled"), F.lit(1 << 30)) < int((1 << 30) * (most / n)))
    return written(usable.limit(most), "toxic-labels")


# ---- weights ---------------------------------------------------------------

def count_buckets(labelled: DataFrame) -> DataFrame:
    """(bucket, n_all, n_toxic, n_clean) over all texts. ``labelled``: text, _label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS), np.int64)
        place = np.empty(BUCKETS, np.int64)
        for batch in small_batches(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                used = token_buckets(text)[2].reshape(-1)
                used = used[used >= 0]
                order = np.arange(len(used))
                place[used] = order
                once = used[place[used] == order]  # each bucket of the text once
                sums[0, once] += 1
                if label is not None:
                    sums[2 - label, once] += 1
        used = np.flatnonzero(sums[0])
        for part in np.array_split(used, max(1, len(used) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(s[part]) for s in sums)],
                                             names=["bucket", "n_all", "n_toxic", "n_clean"])

    schema = "bucket long, n_all long, n_toxic long, n_clean long"
    return (labelled.mapInArrow(count, schema).groupBy("bucket")
            .agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_clean")]))


def fit_weights(counts: DataFrame) -> dict:
    """Log-odds of the buckets that count, and the constants of the scan."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_all", "n_toxic", "n_clean")]).first()
    model = {"weights": {}, "lam": 1.0, "clean_tokens": float(total["n_clean"])}
    if not (total["n_toxic"] and total["n_clean"]):
        return model
    strength = PRIOR_SHARE * (total["n_toxic"] + total["n_clean"])
    prior = F.lit(strength) * F.col("n_all") / float(total["n_all"])
    t, c = F.col("n_toxic") + prior, F.col("n_clean") + prior
    odds = F.log(t / (total["n_toxic"] + strength - t)) - F.log(c / (total["n_clean"] + strength - c))
    chosen = counts.filter("n_toxic > 0").withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / c))
    # at most BUCKETS rows
    rows = chosen.filter((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).select("bucket", "odds", "z", "n_clean").collect()
    model["weights"] = {r["bucket"]: (float(r["odds"]), float(r["z"])) for r in rows}
    scores = np.array([r["odds"] for r in rows])
    p = np.array([r["n_clean"] + 0.5 for r in rows]) / (total["n_clean"] + 1.0)

    def excess(lam: float) -> float:
        return float(p @ np.exp(lam * scores) + max(0.0, 1 - p.sum()) * math.exp(-lam * DRIFT) - 1)

    if rows:
        low, high = 1e-6, 1e-3
        while excess(high) < 0 and high < 50:
            high *= 1.5
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        model["lam"] = high
    return model


# ---- scan ------------------------------------------------------------------

def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in one
    pass (Ruzzo and Tompa's rule, on cumulative sums at the positive scores)."""
    ends = np.cumsum(scores, dtype=float)
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        after = float(ends[i])
        start, before = i, after - float(scores[i])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, before, after))
    return [(s, e, r - b) for s, e, b, r in stack]


SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("score", T.DoubleType())]))
_SCAN = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("segments", SEGMENTS)])
_ARROW_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan_udf(weights: dict[int, tuple[float, float]]):
    """Column function: text -> (n_tokens, segments); segments in code points."""
    marked = np.array(sorted(weights), np.int64)
    pairs = np.array([weights[b] for b in marked.tolist()], float).reshape(-1, 2)

    @F.arrow_udf(_SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        odds, z = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last entry is for -1
        odds[marked], z[marked] = pairs[:, 0], pairs[:, 1]
        n, found = [], []
        for text in values(texts):
            starts, ends, buckets = token_buckets(text)
            n.append(len(starts))
            found.append([])
            strength = z[buckets]
            if len(starts) and strength.any():
                best = buckets[np.arange(len(starts)), strength.argmax(axis=1)]
                scores = np.where(strength.max(axis=1) > 0, odds[best], -DRIFT)
                raw = np.frombuffer(text.encode(), np.uint8)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                found[-1] = [{"start": int(chars[starts[s]]), "end": int(chars[ends[e - 1]]), "score": v}
                             for s, e, v in maximal_segments(scores)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(found, _ARROW_SEGMENTS)], names=["n_tokens", "segments"])

    return scan


# ---- calibration -----------------------------------------------------------

def _normal_score(model: dict, score: Column, n_tokens: Column) -> Column:
    """lam S - ln(K n): minus the log of the number of such segments expected by chance."""
    return F.lit(model["lam"]) * score - F.log(F.lit(model["k"]) * F.greatest(n_tokens, F.lit(1)))


def _evidence(model: dict) -> Column:
    normal = F.transform("segments", lambda s: _normal_score(model, s["score"], F.col("n_tokens")))
    least = F.lit(-math.log(MAX_EXPECTED))
    summed = F.aggregate(F.filter(normal, lambda v: v >= least), F.lit(0.0), lambda a, v: a + v)
    best = F.coalesce(F.array_max(normal), F.lit(NO_EVIDENCE))
    return F.least(F.greatest(F.when(best >= least, summed).otherwise(best), F.lit(NO_EVIDENCE)), F.lit(MOST_EVIDENCE))


def fit_curve(bins: list[tuple[float, int, int]]) -> dict[float, float]:
    """Probability of every tenth of evidence, from (evidence, label, rows):
    isotonic regression (pooled neighbours), with half a row of each label
    added per pool, joined by straight lines between the pools' means."""
    grid = np.round(np.arange(round(NO_EVIDENCE * 10), round(MOST_EVIDENCE * 10) + 1) / 10, 1)
    if not bins:
        return dict.fromkeys(grid.tolist(), 0.0)
    cells: dict[float, np.ndarray] = {}
    for e, label, n in bins:
        cells.setdefault(e, np.zeros(3))
        cells[e] += np.array([n, n * label, n * e])
    pools: list[np.ndarray] = []
    for e in sorted(cells):
        pools.append(cells[e].copy())
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] += last
    x = [p[2] / p[0] for p in pools]
    y = np.maximum.accumulate([(p[1] + 0.5) / (p[0] + 1) for p in pools])
    # beyond the outer pools the curve runs on to 0 and 1, so that ranks stay told apart
    x = [NO_EVIDENCE - 1, *x, MOST_EVIDENCE + 1]
    y = [y[0] * 0.999, *y, 1 - (1 - y[-1]) * 0.5]
    return dict(zip(grid.tolist(), np.interp(grid, x, y).tolist()))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None) -> DataFrame:
    """Append n_tokens, ``passages`` (significant toxic passages: start and
    end in code points, score, expected by chance), evidence, held_out, score and predicted
    behind the columns ``carry`` (all by default)."""
    out = ["n_tokens", "passages", "evidence", "held_out", "score", "predicted"]
    # the carried columns travel in one, so that none clashes with a helper
    keep = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry) if c not in out]
    sample = F.broadcast(labelled_sample(labels, id_col))  # at most MAX_LABELLED rows
    packed = docs.select((F.struct(*keep) if keep else F.lit(None)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = packed.join(sample, F.col("_id") == F.col("_labelled"), "left").drop("_labelled")
    counts = written(count_buckets(marked.select("_text", "_label")), "toxic-counts")
    model = fit_weights(counts)
    scanned = written(marked.withColumn("_held", held_out(F.col("_id")))
                      .withColumn("_scan", scan_udf(model["weights"])(F.col("_text")))
                      .select("_row", "_held", "_label", "_scan.*"), "toxic-segments")
    clean = scanned.filter("_label = 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"),
                                             F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("m")).first()
    least = min((w for w, _ in model["weights"].values()), default=0.0)
    model["k"] = (clean["m"] + 1) * math.exp(model["lam"] * least) / max(1, clean["n"])
    scored = scanned.withColumn("evidence", _evidence(model))
    tenth = F.round(F.col("evidence") * 10).cast("int")  # at most 1,301 values
    bins = scored.filter("_label IS NOT NULL").groupBy(tenth.alias("e"), "_label").count().collect()
    curve = fit_curve([(r["e"] / 10, r["_label"], r["count"]) for r in bins])
    table = F.broadcast(docs.sparkSession.createDataFrame([(round(e * 10), p) for e, p in curve.items()], "_tenth int, score double"))
    expected = F.transform("segments", lambda s: F.struct(s["start"], s["end"], s["score"],
                                                          F.exp(-_normal_score(model, s["score"], F.col("n_tokens"))).alias("expected")))
    return (scored.join(table, tenth == F.col("_tenth")).withColumn("passages", F.filter(expected, lambda s: s["expected"] <= MAX_EXPECTED))
            .withColumn("held_out", F.col("_held"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*(["_row.*"] if keep else []), *out))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``docs``."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    scored = score_toxicity(keyed, labels.select(F.col(id_col).alias("_id"), "toxic"), "_id", "_text", ["_id", "_hash"])
    toxic = scored.filter("predicted = 1").select("_id", "_hash").distinct()
    same_row = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    return docs.join(hinted(toxic, MOST_BROADCAST), same_row, "left_anti")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, carry=["doc_id"]).select("doc_id", "held_out", "score", "predicted", "evidence", "n_tokens", "passages")
