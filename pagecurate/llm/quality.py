"""Quality rules combined by weak supervision.

Each rule reads a document's counts and votes ``+`` (good), ``-`` (bad) or
abstains (``0``). How far a rule can be trusted is not set by hand: expectation
maximisation over the votes of all documents estimates, per rule, how often it
is right on good and on bad documents, and the share of good documents. A
document is kept when the posterior probability that it is good, given its
votes, reaches a threshold; it need not pass every rule.

Documents with the same votes have the same posterior, so EM needs only the
number of documents per vote pattern and base verdict: at most twice
``3 ** rules`` rows, which is all that the driver sees, from one aggregation
over all documents.

Two base rules are absolute: fewer than 50 words, or more than half of the
words inside repeated three-word windows.

Defined results: NULL and empty texts have no words and fail the base; rows
are judged alone; an empty table gives no rows; existing columns of the
output's names are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecurate.llm.common import values, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_plain", "n_marked", "n_ended"]
_COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SYMBOL_BYTES = re.compile(rb"[#*$%&|<>]")
_ENDED = (b".", b"!", b"?", b":", b'"', b")")
_TRIM = b".,;:!?\"'()"


def _repeat_words(ids: np.ndarray, n_ids: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * n_ids + ids[1:]
    if n_ids > 2_000_000:  # the pair times n_ids would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n_ids + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def count_text(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    data = text.encode()
    words = data.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    uses = np.bincount(ids, minlength=len(known))
    plain = int(uses @ np.fromiter((w.strip(_TRIM).decode().isalpha() for w in known), np.int64, len(known)))
    marked = int(uses @ np.fromiter((_SYMBOL_BYTES.search(w) is not None for w in known), np.int64, len(known)))
    return (len(words), sum(map(len, _BLANK.split(text))), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)),
            _repeat_words(ids, len(known)), len(lines), len(known), plain, marked, sum(line.rstrip().endswith(_ENDED) for line in lines))


@F.arrow_udf(_COUNTS_TYPE)
def text_counts(texts: pa.Array) -> pa.Array:
    rows = np.array([count_text(t or "") for t in values(texts)], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=COUNTS)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, "-").when(good, "+").otherwise("0")


def rules() -> dict[str, Column]:
    """Votes over the columns of COUNTS. Between its two bounds a rule abstains."""
    return {
        "length": _vote(F.col("n_words") >= 120, F.col("n_words") < 50),
        "symbols": _vote(_share("n_symbols", "n_words") <= 0.01, _share("n_symbols", "n_words") > 0.1),
        "repetition": _vote(_share("n_repeat_words", "n_words") <= 0.1, _share("n_repeat_words", "n_words") > 0.3),
        "duplicate_lines": _vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), _share("n_dup_lines", "n_lines") > 0.5),
        "word_length": _vote(_share("word_chars", "n_words").between(3, 9), ~_share("word_chars", "n_words").between(2, 14)),
        "plain_words": _vote(_share("n_plain", "n_words") >= 0.8, _share("n_plain", "n_words") < 0.6),
        "marked_words": _vote(_share("n_marked", "n_words") <= 0.02, _share("n_marked", "n_words") > 0.2),
        "variety": _vote(_share("n_distinct", "n_words") >= 0.3, _share("n_distinct", "n_words") < 0.1),
        "ended_lines": _vote(_share("n_ended", "n_lines") >= 0.7, _share("n_ended", "n_lines") < 0.2),
    }


def fit_rules(patterns: list[tuple[str, bool, int]], rounds: int = 200, tol: float = 1e-9) -> dict:
    """EM over (votes, base failed, documents). Documents that fail the base
    are known to be bad, which fixes what the second class means; for the
    others the class is estimated. A rule's two accuracies (on good, on bad
    documents) have a Beta prior that expects it to be right more often than
    not, and a rule does not count as an accuracy what it abstains from."""
    if not patterns:
        return {"good": 0.5, "right_good": [], "right_bad": []}
    patterns = sorted(patterns)
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in p] for p, _, _ in patterns])
    failed = np.array([f for _, f, _ in patterns])
    n = np.array([k for _, _, k in patterns], float)
    right, wrong = 0.02 * n.sum() + 4, 0.002 * n.sum() + 1
    up, down = votes > 0, votes < 0
    q = np.where(failed, 0.0, np.clip((votes.sum(1) > 0) * 0.9 + 0.05, 0.05, 0.95))
    last = -np.inf
    for _ in range(rounds):
        g, b = n * q, n * (1 - q)
        good = (g.sum() + 2) / (n.sum() + 4)
        right_good = (g @ up + right) / (g @ (up | down) + right + wrong)
        right_bad = (b @ down + right) / (b @ (up | down) + right + wrong)
        lg = np.log(good) + up @ np.log(right_good) + down @ np.log1p(-right_good)
        lb = np.log1p(-good) + down @ np.log(right_bad) + up @ np.log1p(-right_bad)
        total = np.where(failed, lb, np.logaddexp(lg, lb))
        q = np.where(failed, 0.0, np.exp(lg - total))
        if abs(n @ total - last) < tol * abs(n @ total):
            break
        last = n @ total
    return {"good": good, "right_good": right_good, "right_bad": right_bad}


def posterior(pattern: str, model: dict) -> float:
    """Probability that a document with these votes is good."""
    lg, lb = np.log(model["good"]), np.log1p(-model["good"])
    for v, rg, rb in zip(pattern, model["right_good"], model["right_bad"]):
        if v == "+":
            lg, lb = lg + np.log(rg), lb + np.log1p(-rb)
        elif v == "-":
            lg, lb = lg + np.log1p(-rg), lb + np.log(rb)
    return float(1 / (1 + np.exp(lb - lg)))


def score_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Counts, ``votes``, ``quality`` (posterior), ``base_failed`` and ``kept``
    behind the columns ``carry`` (all by default; leave the text out where it
    is not needed, since the counted rows are written once)."""
    out = [*COUNTS, "votes", "base_failed", "quality", "kept"]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in out]
    counted = docs.withColumn("_counts", text_counts(F.col(text_col))).select(*keep, "_counts.*")
    counted = counted.withColumn("votes", F.concat(*rules().values()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = written(counted.withColumn("base_failed", failed), "quality-counts")
    patterns = [tuple(r) for r in counted.groupBy("votes", "base_failed").agg(F.count("*").alias("n")).collect()]
    model = fit_rules(patterns)
    table = docs.sparkSession.createDataFrame([(p, posterior(p, model)) for p in sorted({p for p, _, _ in patterns})],
                                              "votes string, quality double")
    scored = counted.join(F.broadcast(table), "votes")  # at most 3 ** rules rows
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return scored.withColumn("kept", kept).select(*keep, *out)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with the columns of ``docs`` as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return score_quality(docs.select(row, F.col(text_col).alias("text")), "text", threshold, ["_row"]).filter("kept").select("_row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, carry=["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")
