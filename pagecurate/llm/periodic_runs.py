"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of words with smallest period q (words q apart are
identical) of at least ``max(MIN_WORDS, MIN_TURNS * q)`` words that no
neighbouring word extends keeping the period.

On the diagonal of lag q a run is a row of matches ``w[i] = w[i - q]``. Going
through the words, the match length of every active lag grows by one per match;
a diagonal that ends with enough matches emits its run at once, and one that
ends early is forgotten. The DP is sparse in its lags: with ``size`` the power of two
in ``q / 2 < size <= q``, a lag q only opens at a word where the last earlier
occurrence of the ``size`` words from there on lies q words back. No run is lost: a
word sequence of smallest period q has more than q / 2 different factors of
``size`` words, so in every turn one of them occurs once, and its last occurrence lies
exactly one turn back. And no lag opens inside a run of a smaller period, since there
the last occurrence is nearer than ``size``, so the lag of an emitted run is its smallest
period. Occurrences of 1, 2, 4, ... words are named by doubling (the name of 2k
words is the pair of names of their halves), and words whose factor occurs once
in the text drop out, so a text of n words costs n log n at most, also when it
is one word repeated, where comparing every two occurrences would cost the square.

Texts are numbered in batches with disjoint numbers, so the lags of a batch
are found at once with numpy. Nothing is shuffled. Words are told apart by their
bytes.

Defined results: words are cut at blanks, unchanged; NULL and empty texts have no
words and no runs; rows are judged alone; an empty table gives no rows; ids may
repeat or be NULL.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.llm.common import small_batches

MIN_WORDS = 6
MIN_TURNS = 4
#: Words whose texts are numbered at once (a longer text is a batch of its own).
BATCH_WORDS = 250_000


def _stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The matches [start, end) around a match ``ids[at] = ids[at - lag]``, in
    steps that double."""
    end, step = at + 1, 32
    while end < len(ids):
        stop = min(end + step, len(ids))
        differ = np.flatnonzero(ids[end:stop] != ids[end - lag:stop - lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    start, step = at, 32
    while start > lag:
        stop = max(lag, start - step)
        differ = np.flatnonzero(ids[stop:start] != ids[stop - lag:start - lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def opened_lags(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) at which lags open, by place; of places in a row one."""
    at, names, size = np.arange(len(ids)), ids, 1
    places, lags = [], []
    while len(at) and MIN_TURNS * size <= longest:
        order = np.argsort(names, kind="stable")
        sorted_names = names[order]
        same = sorted_names[1:] == sorted_names[:-1]
        later, earlier = order[1:][same], order[:-1][same]
        lag = at[later] - at[earlier]
        opens = (lag >= size) & (lag < 2 * size)
        places.append(at[later[opens]])
        lags.append(lag[opens])
        # go on with the words from which `size` words occur again, as dense names
        again = np.zeros(len(at), bool)
        again[later] = again[earlier] = True
        dense = np.empty(len(at), np.int64)
        dense[order] = np.concatenate([[0], np.cumsum(~same)])
        at, dense = at[again], dense[again]
        half = np.minimum(np.searchsorted(at, at + size), max(0, len(at) - 1))
        whole = at[half] == at + size
        names, at = dense[whole] * (len(ids) + 1) + dense[half[whole]], at[whole]
        size *= 2
    none = np.empty(0, np.int64)
    place, lag = np.concatenate([none, *places]), np.concatenate([none, *lags])
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    first = np.ones(len(place), bool)
    first[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    order = np.argsort(place[first], kind="stable")
    return place[first][order], lag[first][order]


def periodic_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then
    period. ``longest``: most words of one of its texts (texts share no number)."""
    runs: list[tuple[int, int, int]] = []
    ends: dict[int, int] = {}  # where the last matches of each lag ended
    for at, lag in zip(*(a.tolist() for a in opened_lags(ids, len(ids) if longest is None else longest))):
        if ends.get(lag, 0) > at:
            continue  # these matches are known
        start, ends[lag] = _stretch(ids, at, lag)
        length = ends[lag] - start + lag
        if length >= max(MIN_WORDS, MIN_TURNS * lag):
            runs.append((start - lag, length, lag))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def batch_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, given as words."""
    ids, base, starts = [], 0, []
    for words in docs:
        known: dict[bytes, int] = {}
        starts.append(len(ids))
        ids += [known.setdefault(w, base + len(known)) for w in words]
        base += len(known)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    found = periodic_runs(np.array(ids, np.int64), max(map(len, docs), default=0))
    of = np.searchsorted(starts, [s for s, _, _ in found], "right") - 1 if found else []
    for d, (start, length, period) in zip(of, found):
        out[d].append((start - starts[d], length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first turn."""
    if not runs:
        return words
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, [s + p for s, _, p in runs], 1)
    np.add.at(turns, [s + n for s, n, _ in runs], -1)
    return [w for w, t in zip(words, np.cumsum(turns).tolist()) if not t]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, n_dropped long, collapsed_sha256 string, collapsed string"


def find_periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
                       reword: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, runs (by start, then period),
    n_dropped, collapsed_sha256, and ``collapsed`` where words were dropped (the
    kept words joined by one space; NULL means that all words stay, or that
    ``with_text`` is off). ``reword`` may change a row's words first."""
    batch_words = BATCH_WORDS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, held = [], [], 0

        def judged() -> pa.RecordBatch:
            kept = [(w, r, collapse(w, r)) for w, r in zip(docs, batch_runs(docs))]
            joined = [b" ".join(k) for _, _, k in kept]
            columns = [
                pa.array(ids, id_type), pa.array([len(w) for w, _, _ in kept], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs, _ in kept], _RUNS),
                pa.array([len(w) - len(k) for w, _, k in kept], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
                pa.array([j.decode() if with_text and len(k) < len(w) else None for (w, _, k), j in zip(kept, joined)], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "n_dropped", "collapsed_sha256", "collapsed"])

        for batch in small_batches(batches):
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                ids.append(doc_id)
                docs.append(reword(doc_id, words) if reword else words)
                held += len(words)
                if held >= batch_words:
                    yield judged()
                    ids, docs, held = [], [], 0
        if ids:
            yield judged()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(scan, _SCHEMA.format(id=rows.schema["_id"].dataType.simpleString()))


def lengthened(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the periods that the query's contract asks for: in a tenth
    of the documents the words from some place on repeat. A NULL id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * (-(-(n - a) // p)))[:n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_periodic_runs(docs, with_text=False, reword=lengthened)
    # greatest length / period by cross-multiplication; of equal ones the first in order stays
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (rows.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256"))


#: All pairs of equal words of a text, as rows of matches per lag (crc32 bit by bit).
OP12_SQL = r"""
WITH d0 AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d1 AS (
  SELECT *, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) END AS h FROM d0),
d2 AS (SELECT *, h // 10 AS g FROM d1),
d3 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM d2),
d4 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d3),
w AS (
  SELECT row, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT row, n, a, p, w, unnest(range(0, n)) AS i FROM d4)),
m AS (
  SELECT x.row, x.i, x.i - y.i AS lag FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
s AS (
  SELECT row, lag, min(i) - lag AS start, count(*) + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, lag ORDER BY i) AS stretch FROM m) GROUP BY row, lag, stretch),
c AS (SELECT * FROM s WHERE length >= greatest(6, 4 * lag)),
r AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c q WHERE q.row = c.row AND q.lag < c.lag AND q.start <= c.start AND q.start + q.length >= c.start + c.length)),
gone AS (
  SELECT DISTINCT row, i FROM (SELECT row, unnest(range(start + lag, start + length)) AS i FROM r)),
kept AS (
  SELECT w.row, string_agg(word, ' ' ORDER BY w.i) AS text FROM w LEFT JOIN gone g ON w.row = g.row AND w.i = g.i WHERE g.i IS NULL GROUP BY w.row),
t AS (
  SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', lag, chr(10)), '' ORDER BY start, lag) AS lines,
         first(struct_pack(start := start, length := length, lag := lag) ORDER BY length::DOUBLE / lag DESC, start, lag) AS best FROM r GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.lag::BIGINT AS period,
       (1000 * best.length // best.lag)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d0 LEFT JOIN t USING (row) LEFT JOIN kept USING (row)
"""
