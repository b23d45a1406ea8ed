"""op3: segments against brute force, weights against a direct count, held-out accuracy."""
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagecurate.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def brute_segments(s):
    """Ruzzo-Tompa's definition: take the best segment (shortest on ties), then both rests."""
    def rec(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(s[i:j])
                if v > 0 and (best is None or v > best[2] or v == best[2] and j - i < best[1] - best[0]):
                    best = (i, j, v)
        if best is None:
            return []
        return rec(lo, best[0]) + [best] + rec(best[1], hi)
    return rec(0, len(s))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-0.25, -0.25, -0.25, 1.0, 2.5, 0.125]), max_size=14))
def test_maximal_segments_are_the_best_ones(s):
    got = tx.maximal_segments(np.array(s, float))
    want = brute_segments(s)
    assert math.isclose(max([v for *_, v in got], default=0), max([v for *_, v in want], default=0))
    assert math.isclose(sum(v for *_, v in got), sum(v for *_, v in want), abs_tol=1e-9)
    assert all(math.isclose(sum(s[a:b]), v, abs_tol=1e-9) for a, b, v in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_bucket_counts(spark):
    rows = [("Bad, bad word", 1), ("good word", 0), ("word word", None), (None, 1), ("", 0)]
    got = {r.bucket: (r.n_all, r.n_toxic, r.n_clean) for r in
           tx.count_buckets(spark.createDataFrame(rows, "text string, _label int").repartition(2)).collect()}
    want = {}
    for text, label in rows:
        for b in set(tx.token_buckets(text)[2].reshape(-1).tolist()) - {-1}:
            a = want.setdefault(b, [0, 0, 0])
            a[0] += 1
            if label is not None:
                a[2 - label] += 1
    assert got == {b: tuple(v) for b, v in want.items()}


def test_token_features():
    text = "Ünder Understand, UNDER-9 a"
    starts, ends, buckets = tx.token_buckets(text)
    raw = text.encode()
    assert [raw[s:e].decode() for s, e in zip(starts, ends)] == ["Ünder", "Understand", "UNDER", "9", "a"]
    assert buckets[2, 0] == tx.token_buckets("under")[2][0, 0] and buckets[2, 2] == buckets[1, 2] and buckets[1, 0] != buckets[2, 0]
    assert (buckets[2] >= 0).tolist() == [True, True, True, False] and (buckets[3] >= 0).tolist() == [True, False, False, False]
    assert buckets[1, 3] == tx.token_buckets("unders")[2][0, 3]


def test_weights_follow_the_formula(spark):
    counts = [(1, 400, 60, 0), (2, 4000, 100, 900), (3, 5000, 110, 1200)]
    model = tx.fit_weights(spark.createDataFrame(counts, "bucket long, n_all long, n_toxic long, n_clean long"))
    nt, nc, na = 270, 2100, 9400
    s = tx.PRIOR_SHARE * (nt + nc)
    a = s * 400 / na
    odds = math.log((60 + a) / (nt + s - 60 - a)) - math.log(a / (nc + s - a))
    assert set(model["weights"]) == {1}
    assert model["weights"][1] == pytest.approx((odds, odds / math.sqrt(1 / (60 + a) + 1 / a)))
    p = 0.5 / (nc + 1)
    assert p * math.exp(model["lam"] * odds) + (1 - p) * math.exp(-model["lam"] * tx.DRIFT) == pytest.approx(1, abs=1e-6)


def test_curve_is_isotonic():
    curve = tx.fit_curve([(-30.0, 0, 90), (-30.0, 1, 2), (5.0, 1, 3), (5.0, 0, 4), (6.0, 0, 3), (6.0, 1, 2), (40.0, 1, 50)])
    values = [curve[k] for k in sorted(curve)]
    assert len(values) == 1301 and all(x <= y for x, y in zip(values, values[1:]))
    assert 0 < curve[-30.0] < 0.05 and curve[40.0] > 0.9 and values[0] >= 0 and values[-1] <= 1
    assert set(tx.fit_curve([]).values()) == {0.0}


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = tx.op3_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    clean = [p for y, p in held if y == 0]
    assert sum(clean) <= 0.02 * len(clean) + 1
    assert sum(y == p for y, p in held) >= 0.9 * len(held)


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out(tx.F.col("doc_id")), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    a = {r.doc_id: r.score for r in tx.score_toxicity(docs, labels, carry=["doc_id"]).collect()}
    b = {r.doc_id: r.score for r in tx.score_toxicity(docs, flipped, carry=["doc_id"]).collect()}
    assert a == b


def test_edge_rows(spark):
    tox, ok = "you utter scumbag fool " * 3, "a calm and quiet day near the lake "
    rows = [(i, tox + ok * 3 if i % 3 == 0 else ok * 4) for i in range(200)]
    rows += [(None, tox), (900, None), (901, ""), (902, tox), (902, tox), (903, ok * 50_000 + tox)]
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, score string, n_tokens int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(3, 0), (None, 1), (901, None)], "doc_id long, toxic int")
    got = tx.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].predicted == 1 and [r.predicted for r in by[902]] == [1, 1]
    assert by[900][0].predicted == by[901][0].predicted == 0 and by[900][0].n_tokens == 0
    last = by[903][0].passages[-1]
    assert last.start >= len(ok) * 50_000 and last.end <= len(ok) * 50_000 + len(tox) and last.expected <= tx.MAX_EXPECTED
    kept = tx.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and kept.filter("doc_id = 902").count() == 0
    assert tx.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in tx.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_label_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    n = tx.labelled_sample(labels, most=500).count()
    assert 400 <= n <= 500
