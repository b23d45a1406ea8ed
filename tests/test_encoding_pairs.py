"""J1 encoding by rows, F5 walk against a plain loop."""
import random
import re

import pytest
from pyspark.sql import functions as F

from pagecurate.operators import setops
from pagecurate.plans.features import build_vocabulary, encode_text, tokenize


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


@pytest.mark.parametrize("broadcast_tokens", [1_000_000, 3])
def test_encoding_of_repeated_and_null_ids(spark, broadcast_tokens):
    r = random.Random(2)
    vocab_words = ["a", "b", "c", "dé", "e", "f", "g"]
    rows = [(r.choice([1, 2, None]), " ".join(r.choices([*vocab_words, "unseen"], k=r.randint(0, 12)))) for _ in range(60)]
    rows += [(1, None), (None, ""), (2, "a b"), (2, "a b"), (2, "c")]
    df = spark.createDataFrame(rows, "id LONG, text STRING").repartition(4)
    vocab = spark.createDataFrame([(w, i, 4 + i) for i, w in enumerate(vocab_words)], "token STRING, n LONG, token_id LONG")
    ids = {w: 4 + i for i, w in enumerate(vocab_words)}
    want = []
    for i, t in rows:
        body = [2, *(ids.get(w, 1) for w in words(t)[:6]), 3]
        want.append((i, body + [0] * (8 - len(body)), [1] * len(body) + [0] * (8 - len(body))))
    got = encode_text(df, "id", "text", vocab, max_len=8, broadcast_tokens=broadcast_tokens)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert encode_text(df.limit(0), "id", "text", vocab, max_len=8, broadcast_tokens=broadcast_tokens).count() == 0


def test_encoding_moves_no_row(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "id LONG, text STRING")
    got = encode_text(df, "id", "text", build_vocabulary(df, "text"), max_len=8)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert df.select(tokenize("text").alias("t")).first().t == ["a", "b"]


def walked(rows):
    first = {}
    for f, k, o in rows:
        if f is not None and k is not None:
            first[f, k] = min(o, first.get((f, k), o))
    files, links, out = set(), set(), []
    for (f, k), o in sorted(first.items(), key=lambda x: (x[1], *x[0])):
        if f not in files and k not in links:
            files.add(f)
            links.add(k)
            out.append((f, k, o))
    return sorted(out)


@pytest.mark.parametrize("most", [500_000, 25])
def test_first_distinct_pairs_of_any_table(spark, monkeypatch, most):
    monkeypatch.setattr(setops, "WALKED_PAIRS", most)
    r = random.Random(most)
    tables = [[(r.choice([f"f{k}" for k in range(20)] + [None]), r.choice([f"l{k}" for k in range(25)] + [None]), r.randint(0, 40)) for _ in range(200)],
              [(f"f{i // 2:03}", f"l{(i + 1) // 2:03}", i) for i in range(120)]]
    for rows in tables:
        got = setops.first_distinct_pairs(spark.createDataFrame(rows, "f STRING, l STRING, o INT").repartition(3), "f", "l", "o")
        assert sorted(map(tuple, got.collect())) == walked(rows)


def test_a_long_chain_takes_few_jobs(spark):
    n = 10_000
    df = spark.range(n).select(F.format_string("f%05d", F.expr("id div 2")).alias("f"), F.format_string("l%05d", F.expr("(id + 1) div 2")).alias("l"), "id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    assert setops.first_distinct_pairs(df, "f", "l", "id").count() == n // 2
    assert len(tracker.getJobIdsForGroup("chain")) < 20
    spark.sparkContext.setJobGroup("", "")
