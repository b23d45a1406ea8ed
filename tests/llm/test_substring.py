"""op2 against brute force; the FM-index against direct counts."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_brute import THUE_MORSE

from pagecurate.llm import fmindex, substring

SF_SMALL = "/root/testdata/sf0.001"


def brute(rows, window=35):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_fm_index_counts_and_repeated_runs():
    random.seed(1)
    for _ in range(150):
        n, symbols = random.randint(1, 120), random.choice([2, 3, 5, 50])
        t = np.array([random.randrange(1, symbols + 1) for _ in range(n)])
        if n > 10 and random.random() < .6:
            k = random.randint(5, n // 2)
            a, b = random.randint(0, n - k), random.randint(0, n - k)
            t[b:b + k] = t[a:a + k]
        cuts = sorted(random.sample(range(n), min(n, random.randint(0, 3))))
        t[cuts] = 0
        s = t.tolist()
        assert fmindex.suffix_array(t).tolist() == sorted(range(n), key=lambda i: s[i:])
        index = fmindex.FMIndex(t, symbols + 1)
        for _ in range(10):
            i = random.randrange(n)
            p = s[i:i + random.randint(1, 6)]
            if 0 not in p:
                low, high = np.array([0]), np.array([index.n])
                for c in reversed(p):
                    low, high = index.extend(np.array([c]), low, high)
                assert high[0] - low[0] == sum(s[k:k + len(p)] == p for k in range(n))
        bounds = [-1, *cuts, n]
        for least in (2, 3, 5, 8):
            a, b = fmindex.repeated_runs(index, t, np.array(bounds[:-1]) + 1, np.array(bounds[1:]), least)
            covered = {k for x, y in zip(a.tolist(), b.tolist()) for k in range(x, y - least + 1)}
            count = Counter(tuple(s[k:k + least]) for k in range(n - least + 1))
            assert covered == {k for k in range(n - least + 1) if 0 not in s[k:k + least] and count[tuple(s[k:k + least])] > 1}


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 63, 35).astype(np.uint64)
    for _ in range(50):
        docs = [np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64), shared,
                                rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(2)]
        at = [len(d) - len(d) + int(np.flatnonzero(d == shared[0])[0]) for d in docs]
        inside = []
        for d, s in zip(docs, at):
            h, p = substring.anchors(d)
            inside.append({(int(x), int(y) - s) for x, y in zip(h, p) if s <= y <= s + 35 - substring.GRAM})
        assert inside[0] & inside[1]


def corpus():
    random.seed(9)
    v = [f"v{i}" for i in range(30)] + ["é", "Éa", "x\x1cy", "n b"]
    passages = [random.choices(v, k=k) for k in (34, 35, 36, 60, 300)]
    rows = []
    for i in range(60):
        w = random.choices(v, k=random.choice([0, 3, 40, 120]))
        for p in random.sample(passages, random.randint(0, 3)):
            k = random.randint(0, len(w))
            w[k:k] = p
        rows.append((i, random.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, "u " * 90), (101, "y " * 34), (102, "z " * 35), (103, None), (104, "")]
    rows += [(110 + i, " ".join(["p q r"] * n + random.choices(v, k=5) + ["p q r"] * 20)) for i, n in enumerate((1, 9, 12, 13, 40))]
    rows += [(106 + i, " ".join([f"t{k}" for k in range(34)] + [w])) for i, w in enumerate(THUE_MORSE)]
    rows += [(7, " ".join(passages[3])), (105, " ".join(random.choices(v, k=20_000)) + " " + " ".join(passages[4]))]
    return rows


@pytest.mark.parametrize("hot,shard,places", [(32768, 1_000_000, 2_000_000), (2, 1_000_000, 2_000_000), (32768, 50, 1)])
def test_equals_brute_force(spark, monkeypatch, hot, shard, places):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "MOST_PLACES", places)  # at 1 the texts are shuffled
    monkeypatch.setattr(substring, "MOST_BROADCAST", places)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, node string, n_words int").repartition(3)
    assert got(substring.dedup_substrings(df)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(df).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows)
    assert got(substring.op2_substrings(spark, SF_SMALL)) == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("hot", [substring.HOT, 1])
def test_rows_without_text_share_ids_with_repeated_ones(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words + ["a"])), (1, None), (2, "b " + " ".join(words)), (None, " ".join(["c"] + words + ["d"])), (None, None)]
    assert got(substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
