"""op8 against all pairs."""
import random

import numpy as np
import pytest
from llm_brute import THUE_MORSE, near_dups, shingles

from pagecurate.llm import near_dup as nd

SF_SMALL = "/root/testdata/sf0.001"


def got(df):
    rows, _ = nd.near_dup_groups(df)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows.collect()), key=repr)


def edited(words, rate, vocabulary):
    return [random.choice(vocabulary) if random.random() < rate else w for w in words]


def corpus():
    random.seed(11)
    v = [f"w{i}" for i in range(300)]
    rows, passage = [], random.choices(v, k=60)
    for base in range(6):
        words = random.choices(v, k=random.choice([40, 120, 300]))
        for copy in range(25):
            rows.append((1000 - 25 * base - copy, " ".join(edited(words, random.choice([0, 0.01, 0.02, 0.04]), v))))
    for i in range(60):  # only a passage in common
        rows.append((2000 + i, " ".join(random.choices(v, k=random.choice([5, 20, 60])) + passage + random.choices(v, k=10))))
    for i, n in enumerate((1, 2, 3, 4, 5, 6)):
        rows += [(3000 + 10 * i, " ".join(v[:n])), (3001 + 10 * i, " \n".join(v[:n]).upper())]
    rows += [(4000, None), (4001, ""), (4002, "\n "), (None, rows[0][1]), (None, "alone in the world of ids"), (5, "alone again or the same text"), (5, "alone again or the same text"),
             (6, "x " * 50_000), (7, "X " * 49_000),
             (8, THUE_MORSE[0]), (9, THUE_MORSE[1]), (10, " ".join(["a", *THUE_MORSE] * 2 + ["b", *THUE_MORSE[::-1], "c"]))]
    return rows


@pytest.mark.parametrize("limits", [{}, {"BUCKET_ROWS": 8, "BLOCK": 4, "MOST_BROADCAST": 1}, {"BUCKET_ROWS": 4, "MOST_SPLITS": 1}])
def test_equals_all_pairs(spark, monkeypatch, limits):
    for k, x in limits.items():
        monkeypatch.setattr(nd, k, x)
    rows = corpus()
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, component string, node int").repartition(4)
    assert got(df) == near_dups(rows)


def test_links_are_links(spark):
    rows = corpus()
    texts = dict(rows)
    _, links = nd.near_dup_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in links.collect():
        if r.doc_a is not None and r.doc_b is not None:
            a, b = shingles(texts[r.doc_a]), shingles(texts[r.doc_b])
            assert 100 * len(a & b) >= 75 * len(a | b)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, extra string")
    out = nd.drop_near_dups(df)
    assert out.schema == df.schema
    kept = [r.doc_id for r in out.collect()]
    want = [d for d, _, _, k in near_dups(rows) if k and d is not None]
    assert sorted(x for x in kept if x is not None) == sorted(set(want))
    assert kept.count(None) == 1  # its group has no other id


def test_min_max_estimates_the_similarity():
    rng = np.random.default_rng(5)
    times, plus = nd._permutations(0)
    errors = []
    for _ in range(60):
        common, a, b = (np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(3))
        x, y = np.union1d(common, a[:60]), np.union1d(common, b[:60])
        agree = (nd.min_max(x, times, plus) == nd.min_max(y, times, plus)).mean()
        errors.append(agree - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(df) == [] and nd.drop_near_dups(df).count() == 0


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    out = nd.op8_near_dups(spark, SF_SMALL)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == near_dups(rows)
