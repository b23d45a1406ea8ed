"""op10: counts against a direct reading of their definitions, EM, edges."""
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagecurate.llm import quality as q

SF_SMALL = "/root/testdata/sf0.001"


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "\t", "#", " ", "\x1c", "a b c", "\r\n", "\x0b"]), max_size=40).map("".join))
def test_counts_equal_the_definitions(t):
    assert q.count_text(t)[:5] == brute(t)


def test_many_distinct_words_keep_exact_windows():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 5])
    assert q._repeat_words(ids, 6) == q._repeat_words(ids, 3_000_000) == 6


def brute_em(votes, failed, rounds=500):
    """Plain row-by-row EM with the same priors."""
    n, m = len(votes), len(votes[0])
    right, wrong = 0.02 * n + 4, 0.002 * n + 1
    p = [0.0 if f else (0.95 if v.count("+") > v.count("-") else 0.05) for v, f in zip(votes, failed)]
    for _ in range(rounds):
        good = (sum(p) + 2) / (n + 4)
        acc = []
        for cls in (1, 0):
            w = p if cls else [1 - x for x in p]
            want = "+" if cls else "-"
            acc.append([(sum(x for x, v in zip(w, votes) if v[j] == want) + right)
                        / (sum(x for x, v in zip(w, votes) if v[j] != "0") + right + wrong) for j in range(m)])
        for i, v in enumerate(votes):
            a, b = good, 1 - good
            for j, c in enumerate(v):
                if c != "0":
                    a *= acc[0][j] if c == "+" else 1 - acc[0][j]
                    b *= acc[1][j] if c == "-" else 1 - acc[1][j]
            p[i] = 0.0 if failed[i] else a / (a + b)
    return good, acc


def test_em_equals_row_by_row():
    rng = np.random.default_rng(3)
    votes, failed = [], []
    for _ in range(300):
        bad = rng.random() < 0.3
        votes.append("".join(rng.choice(["-", "0", "+"], p=[.6, .2, .2] if bad else [.1, .2, .7]) for _ in range(5)))
        failed.append(bool(bad and rng.random() < 0.3))
    counts = {}
    for v, f in zip(votes, failed):
        counts[(v, f)] = counts.get((v, f), 0) + 1
    model = q.fit_rules([(v, f, k) for (v, f), k in counts.items()], rounds=500, tol=0)
    good, (rg, rb) = brute_em(votes, failed)
    assert abs(model["good"] - good) < 1e-6
    assert np.allclose(model["right_good"], rg, atol=1e-6) and np.allclose(model["right_bad"], rb, atol=1e-6)


def test_query_counts_and_labels(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    rows = q.op10_quality(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    wrong = 0
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
        if not r.base_failed and r.doc_id in labels:
            wrong += r.kept != (labels[r.doc_id] == 1)
    assert wrong <= 2


GOOD = ". ".join(f"{a}lain {a}{b}rds {b}{a}and" for a in "abcdefgh" for b in "stuvwxyz") + "."


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, GOOD), (4, GOOD), (4, GOOD), (5, "x " * 300_000), (6, " \n\t")]
    df = spark.createDataFrame([(*r, "mine", True) for r in rows], "doc_id long, text string, n_words string, kept boolean")
    got = q.score_quality(df)
    assert got.columns == ["doc_id", "text", *q.COUNTS, "votes", "base_failed", "quality", "kept"]
    by = sorted((r.doc_id or 0, r.n_words, r.base_failed) for r in got.collect())
    n = len(GOOD.split())
    assert by == [(0, n, False), (1, 0, True), (2, 0, True), (4, n, False), (4, n, False), (5, 300_000, True), (6, 0, True)]
    assert q.score_quality(df.limit(0)).count() == 0
    kept = q.keep_good(df)
    assert kept.schema == df.schema and {r.n_words for r in kept.collect()} <= {"mine"}
