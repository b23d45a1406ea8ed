"""op12 against every lag of every text."""
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagecurate.llm import periodic_runs as pr

SF_SMALL = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every stretch of every lag, those of a smallest period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            piece = w[start:start + length]
            smallest = not any(all(piece[k] == piece[k - s] for k in range(s, length)) for s in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_texts_too_short_for_a_run_share_none():
    assert pr.batch_runs([[b"a"] * 3, [b"b"] * 3]) == [[], []]
    assert pr.batch_runs([[b"a"] * 2] * 9) == [[]] * 9
    assert pr.batch_runs([]) == [] and pr.batch_runs([[], []]) == [[], []]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=5), max_size=5))
def test_runs_of_any_words(texts):
    docs = [[b"%d" % x for turn, times in parts for x in turn * times] for parts in texts]
    assert pr.batch_runs(docs) == [brute_runs(d) for d in docs]


def test_runs_of_few_symbols():
    random.seed(4)
    for _ in range(300):
        w = random.choices(range(random.choice([1, 2, 3])), k=random.randint(0, 90))
        assert pr.periodic_runs(np.array(w, np.int64)) == brute_runs(w)


def test_long_texts_stay_linear():
    """One word, and a period of thousands, a million times over."""
    assert pr.batch_runs([[b"a"] * 1_000_000]) == [[(0, 1_000_000, 1)]]
    turn = [b"%d" % i for i in range(5000)]
    assert pr.batch_runs([[b"x"], turn * 60 + [b"y"], [b"b"] * 5])[1] == [(0, 300_000, 5000)]


def corpus():
    random.seed(8)
    rows = [(i, random.choice(["  ", "\n", " "]).join(random.choices(["a", "B", "é", "b"], k=random.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, " ".join(random.choices("abcdefgh", k=i) * random.randint(1, 9))) for i in range(1, 30)]
    return rows + [(300, None), (301, ""), (None, "x " * 9), (None, None), (7, rows[3][1]), (7, rows[3][1]), (302, "q " * 30_000), (303, "a b\x1ca b\x1ca b")]


def test_rows_against_every_lag(spark, monkeypatch):
    rows = corpus()
    for words in (pr.BATCH_WORDS, 50):
        monkeypatch.setattr(pr, "BATCH_WORDS", words)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, start int").repartition(3)
        df.createOrReplaceTempView("runs_docs")
        found = pr.find_periodic_runs(df)
        assert sorted((r.doc_id, [tuple(x) for x in r.runs]) for r in found.collect() if r.doc_id is not None) == sorted(
            (d, brute_runs((t or "").split() if "\x1c" not in (t or "") else t.encode().split())) for d, t in rows if d is not None)
        texts = {r.doc_id: r.collapsed for r in found.collect()}
        assert texts[302] == "q" and texts[301] is None
    assert pr.find_periodic_runs(df.limit(0)).count() == 0


def test_query_against_every_lag(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in pr.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(*r) for r in rows), key=repr)


def test_text_ids(spark):
    df = spark.createDataFrame([("one", "a b a b a b a b"), (None, "c")], "doc_id string, text string")
    assert sorted((r.doc_id or "", [tuple(x) for x in r.runs], r.collapsed) for r in pr.find_periodic_runs(df).collect()) == [("", [], None), ("one", [(0, 8, 2)], "a b")]
