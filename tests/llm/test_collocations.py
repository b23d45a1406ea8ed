"""op13 against counting every phrase."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagecurate.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top, subsumed=100):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i:i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= min_count}
        inner = {}
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inner[p[i:j]] = max(inner.get(p[i:j], 0), a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and 100 * inner.get(p, 0) < subsumed * a:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((s, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def corpus():
    random.seed(6)
    words = ["The", "of", "é", "Éa", "x\x1cy", "n b", "cat", "Sat", "on", "mat", "😀", "\x00", "￿", "z"]
    phrases = ["the cat sat on the mat", "new york city", "of of of of of", "É é", "a  B\tc"]
    rows = []
    for i in range(400):
        text = "".join(random.choice([*words, *phrases]) + random.choice([" ", " ", "\t", " ", ", ", "\n", "!", "\x0b"]) for _ in range(random.randint(0, 40)))
        rows.append((random.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, None), ("xx", ""), ("en", "the cat sat on the mat " * 5000), rows[0], rows[0]]


@pytest.mark.parametrize("limits", [(5, 2000, 100, co.FILTER_BITS), (3, 7, 60, 64), (1, 100, 100, co.FILTER_BITS)])
def test_against_counting(spark, monkeypatch, limits):
    min_count, top, subsumed, bits = limits
    monkeypatch.setattr(co, "FILTER_BITS", bits)  # a full filter only costs time
    rows = corpus()
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    want = brute(rows, min_count, top, subsumed)
    assert got(co.mine_collocations(df, min_count=min_count, top=top, subsumed=subsumed)) == want and len(want) > 20


def test_no_candidates(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert got(co.mine_collocations(df)) == [] and got(co.mine_collocations(df.limit(0))) == []
    assert co.mine_collocations(df).dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in COLUMNS[3:]]]


def test_products_beyond_64_bits(spark):
    one = spark.createDataFrame([("en", "a b", 2, 9 * 10**12)], "lang string, phrase string, size int, n long")
    counts = spark.createDataFrame([("en", "a", 10**13 - 7), ("en", "b", 10**13 - 9)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**16 + 1)], "lang string, total long")
    r = co._scores(one, counts, totals).first()
    assert r.score == 1000 * 9 * 10**12 * (10**16 + 1) // ((10**13 - 7) * (10**13 - 9))


def counted(batches):
    """(rows, counts of the phrases) of stripes."""
    counts = Counter()
    for b in batches:
        for r in b.to_pylist():
            assert 0 < len(r["next"]) == len(r["n"]) <= co.ROW_CELLS
            for word, n in zip(r["next"], r["n"]):
                counts[r["size"], r["lang"], r["prefix"], word] += n
    return sum(b.num_rows for b in batches), counts


def test_one_stripe_of_a_prefix_for_all_batches_of_a_task(monkeypatch):
    texts = [("en", ["a b c a b", "b a, é a b c d e f", None]), ("de", ["a b"]), ("en", [None, ""])]
    one, counts = counted(list(co.task_stripes(texts, (1, 2, 3, 4, 5), {})))
    many, sums = counted(list(co.task_stripes(texts * 40, (1, 2, 3, 4, 5), {})))
    assert many == one and sums == {k: 40 * n for k, n in counts.items()}
    assert counts[1, "en", "", None] == 14 and counts[2, "en", "a", "b"] == 3 and counts[5, "en", "b c d e", "f"] == 1
    monkeypatch.setattr(co, "ROW_CELLS", 3)
    for cells in (0, 1, 20, 60, 100):  # given on early, in shorter rows: the same sums
        monkeypatch.setattr(co, "MOST_CELLS", cells)
        rows, sums = counted(list(co.task_stripes(texts * 40, (1, 2, 3, 4, 5), {})))
        assert rows >= one and sums == {k: 40 * n for k, n in counts.items()}


def test_few_hashes_pass_by_chance(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER_BITS", 1 << 16)
    hashes = np.random.default_rng(3).integers(-2**63, 2**63, 100_000)
    bits = co.bitmap(spark.createDataFrame([(int(h),) for h in hashes[:2_000]], "hash long"))
    passes = co.passing(hashes.view(np.uint64), bits)
    assert passes[:2_000].all() and passes[2_000:].sum() < 200  # about 3,000 with one bit each


def test_stripes_hold_only_phrases_often_enough(spark, monkeypatch):
    held, stripes = [], co.stripes
    monkeypatch.setattr(co, "stripes", lambda *args: held.append(stripes(*args)) or held[-1])
    rows = [("en", t) for t in ["a b c", "b c d", "c d e", "a b c d x", "b c d e x"] for _ in range(10)] + [("en", "a b c d e")]
    found, _ = co.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), min_count=10)
    assert sorted(r.phrase for r in found.filter("size > 3").collect()) == ["a b c d", "a b c d x", "b c d e", "b c d e x", "b c d x", "c d e x"]
    assert min(r.n for r in held[1].collect()) >= 10
