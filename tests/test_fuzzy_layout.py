import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagecurate.operators.fuzzy import indel_ratio_py, lcs_length
from pagecurate.operators.layout import match_blocks, nearest_following, speaker_box, words_to_nth_colon


def lcs_dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé :", max_size=40), st.text(alphabet="abcd é", max_size=40))
def test_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_ratio_known_values():
    assert indel_ratio_py("this is a test", "this is a test!") == 97
    assert indel_ratio_py("", "") == 100 and indel_ratio_py("a", "") == 0
    # half-to-even rounding: 2 of 8 characters differ -> 75; 1 in 8 -> 87.5 -> 88
    assert indel_ratio_py("abcd", "abce") == 75


def brute_best(segs, blocks, scorer):
    out = {}
    for (k, sid, st_, so) in segs:
        cands = [(scorer(st_, bt), -abs(bi - so), -bi, bi) for (bk, bi, bt) in blocks if bk == k]
        if cands:
            out[sid] = max(cands)[3]
    return out


def test_match_blocks_pruning_is_exact(spark):
    r = random.Random(3)
    words = ["anf", "herr", "talman", "jag", "yrkar", "bifall", "till", "motionen", "nr", "12"]
    segs, blocks = [], []
    for page in range(6):
        texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 8))) for _ in range(r.randint(3, 9))]
        for bi, t in enumerate(texts):
            blocks.append((page, bi, t))
        for si in range(r.randint(1, 6)):
            base = r.choice(texts)
            noisy = "".join(c for c in base if r.random() > 0.1) if r.random() < 0.7 else r.choice(words)
            segs.append((page, f"s{page}-{si}", noisy or "x", si))
    sdf = spark.createDataFrame(segs, "page INT, id STRING, text STRING, ord INT")
    bdf = spark.createDataFrame(blocks, "page INT, idx INT, btext STRING").withColumn("bid", F.col("idx"))
    got = match_blocks(sdf, bdf, ["page"], "id", "text", "ord", "bid", "btext", "idx", scorer="indel")
    assert {r.id: r.idx for r in got.collect()} == brute_best(segs, blocks, indel_ratio_py)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_match_blocks_tie_prefers_nearest_then_lowest(spark):
    sdf = spark.createDataFrame([(1, "a", "same text", 2), (1, "b", "same text", 0)], "page INT, id STRING, text STRING, ord INT")
    bdf = spark.createDataFrame([(1, i, "same text") for i in (0, 1, 3)], "page INT, idx INT, btext STRING") \
        .withColumn("bid", F.col("idx"))
    got = match_blocks(sdf, bdf, ["page"], "id", "text", "ord", "bid", "btext", "idx")
    # ord 2: indices 1 and 3 are equally near -> the lower one
    assert {r.id: r.idx for r in got.collect()} == {"a": 1, "b": 0}


def test_speaker_cut(spark):
    words = [("Herr", 0.0), ("TALMANNEN:", 60.0), ("Jag", 170.0), ("yrkar:", 220.0), ("bifall.", 290.0)]
    arr = F.array(*[F.struct(F.lit(w).alias("content"), F.struct(F.lit(x).alias("left"), F.lit(0.0).alias("upper"),
                                                                 F.lit(x + 40).alias("right"), F.lit(20.0).alias("lower")).alias("box"))
                    for w, x in words])
    df = spark.range(1)
    for n, right, count in [(0, 330.0, 5), (1, 100.0, 2), (2, 260.0, 4), (3, 330.0, 5)]:
        r = df.select(speaker_box(arr, n).alias("b"), F.size(words_to_nth_colon(arr, n)).alias("c")).first()
        assert r.b.right == right and r.c == count


def test_nearest_following_offsets(spark):
    # layouts exist for pages 4, 10, 11, 25 of package p
    left = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("p", "c", 12), ("p", "d", 14), ("q", "e", 0)],
                                 "pkg STRING, id STRING, page INT")
    right = spark.createDataFrame([("p", 4), ("p", 10), ("p", 11), ("p", 25)], "pkg STRING, page INT")
    got = {r.id: (r.found_pos, r.page_offset) for r in
           nearest_following(left, right, ["pkg"], "page", "page", 10).collect()}
    assert got == {"a": (4, 4), "b": (4, 3), "c": (None, None), "d": (None, None), "e": (None, None)}


def test_nearest_following_equals_a_nested_loop(spark):
    r = random.Random(5)
    left = [(r.choice("pq") if r.random() > 0.1 else None, r.choice(["a", "b", None]), r.randint(0, 30) if r.random() > 0.1 else None) for _ in range(120)]
    right = [(r.choice("pqr") if r.random() > 0.1 else None, r.randint(0, 40) if r.random() > 0.1 else None, r.randint(0, 5)) for _ in range(60)]
    ldf = spark.createDataFrame(left, "pkg STRING, id STRING, page INT").repartition(5)
    rdf = spark.createDataFrame(right, "pkg STRING, page INT, width INT").repartition(3)
    for most in (0, 3, 10):
        want = []
        for pkg, i, page in left:
            fits = [(q, w) for k, q, w in right if k is not None and k == pkg and q is not None and page is not None and page <= q <= page + most]
            q, w = min(fits, default=(None, None))
            want.append((pkg, i, page, q, None if q is None else q - page, w))
        got = nearest_following(ldf, rdf, ["pkg"], "page", "page", most, ["width"])
        assert got.columns == ["pkg", "id", "page", "found_pos", "page_offset", "width"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert nearest_following(ldf, rdf.limit(0), ["pkg"], "page", "page", 3).filter("found_pos IS NOT NULL").count() == 0
    assert nearest_following(ldf.limit(0), rdf, ["pkg"], "page", "page", 3).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_match_blocks_rows_and_repeated_ids(spark):
    """One result per segment row: ids that repeat on a page, NULL ids, equal rows; blocks far from the ordinal."""
    r = random.Random(8)
    letters = "aeint .,xyzåÄ12"
    segs, blocks = [], []
    for page in range(5):
        blocks += [(page, bi, "".join(r.choices(letters, k=r.randint(0, 40)))) for bi in range(r.randint(0, 12))]
        for si in range(8):
            base = r.choice([t for p, _, t in blocks if p == page] or ["q"])
            segs.append((page, r.choice(["s", "t", None]), "".join(c for c in base if r.random() > 0.2), r.randint(0, 12)))
    segs += segs[:6]
    sdf = spark.createDataFrame(segs, "page INT, id STRING, text STRING, ord INT").repartition(4)
    bdf = spark.createDataFrame(blocks, "page INT, idx INT, btext STRING").withColumn("bid", F.col("idx"))
    for name, scorer in (("indel", indel_ratio_py), ("levenshtein", lambda a, b: -lev(a, b))):
        want = []
        for page, sid, text, o in segs:
            best = max(((scorer(text, t), -abs(bi - o), -bi) for p, bi, t in blocks if p == page), default=None)
            if best:
                want.append((page, sid, -best[2], -best[2], float(best[0]), o))
        got = match_blocks(sdf, bdf, ["page"], "id", "text", "ord", "bid", "btext", "idx", scorer=name, carry=["ord"])
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
