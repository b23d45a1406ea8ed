"""op9: edges against the SQL over exact similarity, radius and blocks."""
import random
from collections import Counter

import pandas as pd
from llm_duck import duck, same_rows

from pagecurate.llm import decontaminate as dc

F = dc.F


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_blocks_find_all_within_the_radius(spark):
    assert sum(dc.BLOCK_BITS) == 64 and (dc.NEAR + 1) * len(dc.BLOCK_BITS) > dc.RADIUS
    random.seed(2)
    windows, items = [], []
    for i in range(60):
        a = random.getrandbits(64)
        items.append((i, 7, signed(a)))
        for far in (0, 1, dc.RADIUS, dc.RADIUS + 1, 32):
            b = a ^ sum(1 << x for x in random.sample(range(64), far))
            windows.append((len(windows), 7 if far != 1 else 8, signed(b)))
    w = spark.createDataFrame(windows, "w int, n_words int, fp long")
    got = dc.near_items(w, spark.createDataFrame(items, "item int, n_words int, item_fp long"))
    far = {(w, i): ((a ^ b) & ((1 << 64) - 1)).bit_count() for w, n, a in windows for i, m, b in items if n == m}
    assert sorted((r.w, r.item, r.hamming) for r in got.collect()) == sorted((*k, h) for k, h in far.items() if h <= dc.RADIUS)


def test_rolling_fingerprints_equal_those_of_each_window(spark, monkeypatch):
    random.seed(5)
    rows = [(i, i, random.choices([f"w{k}" for k in range(30)], k=n)) for i, n in enumerate((1, 5, 12, 40, 300))]
    lengths = [{"width": 5, "n_words": 9, "first": 0, "last": 10_000}, {"width": 5, "n_words": 20, "first": 0, "last": 10_000}, {"width": 3, "n_words": 3, "first": 0, "last": 10_000}]
    some = [{"width": 5, "n_words": 9, "first": 77, "last": 81}, {"width": 5, "n_words": 20, "first": 140, "last": 140}]
    rows.append((9, 9, rows[-1][2]))
    docs = spark.createDataFrame([(*r, some if r[0] == 9 else lengths) for r in rows],
                                 "doc_id long, text_hash long, words array<string>, lengths array<struct<width:int,n_words:int,first:int,last:int>>")
    for lanes in ((16, 1 << 14), (16, 64), (21, 32), (31, 50)):
        monkeypatch.setattr(dc, "_lanes", lambda longest, lanes=lanes: lanes)
        got = dc.window_fingerprints(docs, [3, 5], 20)
        again = got.join(docs.select("doc_id", "words"), "doc_id").withColumn("window", F.slice("words", F.col("start") + 1, F.col("n_words")))
        assert again.filter(F.col("fp") != dc.simhash(dc._hash_shingles(F.col("window"), F.col("width")))).count() == 0
        assert got.filter("doc_id < 9").count() == sum(max(0, len(w) - x["n_words"]) + 1 for _, _, w in rows[:-1] for x in lengths if len(w) >= x["width"])
        assert {(r.n_words, r.start) for r in got.filter("doc_id = 9").collect()} == {(9, s) for s in range(77, 82)} | {(20, 140)}


def test_simhash_equals_a_direct_count(spark):
    random.seed(3)
    rows = [([random.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (0, 1, 2, 7, 30)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<long>").select(dc.simhash(F.col("h"))).collect()]
    for (hs,), fp in zip(rows, got):
        want = sum(1 << b for b in range(64) if sum(1 if (h >> b) & 1 else -1 for h in hs) > 0)
        assert fp % (1 << 64) == want


def passages():
    random.seed(4)
    w = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(w, k=random.choice([3, 5, 14, 30, 50])))) for i in range(25)]
    items += [(25, items[0][1]), (26, "one two"), (27, None), (28, ""), (29, "a " * 20), (29, "b " * 20)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "x one TWO y")]
    for i, (item, text) in enumerate(items * 3):
        words = (text or "").split()
        for _ in range(random.choice([0, 0, 1, 2])):
            if words:
                words[random.randrange(len(words))] = "changed"
        if i % 5 == 0:
            words = [x.upper() for x in words]
        before = random.choices(w, k=random.randrange(0, 30))
        docs.append((100 + i, "\t ".join(before) + "  " + "\n".join(words) + " " + " ".join(random.choices(w, k=random.randrange(0, 30)))))
    docs += [(100, docs[5][1]), (None, items[3][1]), (7, items[3][1]), (7, items[3][1]), (7, items[5][1]), (8, items[3][1] + " z " + items[3][1])]
    docs.append((9, "pad " * 30_000 + (items[4][1] or "")))
    return docs, items


def tables(docs, items):
    return duck(documents=pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), benchmark=pd.DataFrame(items, columns=["item_id", "text"]))


def test_equals_sql_on_planted_passages(spark):
    docs, items = passages()
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, item_id string, words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    con = tables(docs, items)
    got = dc.find_leaks(d, b).drop("text_hash", "hamming")
    assert same_rows(got, con, dc.OP9_SQL) > 30
    kept = dc.drop_leaks(d, b)
    assert kept.schema == d.schema
    bad = {r.doc_id for r in got.collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - bad


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.find_leaks(d, b).count() == 1
    assert dc.find_leaks(d.limit(0), b).count() == 0
    assert dc.find_leaks(d, b.limit(0)).count() == 0 and dc.drop_leaks(d, b.limit(0)).count() == 1


def test_plan_is_native_and_shuffles_no_text(spark):
    q = dc.op9_decontaminate(spark, "/root/testdata/sf0.001")
    plan = q._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def moved_passages():
    """Items whose most similar window starts at no aligned place: halves swapped,
    swapped after 30 words, words put in the middle; and one below the threshold."""
    def item(name, n):
        return [f"{name}{i}" for i in range(n)]
    before, after = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(40)]
    a, b, c, e = item("a", 100), item("b", 100), item("c", 110), item("e", 60)
    inner = item("x", 5) + c[5:55] + item("y", 10) + c[55:105] + item("z", 5)
    docs = [(1, a[50:] + a[:50]), (2, b[30:] + b[:30]), (3, inner), (4, e[:30] + item("v", 20) + e[30:]), (5, a), (6, a[50:] + a[:50] + a), (7, a[50:90])]
    docs = [(i, " ".join(before + w + after)) for i, w in docs] + [(8, " ".join(a[50:] + a[:50])), (None, " ".join(before + a[50:] + a[:50])), (9, "r r " * 60), (10, " ".join(a[10:] + a[:9]))]
    return docs, [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(e)), (5, "r r r r r r r r r r r r " + " ".join(item("s", 12)))]


def best_similarity(text, item):
    """Over every start."""
    w, b = text.split(), item.split()
    k = min(dc.SHINGLE, len(b))

    def bag(x):
        return Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1))
    of_item, best = bag(b), (0.0, 0)
    for start in range(max(1, len(w) - len(b) + 1)):
        of_window = bag(w[start:start + len(b)])
        common = (of_window & of_item).total()
        best = max(best, (common / (of_window | of_item).total(), -start))
    return best[0]


def test_best_window_of_every_start(spark):
    docs, items = moved_passages()
    want = {(d, i): best_similarity(text, item) for d, text in docs for i, item in items}
    want = {k: v for k, v in want.items() if v >= 0.75}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert same_rows(dc.find_leaks(d, b).drop("text_hash", "hamming"), tables(docs, items), dc.OP9_SQL) == len(want)
    rows = dc.find_leaks(d, b).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got == want and len(rows) == len(got)
    assert {(1, 1), (2, 2), (3, 3), (None, 1)} <= set(got) and (4, 4) not in got
    texts = dict(docs)
    for r in rows:  # the reported window has the reported similarity
        window = " ".join(texts[r.doc_id].split()[r.start:r.start + r.n_words])
        assert best_similarity(window, dict(items)[r.item_id]) == r.similarity
    assert {r.doc_id for r in dc.drop_leaks(d, b).collect()} == set(texts) - {k for k, _ in got}


def test_recall_of_the_radius(spark):
    """Of documents with a window at 0.75 to 0.8 by exact similarity, the share found."""
    random.seed(12)
    v = [f"w{i}" for i in range(3000)]
    items = [(i, random.choices(v, k=59)) for i in range(120)]
    docs = []
    for i, w in items:  # 55 shingles; an edit at either end costs as many shingles as words
        left = random.randint(0, 6)
        docs.append((i, random.choices(v, k=20) + ["new"] * left + w[left:59 - (6 - left)] + random.choices(v, k=20)))
    docs = [(i, " ".join(w)) for i, w in docs]
    exact = {i for i, text in docs if best_similarity(text, " ".join(items[i][1])) >= 0.75}
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    found = {r.doc_id for r in rows if r.doc_id == r.item_id}
    print(f"recall {len(found & exact) / len(exact):.3f} of {len(exact)}, hamming up to {max(r.hamming for r in rows)}")
    assert found <= exact and len(exact) > 100 and len(found) >= 0.99 * len(exact)
