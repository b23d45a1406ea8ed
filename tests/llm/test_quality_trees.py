"""op11: statistics, trees against a plain reading, edge rows, held-out accuracy."""
import random
import zlib

import numpy as np
import pytest

from pagecurate.llm import quality_trees as qt

SF = "/root/testdata/sf0.01"


def test_statistics_of_a_text():
    s = dict(zip(qt.STATISTICS, qt.statistics("AB ab ab.\nab é1 ##\n\nab é1 ##")))
    assert s["words"] == np.log1p(9) and s["lines"] == np.log1p(3) and s["repeated_lines"] == 1 / 3 and s["ended_lines"] == 1 / 3
    assert s["distinct_words"] == 5 / 9 and s["top_word"] == 3 / 9 and s["same_as_before"] == 0 and s["shouted"] == 1 / 9
    assert s["unlettered"] == 2 / 9 and s["repeated_pairs"] == 4 / 9 and s["symbols"] == 4 / 30
    assert len(qt.STATISTICS) == len(qt.statistics(None)) and qt.statistics(None) == qt.statistics("")
    assert np.isfinite(qt.statistics("x" * 1_000_000)).all()


def walk(model, row):
    """One row through every tree, node by node, on the statistics themselves."""
    odds = model["start"]
    for feature, last, value in zip(model["feature"], model["last_left"], model["value"]):
        node = 0
        while node < len(feature):
            cuts = model["edges"][feature[node]]
            left = last[node] >= len(cuts) or row[feature[node]] <= cuts[last[node]]
            node = 2 * node + (1 if left else 2)
        odds += value[node - len(feature)]
    return 1 / (1 + np.exp(-odds))


def best_gain(x, g, h):
    """Greatest gain of one cut, by trying every statistic and value."""
    best = 0.0
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) >= qt.LEAST_WEIGHT:
                best = max(best, sum(g[s].sum()**2 / (h[s].sum() + qt.PENALTY) for s in (left, ~left)) - g.sum()**2 / (h.sum() + qt.PENALTY))
    return best


def test_trees_against_a_plain_reading():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (400, len(qt.STATISTICS))).astype(float)
    y = ((x[:, 2] > 12) ^ (x[:, 7] > 20)).astype(float)
    model = qt.fit_trees(x, y)
    p = qt.predict(model, x, rows=97)
    assert np.allclose(p, [walk(model, r) for r in x]) and ((p > 0.5) == (y == 1)).mean() > 0.99
    g, h = 0.5 - y, np.full(len(y), 0.25)
    feature, last, _, _ = qt.grow_tree(qt.to_bins(x, qt.bin_edges(x)), g, h)
    left = x[:, feature[0]] <= qt.bin_edges(x)[feature[0]][last[0]]
    gain = sum(g[s].sum()**2 / (h[s].sum() + qt.PENALTY) for s in (left, ~left)) - g.sum()**2 / (h.sum() + qt.PENALTY)
    assert np.isclose(gain, best_gain(x, g, h))
    # values beyond those learned from
    assert np.isfinite(qt.predict(model, x * 100 - 50)).all()


def test_labels_of_one_kind():
    x = np.zeros((3, len(qt.STATISTICS)))
    assert qt.predict(qt.fit_trees(x, np.ones(3)), x).tolist() == [1.0] * 3
    assert qt.predict(qt.fit_trees(x, np.zeros(3)), x).tolist() == [0.0] * 3
    assert qt.predict(qt.fit_trees(x[:0], np.zeros(0)), x).tolist() == [0.5] * 3


def tables(spark, n=300):
    random.seed(2)
    good = [" ".join(random.choices([f"word{k}" for k in range(80)], k=90)) + "." for _ in range(n)]
    bad = [" | ".join(random.choices(["A!", "B##"], k=60)) for _ in range(n)]
    rows = [(i, t, "s", 0.5) for i, t in enumerate(good + bad)] + [(None, good[0], "s", 0.5), (5000, None, "s", 0.5), (5001, "", "s", 0.5), (0, good[0], "s", 0.5), (5002, "w " * 400_000, "s", 0.5)]
    labels = [(i, int(i < n)) for i in range(2 * n)] + [(None, 0), (3, None), (4, 7), (2, 0), (2, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int"), rows)


@pytest.mark.parametrize("most", [qt.MAX_LABELLED, 100])
def test_edge_rows(spark, monkeypatch, most):
    monkeypatch.setattr(qt, "MAX_LABELLED", most)
    docs, labels, rows = tables(spark)
    assert qt.labelled_sample(docs.selectExpr("doc_id AS _id", "array(score) AS _x"), labels, "doc_id", "quality", most).count() <= most
    scored = qt.score_quality_trees(docs, labels)
    assert scored.columns == ["doc_id", "text", "held_out", "score", "predicted", "statistics"]
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.doc_id < 300) for r in got if r.doc_id is not None and r.doc_id < 600)
    assert len({r.score for r in got if r.text == rows[0][1]}) == 1 and len({r.score for r in got if not r.text}) == 1
    assert qt.score_quality_trees(docs.limit(0), labels).count() == 0
    assert {r.score for r in qt.score_quality_trees(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_learned(spark):
    """Turning the held-out labels round changes no score."""
    docs, labels, _ = tables(spark, 60)
    turned = labels.withColumn("quality", qt.F.when(qt.held_out(qt.F.col("doc_id")), 1 - qt.F.col("quality")).otherwise(qt.F.col("quality")))
    a, b = ({(r.doc_id, r.text): r.score for r in qt.score_quality_trees(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = qt.op11_quality_trees(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.97
    again = qt.op11_quality_trees(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
