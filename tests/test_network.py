import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pagecurate.operators.metrics import binary_logit_loss
from pagecurate.plans import learn, network


def plain_forward(net, x):
    """Row by row with math.erf."""
    layers = net.layers()
    h = x @ layers[0][0] + layers[0][1]
    for w, b in layers[1:-1]:
        v = h @ w + b
        h = np.array([u * 0.5 * (1 + math.erf(u / math.sqrt(2))) for u in v])
    return float((h @ layers[-1][0] + layers[-1][1])[0]), h


def plain_loss(net, xs, ys, weight):
    total = 0.0
    for x, y in zip(xs, ys):
        z = plain_forward(net, x)[0]
        total += weight * math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))
    return total


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    xs = rng.normal(size=(200, 3))
    return xs, ((xs[:, 0] * xs[:, 1] > 0) & (xs[:, 2] > -0.5)).astype(int)


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(i, Vectors.dense(x), int(y)) for i, (x, y) in enumerate(zip(*data))], ["id", "_pos", "label"])


def test_gradient_is_that_of_the_loss(data):
    xs, ys = data[0][:20], data[1][:20]
    net = network.new_network(3, hidden=5, depth=2, seed=1)
    loss, grad = network.gradient(net.layers(), xs, ys.astype(float), 2.5)
    assert loss == pytest.approx(plain_loss(net, xs, ys, 2.5), abs=1e-4)
    for k in range(0, len(net.flat), 7):
        up, down = net.flat.copy(), net.flat.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        slope = (plain_loss(network.Network(net.sizes, up), xs, ys, 2.5) - plain_loss(network.Network(net.sizes, down), xs, ys, 2.5)) / 2e-4
        assert grad[k] == pytest.approx(slope, abs=1e-3)


def single_process(xs, ys, steps, weight, rate, **shape):
    net = network.new_network(xs.shape[1], **shape)
    m = v = np.zeros(len(net.flat))
    losses = []
    for t in range(1, steps + 1):
        loss, g = network.gradient(net.layers(), xs, ys.astype(float), weight)
        losses.append(loss / len(ys))
        g = g / len(ys)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        net.flat = net.flat - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return net, losses


def test_partitions_train_as_one_process(spark, rows, data):
    xs, ys = data
    weight = (ys == 0).sum() / (ys == 1).sum()
    alone, losses = single_process(xs, ys, 12, weight, 0.01, hidden=6, depth=2, seed=9)
    net = network.fit_network(rows, "_pos", "label", 3, hidden=6, depth=2, steps=12, rate=0.01, seed=9, dtype=np.float64)
    assert net.losses == pytest.approx(losses, abs=1e-9) and net.flat == pytest.approx(alone.flat, abs=1e-7)
    spark.conf.set("spark.sql.shuffle.partitions", "20")         # gradients meet on a level in between
    try:
        tree = network.fit_network(rows, "_pos", "label", 3, hidden=6, depth=2, steps=3, rate=0.01, seed=9, dtype=np.float64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert tree.losses == pytest.approx(losses[:3], abs=1e-9)


def test_positional_classifier_learns_and_scores(spark, rows, data, tmp_path):
    net = learn.fit_positional_classifier(rows, "label", n_inputs=3, hidden=24, depth=2, steps=150)
    assert net.losses[-1] < 0.6 * net.losses[0]
    again = network.load_network(spark, network.save_network(net, spark, str(tmp_path / "net")))
    got = {r.id: r for r in learn.positional_predictions(again, rows, ["id", "label"]).collect()}
    assert set(got) == set(range(200))
    for i, x in enumerate(data[0]):
        assert got[i].logits == pytest.approx(plain_forward(net, x)[0], abs=1e-5) and got[i].preds == int(got[i].logits > 0)
    assert np.mean([r.preds == r.label for r in got.values()]) > 0.85
    hidden = network.with_hidden(rows, net, "_pos").select("id", vector_to_array("_hidden").alias("h")).collect()
    for r in hidden[:20]:
        assert r.h == pytest.approx(plain_forward(net, data[0][r.id])[1].tolist(), abs=1e-5)


def test_loss_before_the_first_step_is_e20(rows):
    net = network.fit_network(rows, "_pos", "label", 3, hidden=4, depth=1, steps=1, weight=2.0, seed=5, dtype=np.float64)
    start = network.new_network(3, 4, 1, 5)
    loss = binary_logit_loss(network.with_logit(rows, start, "_pos"), "logits", "label", 2.0).first()[0]
    assert net.losses[0] == pytest.approx(loss, abs=1e-9)


def test_missing_values_one_class_and_empty_tables(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        network.fit_network(rows.limit(0), "_pos", "label", 3, hidden=2, depth=1, steps=1)
    bad = spark.createDataFrame([([1.0, None, 2.0], 1), ([1.0, 2.0, 2.0], 0)], "x ARRAY<DOUBLE>, label INT")
    with pytest.raises(Exception, match="a feature is missing"):
        network.fit_network(bad, "x", "label", 3, hidden=2, depth=1, steps=1)
    with pytest.raises(Exception, match="a label is missing"):
        network.fit_network(bad.filter("x[1] is not null").withColumn("label", F.lit(None).cast("int")), "x", "label", 3,
                            hidden=2, depth=1, steps=1)
    one = network.fit_network(rows.filter("label = 1"), "_pos", "label", 3, hidden=2, depth=1, steps=2)
    assert all(map(math.isfinite, one.losses))
    assert network.with_logit(rows.limit(0), one, "_pos").count() == 0


def test_combined_features_join_by_key(rows):
    net = network.new_network(3, hidden=4, depth=1)
    text = rows.select("id", F.concat(F.lit("sida "), F.col("id").cast("string")).alias("text"), "label")
    both = learn.combined_features(text, rows, net, "id")
    assert both.count() == 200 and both.columns == ["id", "text", "label", "_hidden"]
    model = learn.fit_combined_classifier(both, "text", "label", max_iter=5)
    assert model.stages[-1].numFeatures == (1 << 16) + 4
    assert learn.predictions(model, both, ["id"]).count() == 200


def test_the_layers_without_activation_are_one_product(data):
    class Counted(np.ndarray):
        wide = 0

        def __array_ufunc__(self, ufunc, method, *a, **k):
            if ufunc is np.matmul and all(x.ndim == 2 for x in a) and len(a[0]) >= 50 and min(a[1].shape) >= 50:
                Counted.wide += 1
            strip = lambda t: tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in t)
            if "out" in k:
                k["out"] = strip(k["out"])
            got = getattr(ufunc, method)(*strip(a), **k)
            return got.view(Counted) if isinstance(got, np.ndarray) else got

    net = network.new_network(3, hidden=50, depth=2, seed=1)
    x = data[0].view(Counted)
    logits, hidden = network.forward(net.layers(), x)
    assert Counted.wide == 1      # 3 -> 50 -> 50 is one narrow product, 50 -> 50 the wide one
    assert [float(z) for z in logits[:5]] == pytest.approx([plain_forward(net, r)[0] for r in data[0][:5]], abs=1e-5)
    assert hidden.shape == (200, 50)


def test_combined_classifier_makes_the_hidden_vectors_once(spark, tmp_path, monkeypatch):
    from pagecurate import registry
    rows = [(i, "word%d text\nof line" % (i % 7), "en" if i % 3 else "de", 20 + i % 7, i % 2, i % 5 // 4) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, quality int, toxic int").createOrReplaceTempView("t")
    spark.sql("select doc_id, text, lang, n_chars, 'a' as source from t").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select doc_id, quality, toxic from t").write.parquet(f"{tmp_path}/labels.parquet")
    fit = learn.fit_positional_classifier
    monkeypatch.setattr(learn, "fit_positional_classifier", lambda *a, **k: fit(*a, **k, hidden=4, depth=1, steps=2))
    out = registry.QUERIES["combined_classifier"](spark, str(tmp_path))
    assert "predict" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 60


def test_training_rows_are_packed_once_and_all(spark, rows, data, monkeypatch):
    whole, seen = network.full_gradient, []

    def watched(blocks, *a):
        seen.append([(bytes(r.x), bytes(r.y)) for r in blocks.collect()])
        return whole(blocks, *a)

    monkeypatch.setattr(network, "full_gradient", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "40")         # more partitions than tasks of a step
    monkeypatch.setattr(network, "TASKS_PER_CORE", 1)
    try:
        net = network.fit_network(rows, "_pos", "label", 3, hidden=4, depth=1, steps=2, seed=5, dtype=np.float64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] and len(seen[0]) <= 40              # one row a batch, not one a training row
    xs = np.concatenate([np.frombuffer(x).reshape(-1, 3) for x, _ in seen[0]])
    ys = np.concatenate([np.frombuffer(y) for _, y in seen[0]])
    assert sorted(map(tuple, np.column_stack([xs, ys]))) == sorted(map(tuple, np.column_stack(data)))
    weight = (data[1] == 0).sum() / (data[1] == 1).sum()
    assert net.losses == pytest.approx(single_process(*data, 2, weight, 0.003, hidden=4, depth=1, seed=5)[1], abs=1e-9)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_chunks_share_their_work_arrays(data, monkeypatch, depth):
    import tracemalloc
    xs, ys = np.tile(data[0], (3, 1)), np.tile(data[1], 3).astype(float)
    layers = network.new_network(3, hidden=256, depth=depth, seed=2).layers()
    loss, grad = network.gradient(layers, xs, ys, 1.5)
    logits, hidden = network.forward(layers, xs)
    monkeypatch.setattr(network, "CHUNK", 128)                   # the last chunk is shorter
    sums = network.GradientSum(layers, 1.5)
    sums.add(xs[:128], ys[:128])
    tracemalloc.start()
    sums.add(xs[128:], ys[128:])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 128 * 256 * 8                                   # less than one layer's activations
    assert sums.loss == pytest.approx(loss) and sums.total == pytest.approx(grad, abs=1e-8)
    space = network.Space()
    for i in range(0, 600, 128):
        z, h = network.forward(layers, xs[i:i + 128], space)
        assert z == pytest.approx(logits[i:i + 128], abs=1e-12) and h == pytest.approx(hidden[i:i + 128], abs=1e-12)


def test_scores_of_missing_and_wrong_vectors(spark):
    net = network.new_network(3, hidden=4, depth=1, seed=1)
    df = spark.createDataFrame([(0, [1.0, None, 2.0]), (1, [1.0, 2.0, 3.0])], "id INT, x ARRAY<DOUBLE>")
    got = dict(network.with_logit(df, net, "x").select("id", "logits").collect())
    assert got[0] is None and got[1] == pytest.approx(plain_forward(net, np.array([1.0, 2.0, 3.0]))[0], abs=1e-6)
    for bad in ([1.0, 2.0], None):
        with pytest.raises(Exception, match="a vector is missing or has not 3 entries"):
            network.with_logit(spark.createDataFrame([(0, bad)], df.schema), net, "x").collect()
