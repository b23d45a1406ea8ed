import os

import pytest
from pyspark.sql import functions as F

from pagecurate.operators.filters import drop_incomplete
from pagecurate.plans import learn


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(60):
        margin = i % 3 == 0
        text = ("sidan 12 av protokollet" if margin else "herr talman jag yrkar bifall till motionen") + f" {i}"
        rows.append((i, text, 1.0 if margin else 0.0, "train" if i < 40 else "test"))
    return spark.createDataFrame(rows, "id INT, text STRING, marginal_text DOUBLE, split STRING").cache()


def test_text_classifier_predicts_every_row(spark, docs):
    m = learn.fit_text_classifier(docs.filter("split = 'train'"), "text", "marginal_text", weighted=True, max_iter=10)
    p = learn.predictions(m, docs, ["id", "marginal_text"])
    assert p.columns == ["id", "marginal_text", "preds", "logits1", "logits2"]
    rows = p.collect()
    assert len(rows) == 60
    acc = sum(r.preds == int(r.marginal_text) for r in rows) / 60
    assert acc > 0.9


def test_choose_model_and_save_load(spark, docs):
    best, table = learn.choose_model(docs.filter("split = 'train'"), docs.filter("split = 'test'"),
                                     "text", "marginal_text", regs=(0.0, 0.5), max_iter=5)
    assert table.count() == 2 and table.filter(F.col("log_loss").isNull()).count() == 0
    path = learn.save_model(best, "test_choose_model")
    assert os.path.basename(path) == "test_choose_model"
    again = learn.load_model(path)
    a = learn.predictions(best, docs, ["id"]).orderBy("id").collect()
    b = learn.predictions(again, docs, ["id"]).orderBy("id").collect()
    assert a == b


def test_positional_features_vector(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0, True, "train"), (2, 20.0, 2.0, False, "train"),
                                (3, 30.0, None, True, "test")], "id INT, a DOUBLE, b DOUBLE, f BOOLEAN, split STRING")
    with pytest.raises(Exception):              # a missing feature is not dropped in silence
        learn.positional_features(df, ["a", "b"], ["f"], fit_on=F.col("split") == "train").collect()
    out = learn.positional_features(drop_incomplete(df, ["a", "b"]), ["a", "b"], ["f"], fit_on=F.col("split") == "train")
    rows = {r.id: r._pos.toArray().tolist() for r in out.collect()}
    assert set(rows) == {1, 2}                 # the incomplete row is skipped
    assert rows[1] == [-1.0, 0.0, 1.0] and rows[2] == [1.0, 0.0, 0.0]


def test_active_learning_rounds(spark):
    from pagecurate.plans.active import active_learning
    pool = spark.createDataFrame([(i, [float(i % 5), float((i * 7) % 5), 0.5]) for i in range(30)],
                                 "id INT, logits ARRAY<DOUBLE>")
    ann = spark.createDataFrame([(i, i % 3) for i in range(30)], "id INT, label INT")  # label 2 is rejected
    done = active_learning(pool, ann, id_col="id", rounds=3, pool_size=10, batch=4, seed=3)
    lab, rest = done.labelled.collect(), done.pool
    picked_rounds = {r["round"] for r in lab}
    assert picked_rounds <= {1, 2, 3} and all(r.label in (0, 1) for r in lab)
    rejected = {r.id for r in done.rejected.collect()}
    assert {r.id % 3 for r in done.rejected.collect()} <= {2} and len(rejected) + len(lab) == 12
    ids = {r.id for r in lab} | rejected | {r.id for r in rest.collect()}
    assert len(ids) == rest.count() + len(lab) + len(rejected) == 30   # no row is lost
    assert not {r.id for r in lab} & {r.id for r in rest.collect()}


def test_active_learning_refits_and_evaluates(spark):
    from pagecurate.plans.active import active_learning
    pool = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(40)], "id INT, logits ARRAY<DOUBLE>")
    ann = spark.createDataFrame([(i, i % 2) for i in range(40)], "id INT, label INT")
    fitted = []

    def refit(rows):
        fitted.append(rows.count())
        # scores that know the parity: the lowest ids become the least certain
        odd = F.col("id") % 2 == 1
        strength = F.col("id") / 40.0 + 0.1
        return lambda df: df.withColumn("logits", F.when(odd, F.array(-strength, strength)).otherwise(F.array(strength, -strength)))

    done = active_learning(pool, ann, rounds=4, pool_size=40, batch=5, seed=1, refit=refit)
    assert fitted == [5, 10, 15]                        # no fit before the first labels
    assert [m["round"] for m in done.metrics] == [3, 4] and all(m["accuracy"] == 1.0 for m in done.metrics)
    assert done.labelled.count() == 20 and done.pool.count() == 20 and done.rejected.count() == 0
    later = sorted(r.id for r in done.labelled.filter("round = 2").collect())
    first = {r.id for r in done.labelled.filter("round = 1").collect()}
    assert later == [i for i in range(40) if i not in first][:5]


def test_choose_model_losses_are_those_of_single_fits(spark, docs):
    train, val = docs.filter("split = 'train'"), docs.filter("split = 'test'")
    for weighted in (True, False):
        best, table = learn.choose_model(train, val, "text", "marginal_text", regs=(0.5, 0.05), weighted=weighted, max_iter=8)
        weights = learn.class_weights(train, "marginal_text") if weighted else None
        for reg, loss in sorted(table.collect()):
            alone = learn.fit_text_classifier(train, "text", "marginal_text", weighted=weighted, reg=reg, max_iter=8)
            assert loss == pytest.approx(learn.validation_log_loss(alone, val, "marginal_text", weights).first()[0], abs=1e-9)
        assert learn.validation_log_loss(best, val, "marginal_text", weights).first()[0] == pytest.approx(
            min(r.log_loss for r in table.collect()), abs=1e-9)
