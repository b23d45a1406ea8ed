"""Classifiers on Spark ML.

Transformer fine-tuning is single-machine GPU work and is not rebuilt; what
is rebuilt is the data product — a prediction table with logits per split,
trained under the same target / class-weight / split rules:

* text models: tokens -> hashed term frequencies -> IDF -> logistic
  regression (``rawPrediction`` plays the logits);
* class weights (E9) enter through ``weightCol``;
* the positional model is the network of ``plans.network`` over the 9 layout
  features;
* the combined model assembles the text vector and the network's hidden vector
  by key (never by row position);
* model choice fits all candidates on text features written once and keeps the
  one with the lowest validation log loss.

Fitting runs as Spark jobs (treeAggregate over the partitions); scoring is a
narrow ``transform`` over all splits at once.
"""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecurate.functions.logits import log_softmax_at
from pagecurate.operators.joins import zip_features
from pagecurate.operators.metrics import class_weights, weighted_log_loss, with_class_weights
from pagecurate.plans.features import TOKEN_SPLIT, standardise
from pagecurate.plans.network import Network, fit_network, with_hidden, with_logit
from pagecurate.session import ensure_checkpoint_dir, scratch_dir

#: Candidates of ``choose_model`` that are fitted side by side.
FITS_AT_ONCE = 4


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, for rows that
    several fits and scorings read."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_pipeline(text_col: str, label_col: str, weight_col: str | None = None,
                  num_features: int = 1 << 16, reg: float = 0.0, max_iter: int = 30,
                  family: str = "auto") -> Pipeline:
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_SPLIT,
                         toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=max_iter,
                            regParam=reg, family=family)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[tok, tf, idf, lr])


def predictions(model: PipelineModel, df: DataFrame, keep: list[str], n_logits: int = 2) -> DataFrame:
    """J8 + B21: input columns ``keep`` + preds + logits1..n (one pass)."""
    out = model.transform(df)
    raw = vector_to_array(F.col("rawPrediction"))
    return out.select(*keep, F.col("prediction").cast("int").alias("preds"),
                      *[raw[i].alias(f"logits{i + 1}") for i in range(n_logits)])


def fit_text_classifier(train: DataFrame, text_col: str, label_col: str,
                        weighted: bool = False, reg: float = 0.0, max_iter: int = 30,
                        family: str = "auto", fixed_weights: dict | None = None) -> PipelineModel:
    """J2 (plain), J3/J4 (inverse-frequency class weights), J5 (fixed weights,
    multinomial)."""
    src = train.withColumn("_y", F.col(label_col).cast("double"))
    weight_col = None
    if fixed_weights:
        m = F.create_map(*[F.lit(x) for kv in fixed_weights.items() for x in (float(kv[0]), float(kv[1]))])
        src = src.withColumn("_w", m[F.col("_y")])
        weight_col = "_w"
    elif weighted:
        src = with_class_weights(src, "_y", "_w")
        weight_col = "_w"
    # the fit reads its input once per stage; keep the prepared rows cached
    src = src.cache()
    try:
        return text_pipeline(text_col, "_y", weight_col, reg=reg, max_iter=max_iter, family=family).fit(src)
    finally:
        src.unpersist()


def positional_features(df: DataFrame, numeric: list[str], flags: list[str], fit_on=None,
                        per_split: str | None = None) -> DataFrame:
    """9-wide feature vector: standardised numerics (E22) + 0/1 flags."""
    z = standardise(df, numeric, fit_on=fit_on, per_split=per_split)
    z = z.select(*[c for c in z.columns if c not in flags],
                 *[F.col(c).cast("boolean").cast("double").alias(c) for c in flags])
    # rows with a missing feature are the caller's to drop (C3), not to lose here
    return VectorAssembler(inputCols=numeric + flags, outputCol="_pos", handleInvalid="error").transform(z)


def fit_positional_classifier(train: DataFrame, label_col: str, n_inputs: int = 9,
                              hidden: int = 180, depth: int = 4, steps: int = 40,
                              weight: float | None = None, seed: int = 42) -> Network:
    """The network over the positional vector (``_pos``), class 1 weighted
    by E10 unless ``weight`` is given."""
    return fit_network(train, "_pos", label_col, n_inputs, hidden, depth, steps, weight=weight, seed=seed)


def positional_predictions(net: Network, df: DataFrame, keep: list[str]) -> DataFrame:
    """J8 + B19: ``keep`` + preds + the logit of the positional network."""
    out = with_logit(df.select(*keep, "_pos"), net, "_pos")
    return out.select(*keep, (F.col("logits") > 0).cast("int").alias("preds"), "logits")


def combined_features(text_df: DataFrame, pos_df: DataFrame, net: Network, key: str) -> DataFrame:
    """The rows of ``text_df`` with the hidden vector (``_hidden``) that
    ``net`` gives for the positional vector of the same key."""
    return zip_features(text_df, with_hidden(pos_df.select(key, "_pos"), net, "_pos").select(key, "_hidden"), key)


def fit_combined_classifier(train: DataFrame, text_col: str, label_col: str, max_iter: int = 30) -> PipelineModel:
    """Text TF-IDF beside the hidden vector of ``combined_features``."""
    j = train.withColumn("_y", F.col(label_col).cast("double")).cache()
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_SPLIT, toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=1 << 16)
    idf = IDF(inputCol="_tf", outputCol="_txt")
    va = VectorAssembler(inputCols=["_txt", "_hidden"], outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=max_iter)
    try:
        return Pipeline(stages=[tok, tf, idf, va, lr]).fit(j)
    finally:
        j.unpersist()


def validation_log_loss(model, val: DataFrame, label_col: str, weights: DataFrame | None = None) -> DataFrame:
    """E17 of a fitted model's raw scores on the validation rows; with class
    ``weights`` (label, weight) of the training rows E18, the loss that the
    weighted fit minimises."""
    raw = model.transform(val).select(vector_to_array("rawPrediction").alias("_l"),
                                      F.col(label_col).cast("int").alias("_y"))
    if weights is None:
        return raw.agg(F.avg(-log_softmax_at("_l", F.col("_y"))).alias("log_loss"))
    w = weights.select(F.col(weights.columns[0]).cast("int").alias("_y"), F.col("weight").alias("_w"))
    return weighted_log_loss(raw.join(w, "_y"), "_l", "_y", "_w")


def choose_model(train: DataFrame, val: DataFrame, text_col: str, label_col: str,
                 regs=(0.0, 0.01, 0.1), weighted: bool = True, max_iter: int = 30):
    """Fit one model per ``regParam``, keep the lowest validation loss
    (class-weighted when the fit is; ties: the first).

    The text features are fitted and written once, the candidates are fitted side
    by side on them, and one job over the validation rows scores all of them.
    Returns (best model, table of (reg, log_loss))."""
    spark = train.sparkSession
    src = train.withColumn("_y", F.col(label_col).cast("double"))
    w = None
    if weighted:
        src = with_class_weights(src, "_y", "_w")
        c = class_weights(train, label_col)
        w = c.select(F.col(c.columns[0]).cast("int").alias("_y"), F.col("weight").alias("_w"))
    *text, lr = text_pipeline(text_col, "_y", "_w" if weighted else None, max_iter=max_iter).getStages()
    head = Pipeline(stages=text).fit(src)
    path = scratch_dir(spark, "choose")
    head.transform(src).select("_features", "_y", *(["_w"] if weighted else [])).write.parquet(path)
    features = spark.read.parquet(path).cache()
    fitted = [None] * len(regs)
    try:
        each = lr.fitMultiple(features, [{lr.regParam: float(r)} for r in regs])
        with ThreadPool(min(len(regs), FITS_AT_ONCE)) as pool:
            for i, m in pool.imap_unordered(lambda _: next(each), regs):
                fitted[i] = m
    finally:
        features.unpersist()
    scored = head.transform(val).select("_features", F.col(label_col).cast("int").alias("_y"))
    scored = scored.join(w, "_y") if weighted else scored.withColumn("_w", F.lit(1.0))
    for i, m in enumerate(fitted):
        scored = m.copy({m.rawPredictionCol: f"_raw{i}", m.probabilityCol: "", m.predictionCol: ""}).transform(scored)
    losses = scored.agg(*[F.try_divide(F.sum(-log_softmax_at(vector_to_array(f"_raw{i}"), F.col("_y")) * F.col("_w")),
                                       F.sum("_w")).alias(f"l{i}") for i in range(len(regs))]).first()
    rows = [(float(r), None if x is None else float(x)) for r, x in zip(regs, losses)]
    best = min(range(len(rows)), key=lambda i: (rows[i][1] is None, rows[i][1]))
    return PipelineModel(head.stages + [fitted[best]]), spark.createDataFrame(rows, "reg DOUBLE, log_loss DOUBLE")


def save_model(model: PipelineModel, name: str) -> str:
    """A10: persist at an explicit path, or under ``name`` in a folder of its
    own below the shared checkpoint folder, so that runs do not overwrite each
    other. Returns the path."""
    path = name if "/" in name else f"{ensure_checkpoint_dir(_active())}/models/{uuid.uuid4().hex}/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
