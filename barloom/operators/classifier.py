"""Direction classifier: labelled features to windows, Spark ML fit, repeated scoring."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.expr import argmax_first, hash_uniform
from barloom.operators import evaluate as ev
from barloom.operators.augment import augment
from barloom.operators.features import FEATURES, LOOKBACK, feature_suite, ordered_split, sequences
from barloom.operators.labels import CLASS_NAMES, adaptive_labels, class_weights, min_max, ranges
from barloom.operators.selection import select_features
from barloom.operators.series import Series, by_symbol, fill_gaps
from barloom.session import stored

SAMPLES = 5
BAG_SHARE = 0.8


def labelled_features(bars: DataFrame) -> DataFrame:
    return adaptive_labels(feature_suite(bars))


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    return fill_gaps(by_symbol(df), features).df.drop("rn")


def _scaled(df: DataFrame, features: list[str], spans: DataFrame | None = None) -> DataFrame:
    names = [f"{k}_{f}" for k in ("min", "max") for f in features]
    return min_max(df, features, spans=spans).drop(*names)


def fitted_ranges(labelled: DataFrame, features: list[str]) -> DataFrame:
    """The ranges per symbol that scale the training rows; they belong to the model, and replicas and later rows are
    scaled by them."""
    return ranges(_filled(labelled.filter("target_class IS NOT NULL"), features).na.drop(subset=features), features)


def windows(df: DataFrame, features: list[str], spans: DataFrame | None = None) -> DataFrame:
    """Scaled, flattened windows as an ML vector ``features`` with the row's class."""
    scaled = [f"scaled_{f}" for f in features]
    seq = sequences(_scaled(df, features, spans), scaled, "target_class")
    return seq.select("symbol", "ts", "target_class", array_to_vector(F.flatten("x")).alias("features"))


def training_rows(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Windows of all labelled rows with ordered split and class weight; symbols under two
    lookbacks are left out."""
    rows = _filled(labelled.filter("target_class IS NOT NULL"), features).na.drop(subset=features)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rows = rows.withColumn("_n", n).filter(F.col("_n") >= 2 * LOOKBACK).drop("_n")
    # both tables are read twice: for the ranges and the rows, for the weights and the rows
    rows = stored(rows.select("symbol", "ts", "target_class", *features), "filled")
    split = stored(ordered_split(windows(rows, features)), "split")
    weights = class_weights(split.filter("is_train").withColumn("_all", F.lit("all")), key="_all")
    return split.join(weights.select("target_class", "weight"), "target_class", "left").na.fill({"weight": 1.0})


def augmented_rows(labelled: DataFrame, features: list[str], spans: DataFrame) -> DataFrame:
    """Windows of the replicas the augmentation policy makes, every replica its own series, scaled by the range of the
    symbol it was made from."""
    rows = labelled.filter("target_class IS NOT NULL").na.drop(subset=features)
    rows = stored(rows.select("symbol", "ts", "target_class", *features), "sources")
    made = augment(rows, features).filter("replica > 0")
    series = F.concat_ws("#", "symbol", F.col("replica").cast("string"))
    made = made.select(F.col("symbol").alias("_source"), series.alias("symbol"), "ts", "target_class", *features)
    made = stored(made, "replicas")
    own = made.select("symbol", "_source").distinct().join(spans.withColumnRenamed("symbol", "_source"), "_source")
    return windows(made.drop("_source"), features, own.drop("_source"))


def fit(train: DataFrame, seed_label: str = "0", max_iter: int = 20):
    """Multinomial logistic regression on the flattened windows; one model for all symbols."""
    lr = LogisticRegression(
        featuresCol="features", labelCol="target_class", weightCol="weight", family="multinomial", maxIter=max_iter, regParam=0.01
    )
    return lr.fit(train)


def score(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("p", vector_to_array("probability"))
    keep = [c for c in rows.columns if c != "features"]
    return out.select(*keep, *[F.col("p")[i].alias(f"p{i}") for i in range(3)])


def fit_bag(train: DataFrame, n: int = SAMPLES) -> list:
    """n models, each on its own keyed share of the training rows."""
    return [fit(train.filter(hash_uniform("symbol", "ts", F.lit(b)) < BAG_SHARE)) for b in range(n)]


def score_bag(models: list, rows: DataFrame) -> DataFrame:
    """(symbol, ts, real, sample, cls, prob) of every model; takes the place of repeated
    dropout scoring."""
    out = None
    for b, model in enumerate(models):
        part = score(model, rows).withColumn("sample", F.lit(b))
        out = part if out is None else out.unionByName(part)
    cells = F.array(*[F.struct(F.lit(i).alias("cls"), F.col(f"p{i}").alias("prob")) for i in range(3)])
    return out.select("symbol", "ts", F.col("target_class").alias("real"), "sample", F.explode(cells).alias("s")).select(
        "symbol", "ts", "real", "sample", "s.*"
    )


def prediction_table(samples: DataFrame) -> DataFrame:
    """Mean probabilities with uncertainty and confidence per row."""
    return ev.sample_uncertainty(samples, ["symbol", "ts", "real"])


def with_replicas(train: DataFrame, labelled: DataFrame, features: list[str], spans: DataFrame | None = None) -> DataFrame:
    """Training windows and those of augmented replicas of the training rows, which carry
    the same class weights.  Test rows are never replicated."""
    source = labelled.join(train.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    weights = train.select("target_class", "weight").distinct()
    spans = fitted_ranges(labelled, features) if spans is None else spans
    extra = augmented_rows(source, features, spans).join(weights, "target_class")
    keep = ["symbol", "ts", "target_class", "features", "weight"]
    return train.select(*keep).unionByName(extra.select(*keep))


def train_and_evaluate(spark: SparkSession, bars: DataFrame, samples: int = SAMPLES, replicas: bool = True) -> dict:
    """Features, selection, labels, replicas, windows, split, fit, repeated scoring,
    thresholds, metrics."""
    labelled = stored(labelled_features(bars), "labelled")
    features = select_features(labelled, FEATURES, "target_class")
    rows = stored(training_rows(labelled, features), "windows")
    train = rows.filter("is_train")
    spans = stored(fitted_ranges(labelled, features), "ranges")
    if replicas:
        train = stored(with_replicas(train, labelled, features, spans), "training")
    models = fit_bag(train, samples)
    table = stored(prediction_table(score_bag(models, rows.filter("NOT is_train"))), "predictions")
    thresholds = ev.search_thresholds(table.withColumn("_all", F.lit("all")), ["_all"]).drop("_all")
    metrics = ev.confusion(table, ["symbol"]).select("symbol", *[v.alias(k) for k, v in ev.class_metrics().items()])
    return {
        "features": features,
        "labelled": labelled,
        "models": models,
        "ranges": spans,
        "predictions": table,
        "thresholds": thresholds,
        "metrics": metrics,
    }


def latest_windows(labelled: DataFrame, features: list[str], spans: DataFrame | None = None) -> DataFrame:
    """The window that ends with the newest row of every symbol, scaled by ``spans``, the model's ranges."""
    rows = _filled(labelled, features).na.drop(subset=features)
    s: Series = by_symbol(_scaled(rows, features, spans))
    x = F.collect_list(F.array(*[F.col(f"scaled_{f}") for f in features])).over(s.frames.last(LOOKBACK))
    newest = F.col("rn") == F.max("rn").over(s.frames.whole())
    df = s.df.select("symbol", "ts", "target_class", x.alias("x"), newest.alias("newest"))
    df = df.filter((F.col("newest")) & (F.size("x") == LOOKBACK))
    return df.select("symbol", "ts", "target_class", array_to_vector(F.flatten("x")).alias("features"))


def next_step(models: list, labelled: DataFrame, features: list[str], t_low: Column, t_high: Column, spans: DataFrame | None = None) -> DataFrame:
    """Class of the next bar per symbol from its newest window, with the searched thresholds and the model's ranges."""
    samples = score_bag(models, latest_windows(labelled, features, spans))
    table = ev.sample_uncertainty(samples, ["symbol", "ts"])
    cls = ev.rule_a(F.col("p0"), F.col("p2"), t_low, t_high)
    name = F.element_at(F.array(*[F.lit(CLASS_NAMES[i]) for i in range(3)]), cls + 1)
    return table.select(
        "symbol", "ts", "p0", "p1", "p2", cls.alias("class_code"), name.alias("class_name"), "uncertainty", "confidence", argmax_first(["p0", "p1", "p2"]).alias("likeliest")
    )
