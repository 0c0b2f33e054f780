"""Feature selection: correlation filter, variance filter, importance, redundancy groups.

Sums over the rows run in Spark; the greedy choices work on the resulting p x p table of
at most a few dozen features, the same for every number of rows.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.profile import exact_quantiles, pairs

CORRELATED = 0.85
MIN_VARIANCE = 0.01
# fixed values: features to add when too few remain
ESSENTIAL = ["rsi", "macd", "atr", "volume_ratio", "day_of_week", "close"]


def variance_filter(df: DataFrame, features: list[str], key: str = "symbol") -> DataFrame:
    """Sample variance on the complete rows and whether it reaches the limit."""
    agg = df.na.drop(subset=features).groupBy(key).agg(*[F.var_samp(f).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance")) for f in features])
    long = agg.select(key, F.explode(cells).alias("s")).select(key, "s.*")
    return long.withColumn("kept", F.coalesce(F.col("variance") >= MIN_VARIANCE, F.lit(True)))


def pearson_importance(
    df: DataFrame, features: list[str], target: str, key: str = "symbol", spearman: bool = True
) -> DataFrame:
    """|Pearson| with the target on the complete rows, |Spearman| where that is undefined.

    Ranks are taken in one window per key, so ``spearman`` is for keys bounded by the calendar; ``rank_correlation``
    takes a key of any size.
    """
    rows = df.na.drop(subset=[*features, target])

    def ranked(c: str):
        """Mean rank of tied values, from counts per distinct value."""
        w = Window.partitionBy(key, "feature")
        counts = long.groupBy(key, "feature", c).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(w.orderBy(c))
        return counts.select(key, "feature", c, (upto - (F.col("n") - 1) / 2.0).alias(f"rank_{c}"))

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = rows.select(key, F.col(target).cast("double").alias("t"), F.explode(cells).alias("s")).select(key, "t", "s.*")
    pearson = long.groupBy(key, "feature").agg(
        F.corr("v", "t").alias("pearson"), (F.min("v") < F.max("v")).alias("varies")
    )
    defined = lambda c: F.when(~F.isnan(c), F.abs(F.col(c)))
    if not spearman:
        return pearson.select(key, "feature", F.coalesce(defined("pearson"), F.lit(0.0)).alias("score"))
    with_ranks = long.join(ranked("v"), [key, "feature", "v"]).join(ranked("t"), [key, "feature", "t"])
    ranks = with_ranks.groupBy(key, "feature").agg(F.corr("rank_v", "rank_t").alias("spearman"))
    both = pearson.join(ranks, [key, "feature"])
    score = F.when(F.col("varies"), F.coalesce(defined("pearson"), defined("spearman"), F.lit(0.0))).otherwise(0.0)
    return both.select(key, "feature", score.alias("score"), defined("spearman").alias("spearman"))


def ties_ranked(long: DataFrame, value: str, keys: list[str], blocks: int = 256) -> DataFrame:
    """Mean rank of every distinct value of a key of any size.

    Values are counted, the distinct ones cut into blocks between quantiles of a sketch of them, and ranked inside their
    block behind the count of the blocks before; the result is exact wherever the cuts fall.
    """
    counts = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    probs = [i / blocks for i in range(1, blocks)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, 10_000).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn("_block", F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*keys, "_block").agg(F.sum("n").alias("_in"))
    # a row per block: bounded whatever the key's size
    before = sums.withColumn("_before", F.sum("_in").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_in")).drop("_in")
    upto = F.sum("n").over(Window.partitionBy(*keys, "_block").orderBy(value))
    ranked = placed.withColumn("_upto", upto).join(before, [*keys, "_block"])
    return ranked.select(*keys, value, (F.col("_before") + F.col("_upto") - (F.col("n") - 1) / 2.0).alias(f"rank_{value}"))


def rank_correlation(df: DataFrame, features: list[str], target: str, key: str = "symbol") -> DataFrame:
    """Spearman's correlation of each feature with the target on the complete rows, ties at their mean rank, for
    keys of any size: (key, feature, spearman), null where one of the two does not vary."""
    rows = df.na.drop(subset=[*features, target]).withColumn("t", F.col(target).cast("double"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    # distinct pairs with their number, so that copies of a pair meet the ranks once
    pairs_ = rows.select(key, "t", F.explode(cells).alias("s")).groupBy(key, F.col("s.feature").alias("feature"), F.col("s.v").alias("v"), "t").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ranked = pairs_.join(ties_ranked(rows.select(key, "t"), "t", [key]), [key, "t"])
    ranked = ranked.join(ties_ranked(rows.select(key, F.explode(cells).alias("s")).select(key, "s.*"), "v", [key, "feature"]), [key, "feature", "v"])
    # sums about the middle rank, the same for both sides: all ranks of a key add up to n (n + 1) / 2
    middle = rows.groupBy(key).agg(((F.count(F.lit(1)) + 1) / 2.0).alias("_mid"))
    x, y, w = F.col("rank_v") - F.col("_mid"), F.col("rank_t") - F.col("_mid"), F.col("w")
    sums = ranked.join(middle, key).groupBy(key, "feature").agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    return sums.select(key, "feature", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))


def mutual_information(
    df: DataFrame, features: list[str], target: str, bins: int = 10, key: str = "symbol", bounded: bool = True
) -> DataFrame:
    """Mutual information (nats) of a class with each feature cut at its deciles.

    Only counts per (key, feature, bin, class) leave the tasks.  ``bounded`` takes the
    deciles with one aggregate per group (a symbol's bars); without it they come from
    ``exact_quantiles``, which spreads a group of any size.
    """
    rows = df.na.drop(subset=[*features, target])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = rows.select(key, F.col(target).alias("cls"), F.explode(cells).alias("s")).select(key, "cls", "s.*")
    probs = [i / bins for i in range(1, bins)]
    if bounded:
        cuts = long.groupBy(key, "feature").agg(F.percentile("v", probs).alias("cuts"))
    else:
        cuts = exact_quantiles(long, "v", probs, [key, "feature"]).groupBy(key, "feature").agg(
            F.collect_list("value").alias("cuts")
        )
    bin_of = F.size(F.filter("cuts", lambda cut: cut < F.col("v")))
    binned = long.join(cuts, [key, "feature"]).withColumn("bin", bin_of)
    joint = binned.groupBy(key, "feature", "bin", "cls").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key, "feature"))
    n_bin = F.sum("n").over(Window.partitionBy(key, "feature", "bin"))
    n_cls = F.sum("n").over(Window.partitionBy(key, "feature", "cls"))
    term = F.col("n") / total * F.ln(F.col("n") * total / (n_bin * n_cls))
    terms = joint.withColumn("term", term)
    return terms.groupBy(key, "feature").agg(F.greatest(F.lit(0.0), F.sum("term")).alias("score"))


def redundancy_groups(features: list[str], corr: dict[tuple[str, str], float]) -> list[list[str]]:
    """Each feature not yet grouped collects the later ones it is strongly correlated with."""
    left, groups = list(features), []
    while left:
        head, rest = left[0], left[1:]
        close = [f for f in rest if abs(corr.get((head, f), 0.0)) > CORRELATED]
        if close:
            groups.append([head, *close])
        left = [f for f in rest if f not in close]
    return groups


def correlation_filter(features: list[str], corr: dict[tuple[str, str], float], target: dict[str, float]) -> list[str]:
    """Of two strongly correlated features the one less correlated with the target goes
    (the later one on a tie); pairs are visited by their later feature."""
    gone: set[str] = set()
    for j, b in enumerate(features):
        for a in features[:j]:
            if abs(corr.get((a, b), 0.0)) > CORRELATED and not {a, b} & gone:
                gone.add(a if target.get(a, 0.0) < target.get(b, 0.0) else b)
    return [f for f in features if f not in gone] or features


def relations(df: DataFrame, features: list[str], target: str) -> dict:
    """Everything the filters need over all symbols: correlations and variances on the
    complete rows, |correlation| with the target.

    The covariance of the feature vector is one distributed Gram-matrix pass whose result
    has a row per feature, whatever the number of rows.
    """
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(df.na.drop(subset=features)).select("v")
    corr = Correlation.corr(vectors, "v").first()[0].toArray()
    cells = [F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct(target).alias("n_target")]
    row = df.agg(*cells, *[F.abs(F.corr(f, target)).alias(f"target|{f}") for f in features]).first()
    spread = vectors.select(Summarizer.variance(F.col("v")).alias("s")).first()["s"]
    return {
        "n_rows": row["n_rows"],
        "n_target": row["n_target"],
        "corr": {(a, b): float(corr[i, j]) for i, a in enumerate(features) for j, b in enumerate(features) if i < j},
        "variance": {f: float(spread[i]) for i, f in enumerate(features)},
        "target": {f: row[f"target|{f}"] or 0.0 for f in features},
    }


def select_features(df: DataFrame, features: list[str], target: str, max_features: int = 12) -> list[str]:
    """Correlation filter, variance filter, then the top by importance, whatever the number
    of rows.  Fewer than ten features are all kept."""
    if len(features) < 10:
        return features
    rel = relations(df, features, target)
    kept = correlation_filter(features, rel["corr"], rel["target"])
    varied = [f for f in kept if rel["variance"][f] >= MIN_VARIANCE]
    kept = varied or kept
    all_rows = df.withColumn("_all", F.lit("all"))
    if rel["n_target"] < 10:
        scores = mutual_information(all_rows, kept, target, key="_all", bounded=False)
    else:
        # the rank correlation where the plain one is zero or not defined
        plain = pearson_importance(all_rows, kept, target, key="_all", spearman=False).withColumn("score", F.nullif("score", F.lit(0.0)))
        ranks = rank_correlation(all_rows, kept, target, key="_all")
        scores = plain.join(ranks, ["_all", "feature"], "left").withColumn("score", F.coalesce("score", F.abs("spearman"), F.lit(0.0)))
    by_score = {r["feature"]: r["score"] for r in scores.collect()}  # one row per feature
    order = sorted(kept, key=lambda f: -(by_score.get(f) or 0.0))
    kept = order[: max(4, min(max_features, int(len(order) * 0.8)))]
    for extra in ESSENTIAL:
        if len(kept) < 4 and extra not in kept:
            kept.append(extra)
    return kept


