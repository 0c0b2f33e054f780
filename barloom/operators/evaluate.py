"""Evaluation of forecasts and class probabilities.

Every metric starts from one grouped count (nine confusion cells, merged map-side), so
the scored rows are read once and never leave their task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import argmax_first, c, clip, ratio
from barloom.operators.labels import CLASS_NAMES
from barloom.operators.lookups import best_of_grid

K = 3
CELLS = [f"n{i}{j}" for i in range(K) for j in range(K)]
PROBS = ["p0", "p1", "p2"]


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _or0(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num.cast("double"), den.cast("double")), F.lit(0.0))


# -- forecasts ----------------------------------------------------------------------------


def regression_metrics(df: DataFrame, key: str = "symbol", order: str = "ts") -> DataFrame:
    """MAE, RMSE and directional hits of ``actual`` against ``predicted`` in time order; a
    key without rows has no result row."""
    w = Window.partitionBy(key).orderBy(order)
    moved = lambda x: F.signum(c(x) - F.lag(x).over(w))
    df = df.withColumns({"_a": moved("actual"), "_p": moved("predicted")})
    err = F.col("actual") - F.col("predicted")
    agg = df.groupBy(key).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.count(F.when(F.col("_a") == F.col("_p"), 1)).alias("hits"),
        F.count("_a").alias("comparisons"),
    )
    return agg.withColumn("hit_rate", _or0(F.col("hits"), F.col("comparisons")))


# -- confusion cells and what follows from them ------------------------------------------------


def confusion(df: DataFrame, keys: list[str], real: str = "real", predicted: Column | None = None) -> DataFrame:
    """Nine cells ``n<real><predicted>`` per key."""
    pred = argmax_first(PROBS) if predicted is None else predicted
    df = df.select(*keys, F.col(real).alias("_r"), pred.alias("_p"))
    return df.groupBy(*keys).agg(
        *[F.count(F.when((F.col("_r") == i) & (F.col("_p") == j), 1)).alias(f"n{i}{j}") for i in range(K) for j in range(K)]
    )


def _support(i: int) -> Column:
    return _sum([F.col(f"n{i}{j}") for j in range(K)])


def _called(j: int) -> Column:
    return _sum([F.col(f"n{i}{j}") for i in range(K)])


def _precision(i: int) -> Column:
    return _or0(F.col(f"n{i}{i}"), _called(i))


def _recall(i: int) -> Column:
    return _or0(F.col(f"n{i}{i}"), _support(i))


def _f1(i: int) -> Column:
    return _or0(2.0 * F.col(f"n{i}{i}"), _support(i) + _called(i))


def _weighted(metric) -> Column:
    return _or0(_sum([metric(i) * _support(i) for i in range(K)]), _sum([_support(i) for i in range(K)]))


def class_metrics() -> dict[str, Column]:
    hits = _sum([F.col(f"n{i}{i}") for i in range(K)])
    total = _sum([F.col(x) for x in CELLS])
    out = {
        "accuracy": _or0(hits, total),
        "precision_weighted": _weighted(_precision),
        "recall_weighted": _weighted(_recall),
        "f1_weighted": _weighted(_f1),
        "balanced_accuracy": _sum([_recall(i) for i in range(K)]) / float(K),
    }
    for i in range(K):
        name = CLASS_NAMES[i].lower()
        out |= {f"precision_{name}": _precision(i), f"recall_{name}": _recall(i), f"f1_{name}": _f1(i)}
    return out


def class_counts() -> dict[str, Column]:
    out = {f"real_{CLASS_NAMES[i].lower()}": _support(i) for i in range(K)}
    out |= {f"predicted_{CLASS_NAMES[i].lower()}": _called(i) for i in range(K)}
    return out


def balanced_metrics() -> dict[str, Column]:
    """Cohen's kappa, geometric mean and sensitivities; classes are those that occur as
    real or predicted."""
    total = _sum([F.col(x) for x in CELLS]).cast("double")
    po = _or0(_sum([F.col(f"n{i}{i}") for i in range(K)]), total)
    pe = _or0(_sum([_support(i).cast("double") * _called(i) for i in range(K)]), total * total)
    present = [(_support(i) + _called(i)) > 0 for i in range(K)]
    k = _sum([p.cast("int") for p in present])
    prod = reduce(lambda a, b: a * b, [F.when(p, _recall(i)).otherwise(1.0) for i, p in enumerate(present)])
    recalls = _sum([F.when(p, _recall(i)).otherwise(0.0) for i, p in enumerate(present)])
    out = {
        "kappa": ratio(po - pe, 1.0 - pe),
        "gmean": F.pow(prod, 1.0 / k),
        "balanced_accuracy": recalls / k,
    }
    return out | {f"sensitivity_{CLASS_NAMES[i].lower()}": F.when(p, _recall(i)) for i, p in enumerate(present)}


def confidence_metrics(df: DataFrame, key: str = "symbol") -> DataFrame:
    top = F.greatest(*PROBS)
    return df.groupBy(key).agg(
        F.avg(top).alias("mean_confidence"), F.avg((top < 0.5).cast("double")).alias("low_confidence_ratio")
    )


def symbol_consistency(df: DataFrame, limit: float = 0.55) -> DataFrame:
    """Balanced accuracy per symbol, whether each reaches the limit, and whether all do."""
    agg = confusion(df, ["symbol"]).select("symbol", class_metrics()["balanced_accuracy"].alias("balanced_accuracy"))
    ok = F.col("balanced_accuracy") >= limit
    overall = agg.agg(F.struct(F.min(ok).alias("consistent"), F.avg("balanced_accuracy").alias("overall")).alias("o"))
    out = agg.select("symbol", "balanced_accuracy", ok.alias("meets_limit"), overall.scalar().alias("o"))
    return out.select("symbol", "balanced_accuracy", "meets_limit", "o.*")


# -- thresholds -----------------------------------------------------------------------------


def rule_a(p0: Column, p2: Column, t0: Column, t2: Column) -> Column:
    """LOW first, then HIGH."""
    return F.when(p0 > t0, 0).when(p2 > t2, 2).otherwise(1)


def rule_b(p0: Column, p2: Column, t0: Column, t2: Column) -> Column:
    """HIGH first, then LOW."""
    return F.when(p2 > t2, 2).when(p0 > t0, 0).otherwise(1)


# fixed values: grid A
LOW_STEPS = [0.4, 0.5, 0.6, 0.7]
NEUTRAL_STEPS = [0.3, 0.4, 0.5, 0.6]
HIGH_STEPS = [0.4, 0.5, 0.6, 0.7]


def search_thresholds(df: DataFrame, keys: list[str]) -> DataFrame:
    """Best of the 64 threshold triples by weighted F1, first in loop order on ties.

    Rows are first counted by the step their probabilities pass (at most 75 cells per
    key); only those cells meet the grid.
    """
    passed = lambda p, steps: _sum([(F.col(p) > t).cast("int") for t in steps])
    cells = df.groupBy(
        *keys, "real", passed("p0", LOW_STEPS).alias("b0"), passed("p2", HIGH_STEPS).alias("b2")
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(m).alias("m"))
            for i in range(4)
            for m in range(4)
            for k in range(4)
        ]
    )
    g = cells.withColumn("g", F.explode(grid)).select("*", "g.*")
    pred = F.when(F.col("b0") > F.col("i"), 0).when(F.col("b2") > F.col("k"), 2).otherwise(1)
    counts = g.withColumn("pred", pred).groupBy(*keys, "i", "m", "k").agg(
        *[
            F.sum(F.when((F.col("real") == a) & (F.col("pred") == b), F.col("n")).otherwise(0)).alias(f"n{a}{b}")
            for a in range(K)
            for b in range(K)
        ]
    )
    step = lambda steps, i: F.element_at(F.array(*[F.lit(s) for s in steps]), F.col(i) + 1)
    scored = counts.select(
        *keys,
        (F.col("i") * 16 + F.col("m") * 4 + F.col("k")).alias("place"),
        step(LOW_STEPS, "i").alias("t_low"),
        step(NEUTRAL_STEPS, "m").alias("t_neutral"),
        step(HIGH_STEPS, "k").alias("t_high"),
        F.round(_weighted(_f1), 12).alias("f1"),
    )
    best = best_of_grid(scored, "f1", "place", keys, ["t_low", "t_neutral", "t_high"])
    default = lambda t: F.when(F.col("f1") > 0, F.col(t)).otherwise(0.33).alias(t)
    return best.select(*keys, default("t_low"), default("t_neutral"), default("t_high"), "f1")


# fixed values: grid B
B_LO, B_HI, B_STEPS, B_INNER = 0.001, 0.050, 1000, 100


def _thresholds_b(steps: int, inner: int) -> tuple[list[float], list[list[float]]]:
    """The first thresholds, and for each the second ones: even steps from just above it to the upper end."""
    width = (B_HI - B_LO) / (steps - 1)
    first = [B_LO + i * width for i in range(steps)]
    second = []
    for t in first:
        start = t + 0.001
        step = (B_HI - start) / (inner - 1)
        second.append([start + k * step for k in range(inner)])
    return first, second


def _passed(df: DataFrame, p: str, thresholds: list[float], out: str) -> DataFrame:
    """How many of the ascending ``thresholds`` a probability is above, by bisection in a JVM bucketizer; a null passes
    none.  Buckets are closed below, so negated values are counted from above."""
    splits = [-float("inf"), *[-t for t in reversed(thresholds)], float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket")
    # -p lies in bucket k where k thresholds are at or above p
    above = F.lit(len(thresholds)) - F.col("_bucket").cast("int")
    return cut.transform(df.withColumn("_x", -F.coalesce(p, F.lit(-1.0)))).withColumn(out, above).drop("_x", "_bucket")


def search_thresholds_fine(df: DataFrame, steps: int = B_STEPS, inner: int = B_INNER) -> DataFrame:
    """Best of ``steps`` x ``inner`` threshold pairs by weighted F1 (rule B) over one prediction set.

    Each first threshold i has its own second ones.  The rows become one histogram: (steps passed by p0, place of p2 in the
    sorted union of all second thresholds, class).  A pair then asks how many rows have p0 above i and p2 up to its own
    threshold.  Rows with p0 above i are the disjoint union of dyadic ranges of the p0 axis, at most log2(steps) of them;
    each range holds running sums along the p2 axis, where the pair looks its count up.  After the histogram no table
    depends on the number of rows: at most ``steps`` * ``inner`` + 1 places a class and range, ``steps`` * ``inner`` *
    log2(steps) lookups, and no task has more than one range.
    """
    first, second = _thresholds_b(steps, inner)
    union = sorted({t for row in second for t in row})
    at = {t: j for j, t in enumerate(union)}
    placed = _passed(_passed(df.select("real", "p0", "p2"), "p0", first, "b"), "p2", union, "place")
    cells = placed.groupBy("b", "place").agg(*[F.count(F.when(F.col("real") == r, 1)).alias(f"c{r}") for r in range(K)])
    levels = range(max(1, steps.bit_length()))
    counts = [f"c{r}" for r in range(K)]

    def dyadic(rows: DataFrame, range_of) -> DataFrame:
        """Each row once per level on which ``range_of`` gives it a range."""
        found = F.filter(F.array(*[range_of(level) for level in levels]), lambda x: x["node"].isNotNull())
        return rows.withColumn("_at", F.explode(found)).select("*", "_at.level", "_at.node").drop("_at")

    def node(level: int, of: Column, used: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.when(used, of).alias("node"))

    # a value lies in one range a level; only ranges with an odd number are ever asked for
    holds = lambda level: node(level, F.shiftright("b", level), F.shiftright("b", level) % 2 == 1)
    held = dyadic(cells, holds).groupBy("level", "node", "place").agg(*[F.sum(n).alias(n) for n in counts])
    everything = cells.groupBy(F.lit(-1).alias("level"), F.lit(0).alias("node"), "place").agg(*[F.sum(n).alias(n) for n in counts])
    # the pairs, from the first threshold's number; places are constants
    pairs = df.sparkSession.createDataFrame([(i, [at[t] for t in row]) for i, row in enumerate(second)], "i int, places array<int>")
    pairs = pairs.select("i", F.posexplode("places").alias("k", "place"))
    up = lambda level: F.shiftright(F.col("i") + F.lit(1 << level), level)  # noqa: E731  the least range at i + 1 or above
    asks = lambda level: node(level, up(level), (up(level) % 2 == 1) & (F.shiftleft(up(level), level) <= steps))
    lookups = dyadic(pairs, asks).unionByName(pairs.select("*", F.lit(-1).alias("level"), F.lit(0).alias("node")))
    none = [F.lit(None).cast("long").alias(n) for n in counts]
    both = held.unionByName(everything).select("level", "node", "place", *counts, F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("k"))
    both = both.unionByName(lookups.select("level", "node", "place", *none, "i", "k"))
    whole = Window.partitionBy("level", "node")
    upto = whole.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.withColumns({f"u{r}": F.coalesce(F.sum(f"c{r}").over(upto), F.lit(0)) for r in range(K)} | {f"t{r}": F.coalesce(F.sum(f"c{r}").over(whole), F.lit(0)) for r in range(K)})
    of = lambda x, which: F.sum(F.when(which, F.col(x)).otherwise(0))
    all_rows = F.col("level") == -1
    found = sums.where("i IS NOT NULL").groupBy("i", "k").agg(
        *[of(f"u{r}", ~all_rows).alias(f"n{r}0") for r in range(K)],
        *[(of(f"u{r}", all_rows) - of(f"u{r}", ~all_rows)).alias(f"n{r}1") for r in range(K)],
        *[(of(f"t{r}", all_rows) - of(f"u{r}", all_rows)).alias(f"n{r}2") for r in range(K)],
    )
    t1 = B_LO + F.col("i") * ((B_HI - B_LO) / (steps - 1))
    start = t1 + 0.001
    scored = found.select(
        F.lit(1).alias("one"),
        (F.col("i") * inner + F.col("k")).alias("place"),
        t1.alias("t_low"),
        (start + F.col("k") * ((B_HI - start) / (inner - 1))).alias("t_high"),
        F.round(_weighted(_f1), 12).alias("f1"),
    )
    return best_of_grid(scored, "f1", "place", ["one"], ["t_low", "t_high"]).drop("one", "place")


# -- repeated-sample scoring ---------------------------------------------------------------------


def sample_uncertainty(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: mean probability, population variance, 5/95 percentile of every class over
    the samples; total uncertainty, confidence and entropy."""
    per_class = samples.groupBy(*keys, "cls").agg(
        F.avg("prob").alias("mean"),
        F.var_pop("prob").alias("var"),
        F.percentile("prob", [0.05, 0.95]).alias("band"),
    )
    pick = lambda i, x: F.max(F.when(F.col("cls") == i, x))
    agg = per_class.groupBy(*keys).agg(
        *[pick(i, F.col("mean")).alias(f"p{i}") for i in range(K)],
        *[pick(i, F.col("var")).alias(f"var_p{i}") for i in range(K)],
        *[pick(i, F.col("band")[0]).alias(f"lo_p{i}") for i in range(K)],
        *[pick(i, F.col("band")[1]).alias(f"hi_p{i}") for i in range(K)],
        F.avg("var").alias("uncertainty"),
        (-F.sum(F.col("mean") * F.ln(F.col("mean") + 1e-8))).alias("entropy"),
    )
    return agg.withColumn("confidence", 1.0 - clip("uncertainty", 0.0, 1.0))


def ensembles(members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, weighted mean (``weight`` per member), majority vote (lowest class on ties),
    and a mean with weights 1/(1 + the member's mean squared distance from the row's mean)."""
    row = Window.partitionBy(*keys, "cls")
    df = members.withColumn("_d", F.col("prob") - F.avg("prob").over(row))
    wide = df.groupBy(*keys, "member").agg(
        *[F.max(F.when(F.col("cls") == i, F.col("prob"))).alias(f"p{i}") for i in range(K)],
        F.max("weight").alias("weight"),
        F.avg(F.col("_d") * F.col("_d")).alias("_var"),
    )
    wide = wide.withColumns({"_vote": argmax_first(PROBS), "_vw": 1.0 / (1.0 + F.col("_var"))})
    mean_of = lambda p, w: F.sum(F.col(p) * F.col(w)) / F.sum(w)
    votes = [F.count(F.when(F.col("_vote") == i, 1)).alias(f"votes_{i}") for i in range(K)]
    agg = wide.groupBy(*keys).agg(
        *[F.avg(p).alias(f"mean_{p}") for p in PROBS],
        *[mean_of(p, "weight").alias(f"weighted_{p}") for p in PROBS],
        *[mean_of(p, "_vw").alias(f"variance_weighted_{p}") for p in PROBS],
        *[F.var_pop(p).alias(f"variance_{p}") for p in PROBS],
        *votes,
    )
    return agg.withColumn("majority_vote", argmax_first([f"votes_{i}" for i in range(K)]))


def calibration(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Expected calibration error (unweighted over non-empty bins of ``uncertainty``) and
    the temperature it asks for."""
    hit = (argmax_first(PROBS) == F.col("real")).cast("double")
    binned = df.filter("uncertainty >= 0 AND uncertainty < 1").groupBy(
        key, F.floor(F.col("uncertainty") * 10).alias("bin")
    ).agg(F.avg(hit).alias("accuracy"), F.avg(1.0 - F.col("uncertainty")).alias("confidence"))
    agg = binned.groupBy(key).agg(F.avg(F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))
    return agg.withColumn("temperature", F.when(F.col("ece") > 0.1, 1.5).otherwise(1.0))


def calibrated(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Probabilities at the key's temperature and the uncertainty they leave."""
    df = df.join(calibration(df, key), key)
    hot = {f"_{p}": F.pow(F.col(p), 1.0 / F.col("temperature")) for p in PROBS}
    df = df.withColumns(hot)
    total = _sum([F.col(f"_{p}") for p in PROBS])
    df = df.withColumns({f"calibrated_{p}": ratio(f"_{p}", total) for p in PROBS}).drop(*[f"_{p}" for p in PROBS])
    return df.withColumn("calibrated_uncertainty", 1.0 - F.greatest(*[f"calibrated_{p}" for p in PROBS]))


# -- training history, loss, report -----------------------------------------------------------------


def history_diagnostics(history: DataFrame) -> DataFrame:
    """Overfitting and convergence signs per run of (epoch, loss, val_loss, acc, val_acc)."""
    w = Window.partitionBy("run")
    df = history.withColumns(
        {"back": F.row_number().over(w.orderBy(F.desc("epoch"))), "epochs": F.count(F.lit(1)).over(w)}
    ).filter("back <= 10")
    at = lambda x, k: F.max(F.when(F.col("back") == k, F.col(x)))
    last3 = lambda x: F.avg(F.when(F.col("back") <= 3, F.col(x)))
    five = F.when(F.col("back") <= 5, F.col("val_loss"))
    agg = df.groupBy("run", "epochs").agg(
        (at("val_loss", 1) - at("loss", 1)).alias("loss_gap"),
        F.when(at("loss", 1) > 0, at("val_loss", 1) / at("loss", 1)).alias("loss_ratio"),
        (at("acc", 1) - at("val_acc", 1)).alias("accuracy_gap"),
        (last3("val_loss") - last3("loss")).alias("recent_loss_gap"),
        F.regr_slope(five, -F.col("back").cast("double")).alias("val_loss_slope"),
        (at("loss", 10) - at("loss", 1)).alias("improvement"),
    )
    high_ratio, wide_gap = F.col("loss_ratio") > 1.5, F.col("accuracy_gap") > 0.15
    enough, long_run = F.col("epochs") > 5, F.col("epochs") > 10
    return agg.select(
        "run",
        "epochs",
        "loss_gap",
        "loss_ratio",
        "accuracy_gap",
        F.concat_ws(
            ",", F.when(high_ratio, F.lit("high_loss_ratio")), F.when(wide_gap, F.lit("high_accuracy_gap"))
        ).alias("indicators"),
        (high_ratio | wide_gap).alias("overfitting"),
        F.when(enough, F.col("recent_loss_gap") > 0.15).alias("recent_overfitting"),
        F.when(enough, F.col("recent_loss_gap")).alias("recent_loss_gap"),
        F.when(long_run, F.col("val_loss_slope") > 0.01).alias("overfitting_trend"),
        F.when(long_run, F.col("improvement") < 0.001).alias("converged"),
        F.when(long_run, F.col("improvement") / 10.0).alias("improvement_rate"),
    )


def focal_loss(real: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of one scored row, probabilities clipped to 1e-7."""
    p = F.when(real == 0, F.col("p0")).when(real == 1, F.col("p1")).otherwise(F.col("p2"))
    p = clip(p, 1e-7, 1.0 - 1e-7)
    return alpha * F.pow(1.0 - p, F.lit(gamma)) * -F.ln(p)


def prediction_report(df: DataFrame) -> DataFrame:
    """Real against predicted with names, hit flag and confidence band."""
    name = lambda x: F.when(x == 0, CLASS_NAMES[0]).when(x == 1, CLASS_NAMES[1]).when(x == 2, CLASS_NAMES[2])
    pred = argmax_first(PROBS)
    conf = F.col("confidence")
    return df.select(
        "symbol",
        "ts",
        name(F.col("real")).alias("real_class"),
        name(pred).alias("predicted_class"),
        *PROBS,
        "uncertainty",
        (F.col("real") == pred).alias("hit"),
        F.when(conf > 0.6, "high").when(conf > 0.4, "medium").otherwise("low").alias("confidence_band"),
    )
