"""Evaluation queries.

The scored rows are the labelled index bars with three keyed random probabilities, so the
comparison SQL can rebuild them; models produce the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import hash_uniform, rounded, rounded_cols
from barloom.operators import evaluate as ev
from barloom.operators import labels as lb
from barloom.operators import series as se
from barloom.plans import sql as q
from barloom.plans.profile_queries import CLASS_SQL, labelled
from barloom.plans.registry import query
from barloom.sources import tables


def _u(tag: str) -> str:
    return q.hash_u(f"symbol || ':' || ts || ':{tag}'")


SCORED_SQL = f"""us AS (SELECT symbol, ts, target_class AS real, {_u('p0')} AS u0, {_u('p1')} AS u1, {_u('p2')} AS u2 FROM classes WHERE target_class IS NOT NULL),
ps AS (SELECT symbol, ts, real, round(u0 / (u0 + u1 + u2), 6) AS p0, round(u1 / (u0 + u1 + u2), 6) AS p1, round(u2 / (u0 + u1 + u2), 6) AS p2 FROM us),
scored AS (SELECT *, round(1 - greatest(p0, p1, p2), 6) AS uncertainty, greatest(p0, p1, p2) AS confidence,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM ps)"""
BASE = [q.INDEX_BARS, CLASS_SQL, SCORED_SQL]


def scored(spark, sf):
    df = labelled(spark, sf).filter("target_class IS NOT NULL")
    df = df.select("symbol", "ts", F.col("target_class").alias("real"), *[hash_uniform("symbol", "ts", F.lit(p)).alias(f"u_{p}") for p in ev.PROBS])
    total = F.col("u_p0") + F.col("u_p1") + F.col("u_p2")
    df = df.select("symbol", "ts", "real", *[F.round(F.col(f"u_{p}") / total, 6).alias(p) for p in ev.PROBS])
    top = F.greatest(*ev.PROBS)
    return df.withColumns({"uncertainty": F.round(1.0 - top, 6), "confidence": top})


PAIRS_SQL = """pr AS (SELECT symbol, ts, rn, close AS actual, avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) AS predicted FROM num)"""


@query(
    "eva_01_regression",
    q.with_(q.ORDER_BARS, q.NUMBERED, PAIRS_SQL)
    + f"""SELECT symbol, {q.rnd('avg(abs(actual - predicted))')} AS mae, {q.rnd('sqrt(avg(pow(actual - predicted, 2)))')} AS rmse,
  count(CASE WHEN a = p THEN 1 END) AS hits, count(a) AS comparisons, {q.rnd('count(CASE WHEN a = p THEN 1 END) * 1.0 / count(a)')} AS hit_rate FROM (
  SELECT *, sign(actual - lag(actual) OVER w) AS a, sign(round(predicted, 6) - lag(round(predicted, 6)) OVER w) AS p FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY rn)) GROUP BY 1""",
)
def eva_01(spark, sf):
    """The close against its own five-bar mean."""
    s = se.by_symbol(tables.order_bars(spark, sf))
    df = s.df.select("symbol", "ts", F.col("close").alias("actual"), F.round(F.avg("close").over(s.frames.last(5)), 6).alias("predicted"))
    out = ev.regression_metrics(df)
    return out.select("symbol", *rounded_cols(["mae", "rmse", "hit_rate"]), "hits", "comparisons")


CELLS_SQL = "cm AS (SELECT symbol, " + ", ".join(
    f"count(*) FILTER (real = {i} AND pred = {j}) AS n{i}{j}" for i in range(3) for j in range(3)
) + " FROM scored GROUP BY 1), sm AS (SELECT *, " + ", ".join(
    [f"n{i}0 + n{i}1 + n{i}2 AS s{i}, n0{i} + n1{i} + n2{i} AS c{i}" for i in range(3)]
) + ", " + " + ".join(ev.CELLS) + " AS n FROM cm)"


@query(
    "eva_02_confusion",
    q.with_(*BASE, CELLS_SQL)
    + f"SELECT symbol, {', '.join(ev.CELLS)}, s0 AS real_low, s1 AS real_neutral, s2 AS real_high, c0 AS predicted_low, c1 AS predicted_neutral, c2 AS predicted_high FROM sm",
)
def eva_02(spark, sf):
    return ev.confusion(scored(spark, sf), ["symbol"]).withColumns(ev.class_counts())


def _rate(a: str, b: str) -> str:
    return f"coalesce({a} * 1.0 / nullif({b}, 0), 0)"


def _f1_sql(i: int) -> str:
    return _rate(f"2 * n{i}{i}", f"(s{i} + c{i})")


METRIC_SQL = {
    "accuracy": "(n00 + n11 + n22) * 1.0 / n",
    "precision_weighted": "(" + " + ".join(f"{_rate(f'n{i}{i}', f'c{i}')} * s{i}" for i in range(3)) + ") / n",
    "recall_weighted": "(" + " + ".join(f"{_rate(f'n{i}{i}', f's{i}')} * s{i}" for i in range(3)) + ") / n",
    "f1_weighted": "(" + " + ".join(f"{_f1_sql(i)} * s{i}" for i in range(3)) + ") / n",
    "balanced_accuracy": "(" + " + ".join(_rate(f"n{i}{i}", f"s{i}") for i in range(3)) + ") / 3",
}
for _i, _name in enumerate(("low", "neutral", "high")):
    METRIC_SQL |= {f"precision_{_name}": _rate(f"n{_i}{_i}", f"c{_i}"), f"recall_{_name}": _rate(f"n{_i}{_i}", f"s{_i}"), f"f1_{_name}": _f1_sql(_i)}


@query(
    "eva_03_classification",
    q.with_(*BASE, CELLS_SQL) + "SELECT symbol, " + ", ".join(f"{q.rnd(v)} AS {k}" for k, v in METRIC_SQL.items() if k != "balanced_accuracy") + " FROM sm",
)
def eva_03(spark, sf):
    m = ev.class_metrics()
    m.pop("balanced_accuracy")
    return ev.confusion(scored(spark, sf), ["symbol"]).select("symbol", *[rounded(v).alias(k) for k, v in m.items()])


@query(
    "eva_04_balanced_accuracy",
    q.with_(*BASE, CELLS_SQL) + f"SELECT symbol, {q.rnd(METRIC_SQL['balanced_accuracy'])} AS balanced_accuracy FROM sm",
)
def eva_04(spark, sf):
    value = ev.class_metrics()["balanced_accuracy"]
    return ev.confusion(scored(spark, sf), ["symbol"]).select("symbol", rounded(value).alias("balanced_accuracy"))


@query(
    "eva_05_kappa_gmean",
    q.with_(*BASE, CELLS_SQL)
    + f"""SELECT symbol, {q.rnd('(po - pe) / nullif(1 - pe, 0)')} AS kappa, {q.rnd('pow(r0 * r1 * r2, 1.0 / 3)')} AS gmean, {q.rnd('(r0 + r1 + r2) / 3')} AS balanced_accuracy,
  {q.rnd('r0')} AS sensitivity_low, {q.rnd('r1')} AS sensitivity_neutral, {q.rnd('r2')} AS sensitivity_high FROM (
  SELECT *, (n00 + n11 + n22) * 1.0 / n AS po, (s0 * c0 + s1 * c1 + s2 * c2) * 1.0 / (n * n) AS pe, {', '.join(f"{_rate(f'n{i}{i}', f's{i}')} AS r{i}" for i in range(3))} FROM sm)""",
)
def eva_05(spark, sf):
    m = ev.balanced_metrics()
    return ev.confusion(scored(spark, sf), ["symbol"]).select("symbol", *[rounded(v).alias(k) for k, v in m.items()])


@query(
    "eva_06_confidence",
    q.with_(*BASE) + f"SELECT symbol, {q.rnd('avg(confidence)')} AS mean_confidence, {q.rnd('avg((confidence < 0.5)::INT)')} AS low_confidence_ratio FROM scored GROUP BY 1",
)
def eva_06(spark, sf):
    df = ev.confidence_metrics(scored(spark, sf))
    return df.select("symbol", *rounded_cols(["mean_confidence", "low_confidence_ratio"]))


@query(
    "eva_07_threshold_rules",
    q.with_(*BASE)
    + """SELECT symbol, ts, CASE WHEN p0 > 0.5 THEN 0 WHEN p2 > 0.4 THEN 2 ELSE 1 END AS rule_a, CASE WHEN p2 > 0.4 THEN 2 WHEN p0 > 0.3 THEN 0 ELSE 1 END AS rule_b FROM scored""",
)
def eva_07(spark, sf):
    p0, p2 = F.col("p0"), F.col("p2")
    a = ev.rule_a(p0, p2, F.lit(0.5), F.lit(0.4))
    b = ev.rule_b(p0, p2, F.lit(0.3), F.lit(0.4))
    return scored(spark, sf).select("symbol", "ts", a.alias("rule_a"), b.alias("rule_b"))


GRID_F1 = """SELECT symbol, t0, t1, t2, place, round((coalesce(2.0 * n00 / nullif(s0 + c0, 0), 0) * s0 + coalesce(2.0 * n11 / nullif(s1 + c1, 0), 0) * s1
    + coalesce(2.0 * n22 / nullif(s2 + c2, 0), 0) * s2) / (s0 + s1 + s2), 12) AS f1 FROM (
  SELECT symbol, t0, t1, t2, place, """ + ", ".join(
    [f"count(*) FILTER (real = {i} AND pr = {i}) AS n{i}{i}, count(*) FILTER (real = {i}) AS s{i}, count(*) FILTER (pr = {i}) AS c{i}" for i in range(3)]
) + " FROM g GROUP BY 1, 2, 3, 4, 5)"


@query(
    "eva_08_threshold_search",
    q.with_(
        *BASE,
        """g AS (SELECT symbol, real, t0, t1, t2, i * 16 + m * 4 + k AS place, CASE WHEN p0 > t0 THEN 0 WHEN p2 > t2 THEN 2 ELSE 1 END AS pr
  FROM scored, (VALUES (0, 0.4), (1, 0.5), (2, 0.6), (3, 0.7)) a(i, t0), (VALUES (0, 0.3), (1, 0.4), (2, 0.5), (3, 0.6)) b(m, t1), (VALUES (0, 0.4), (1, 0.5), (2, 0.6), (3, 0.7)) c(k, t2))""",
    )
    + f"""SELECT symbol, CAST(t0 AS DOUBLE) AS t_low, CAST(t1 AS DOUBLE) AS t_neutral, CAST(t2 AS DOUBLE) AS t_high, {q.rnd('f1')} AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY f1 DESC, place) AS d FROM ({GRID_F1})) WHERE d = 1""",
)
def eva_08(spark, sf):
    return ev.search_thresholds(scored(spark, sf), ["symbol"]).withColumn("f1", rounded("f1"))


def fine_sql(steps: int, inner: int) -> str:
    """The best pair of a grid of any size: rows above every threshold of an axis share a cell, and cells meet the grid."""
    lo, hi = f"CAST({ev.B_LO} AS DOUBLE)", f"CAST({ev.B_HI} AS DOUBLE)"
    width = f"CAST({(ev.B_HI - ev.B_LO) / (steps - 1)!r} AS DOUBLE)"
    counts = ", ".join(f"sum(CASE WHEN real = {r} AND pr = {c} THEN n ELSE 0 END) AS n{r}{c}" for r in range(3) for c in range(3))
    support = ", ".join(f"n{i}0 + n{i}1 + n{i}2 AS s{i}, n0{i} + n1{i} + n2{i} AS c{i}" for i in range(3))
    f1 = " + ".join(f"coalesce(2.0 * n{i}{i} / nullif(s{i} + c{i}, 0), 0) * s{i}" for i in range(3))
    return f"""cells AS MATERIALIZED (SELECT real, p0, p2, count(*) AS n FROM (SELECT real, CASE WHEN p0 > 0.06 THEN 1.0 WHEN p0 <= 0.001 THEN 0.0 ELSE p0 END AS p0, CASE WHEN p2 > 0.06 THEN 1.0 WHEN p2 <= 0.002 THEN 0.0 ELSE p2 END AS p2 FROM scored) GROUP BY 1, 2, 3),
firsts AS (SELECT i, {lo} + i * {width} AS t1 FROM range({steps}) x(i)),
pairs AS MATERIALIZED (SELECT i, k, t1, (t1 + CAST(0.001 AS DOUBLE)) + k * (({hi} - (t1 + CAST(0.001 AS DOUBLE))) / {inner - 1}) AS t2 FROM firsts, range({inner}) y(k)),
met AS (SELECT i, k, t1, t2, {counts} FROM (SELECT i, k, t1, t2, real, n, CASE WHEN p2 > t2 THEN 2 WHEN p0 > t1 THEN 0 ELSE 1 END AS pr FROM cells, pairs) GROUP BY 1, 2, 3, 4),
best AS (SELECT t1, t2, round(({f1}) / (s0 + s1 + s2), 12) AS f1, i * {inner} + k AS place FROM (SELECT *, {support} FROM met))
SELECT {q.rnd('t1', 9)} AS t_low, {q.rnd('t2', 9)} AS t_high, {q.rnd('f1', 9)} AS f1 FROM best ORDER BY best.f1 DESC, place LIMIT 1"""


def _fine(found):
    return found.select(*rounded_cols(["t_low", "t_high", "f1"], 9))


def _with_fine(steps: int, inner: int) -> str:
    ctes, _, rows = fine_sql(steps, inner).rpartition("\nSELECT ")
    return q.with_(*BASE, ctes) + f"SELECT {rows}"


@query("eva_09_threshold_search_fine", _with_fine(ev.B_STEPS, ev.B_INNER))
def eva_09(spark, sf):
    return _fine(ev.search_thresholds_fine(scored(spark, sf)))


@query("eva_09_threshold_search_coarse", _with_fine(60, 15))
def eva_09_coarse(spark, sf):
    """The same search over 60 x 15 pairs."""
    return _fine(ev.search_thresholds_fine(scored(spark, sf), 60, 15))


SAMPLES_SQL = f"""sv AS (SELECT symbol, ts, CAST(s AS INTEGER) AS sample, {', '.join(f"{q.hash_u(f'symbol || {chr(39)}:{chr(39)} || ts || {chr(39)}:{chr(39)} || s || {chr(39)}:{i}{chr(39)}')} AS u{i}" for i in range(3))}
  FROM classes, range(5) r(s) WHERE target_class IS NOT NULL),
sp AS (SELECT symbol, ts, sample, unnest([0, 1, 2]) AS cls, unnest([round(u0 / (u0 + u1 + u2), 6), round(u1 / (u0 + u1 + u2), 6), round(u2 / (u0 + u1 + u2), 6)]) AS prob FROM sv)"""


def samples(spark, sf):
    """Five scorings of every labelled bar as (symbol, ts, sample, cls, prob)."""
    df = labelled(spark, sf).filter("target_class IS NOT NULL").select("symbol", "ts")
    df = df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4))))
    df = df.withColumns({f"u{i}": hash_uniform("symbol", "ts", "sample", F.lit(i)) for i in range(3)})
    total = F.col("u0") + F.col("u1") + F.col("u2")
    cells = F.array(*[F.struct(F.lit(i).alias("cls"), F.round(F.col(f"u{i}") / total, 6).alias("prob")) for i in range(3)])
    return df.select("symbol", "ts", "sample", F.explode(cells).alias("s")).select("symbol", "ts", "sample", "s.*")


UNC_COLS = ["p0", "p1", "p2", "var_p0", "var_p2", "lo_p1", "hi_p1", "uncertainty", "entropy", "confidence"]


@query(
    "eva_10_sample_uncertainty",
    q.with_(q.INDEX_BARS, CLASS_SQL, SAMPLES_SQL)
    + f"""SELECT symbol, ts, {q.rnds(UNC_COLS)} FROM (SELECT symbol, ts, {', '.join(f'max(m) FILTER (cls = {i}) AS p{i}, max(v) FILTER (cls = {i}) AS var_p{i}' for i in range(3))},
  max(lo) FILTER (cls = 1) AS lo_p1, max(hi) FILTER (cls = 1) AS hi_p1, avg(v) AS uncertainty, -sum(m * ln(m + 1e-8)) AS entropy, 1 - least(1, greatest(0, avg(v))) AS confidence FROM (
  SELECT symbol, ts, cls, avg(prob) AS m, var_pop(prob) AS v, quantile_cont(prob, 0.05) AS lo, quantile_cont(prob, 0.95) AS hi FROM sp GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
)
def eva_10(spark, sf):
    return ev.sample_uncertainty(samples(spark, sf), ["symbol", "ts"]).select("symbol", "ts", *rounded_cols(UNC_COLS))


ENS_COLS = [f"{k}_p{i}" for k in ("mean", "weighted", "variance_weighted", "variance") for i in range(3)]


@query(
    "eva_11_ensembles",
    q.with_(q.INDEX_BARS, CLASS_SQL, SAMPLES_SQL)
    + f"""SELECT symbol, ts, {q.rnds(ENS_COLS)}, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS majority_vote FROM (
  SELECT symbol, ts, {', '.join(f'avg(p{i}) AS mean_p{i}, sum(p{i} * (sample + 1)) / sum(sample + 1) AS weighted_p{i}, sum(p{i} / (1 + dv)) / sum(1 / (1 + dv)) AS variance_weighted_p{i}, var_pop(p{i}) AS variance_p{i}, count(*) FILTER (vote = {i}) AS v{i}' for i in range(3))}
  FROM (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS vote FROM (
    SELECT symbol, ts, sample, {', '.join(f'max(prob) FILTER (cls = {i}) AS p{i}' for i in range(3))}, avg(pow(d, 2)) AS dv FROM (
      SELECT *, prob - avg(prob) OVER (PARTITION BY symbol, ts, cls) AS d FROM sp) GROUP BY 1, 2, 3)) GROUP BY 1, 2)""",
)
def eva_11(spark, sf):
    members = samples(spark, sf).withColumnRenamed("sample", "member").withColumn("weight", F.col("member") + 1.0)
    return ev.ensembles(members, ["symbol", "ts"]).select("symbol", "ts", *rounded_cols(ENS_COLS), "majority_vote")


CAL_SQL = """cal AS (SELECT symbol, ece, CASE WHEN ece > 0.1 THEN 1.5 ELSE 1.0 END AS temperature FROM (SELECT symbol, avg(abs(a - c)) AS ece FROM (
  SELECT symbol, floor(uncertainty * 10) AS b, avg((pred = real)::INT) AS a, avg(1 - uncertainty) AS c FROM scored WHERE uncertainty < 1 GROUP BY 1, 2) GROUP BY 1))"""
CAL_COLS = ["ece", "temperature", "calibrated_p0", "calibrated_p1", "calibrated_p2", "calibrated_uncertainty"]


@query(
    "eva_12_calibration",
    q.with_(*BASE, CAL_SQL)
    + f"""SELECT symbol, ts, {q.rnds(CAL_COLS)} FROM (SELECT *, 1 - greatest(calibrated_p0, calibrated_p1, calibrated_p2) AS calibrated_uncertainty FROM (
  SELECT symbol, ts, ece, temperature, {', '.join(f'pow(p{i}, 1 / temperature) / (pow(p0, 1 / temperature) + pow(p1, 1 / temperature) + pow(p2, 1 / temperature)) AS calibrated_p{i}' for i in range(3))} FROM scored JOIN cal USING (symbol)))""",
)
def eva_12(spark, sf):
    return ev.calibrated(scored(spark, sf)).select("symbol", "ts", *rounded_cols(CAL_COLS))


@query(
    "eva_13_symbol_consistency",
    q.with_(*BASE, CELLS_SQL)
    + f"""SELECT symbol, {q.rnd('b')} AS balanced_accuracy, b >= 0.33 AS meets_limit, bool_and(b >= 0.33) OVER () AS consistent, {q.rnd('avg(b) OVER ()')} AS overall
FROM (SELECT symbol, {METRIC_SQL['balanced_accuracy']} AS b FROM sm)""",
)
def eva_13(spark, sf):
    """The limit is lowered to a third, about what random probabilities reach."""
    df = ev.symbol_consistency(scored(spark, sf), 0.33)
    return df.withColumns({"balanced_accuracy": rounded("balanced_accuracy"), "overall": rounded("overall")})


HISTORY_SQL = """history AS (SELECT o_orderpriority AS run, year(o_orderdate) * 12 + month(o_orderdate) AS epoch, avg(o_totalprice) / 250000 AS loss,
  max(o_totalprice) / 400000 AS val_loss, avg((o_orderstatus = 'O')::INT) AS acc, avg((o_orderstatus = 'F')::INT) AS val_acc FROM orders GROUP BY 1, 2)"""
HIST_COLS = ["loss_gap", "loss_ratio", "accuracy_gap", "recent_loss_gap", "improvement_rate"]


@query(
    "eva_14_history",
    q.with_(HISTORY_SQL)
    + f"""SELECT run, epochs, {q.rnds(HIST_COLS)}, loss_ratio > 1.5 OR accuracy_gap > 0.15 AS overfitting,
  concat_ws(',', CASE WHEN loss_ratio > 1.5 THEN 'high_loss_ratio' END, CASE WHEN accuracy_gap > 0.15 THEN 'high_accuracy_gap' END) AS indicators,
  recent_loss_gap > 0.15 AS recent_overfitting, slope > 0.01 AS overfitting_trend, improvement_rate * 10 < 0.001 AS converged FROM (
  SELECT run, epochs, max(val_loss - loss) FILTER (d = 1) AS loss_gap, max(val_loss / loss) FILTER (d = 1) AS loss_ratio, max(acc - val_acc) FILTER (d = 1) AS accuracy_gap,
    avg(val_loss) FILTER (d <= 3) - avg(loss) FILTER (d <= 3) AS recent_loss_gap, regr_slope(val_loss, -CAST(d AS DOUBLE)) FILTER (d <= 5) AS slope,
    (max(loss) FILTER (d = 10) - max(loss) FILTER (d = 1)) / 10 AS improvement_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS d, count(*) OVER (PARTITION BY run) AS epochs FROM history) GROUP BY 1, 2)""",
)
def eva_14(spark, sf):
    """Monthly figures per order priority stand in for the epochs of a training run."""
    o = tables.table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    history = o.groupBy(
        F.col("o_orderpriority").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")
    ).agg(
        (F.avg("o_totalprice") / 250000).alias("loss"),
        (F.max("o_totalprice") / 400000).alias("val_loss"),
        F.avg((status == "O").cast("double")).alias("acc"),
        F.avg((status == "F").cast("double")).alias("val_acc"),
    )
    df = ev.history_diagnostics(history)
    return df.withColumns({n: rounded(n) for n in HIST_COLS})


@query(
    "eva_15_focal_loss",
    q.with_(*BASE)
    + f"""SELECT symbol, {q.rnd('avg(0.25 * pow(1 - p, 2) * -ln(p))')} AS focal_loss FROM (
  SELECT symbol, least(1 - 1e-7, greatest(1e-7, CASE real WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS p FROM scored) GROUP BY 1""",
)
def eva_15(spark, sf):
    loss = ev.focal_loss(F.col("real"))
    return scored(spark, sf).groupBy("symbol").agg(rounded(F.avg(loss)).alias("focal_loss"))


NAME_SQL = "CASE {} WHEN 0 THEN 'LOW' WHEN 1 THEN 'NEUTRAL' ELSE 'HIGH' END"


@query(
    "eva_16_report",
    q.with_(*BASE)
    + f"""SELECT symbol, ts, {NAME_SQL.format('real')} AS real_class, {NAME_SQL.format('pred')} AS predicted_class, {q.rnds(['p0', 'p1', 'p2', 'uncertainty'])}, real = pred AS hit,
  CASE WHEN confidence > 0.6 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS confidence_band FROM scored""",
)
def eva_16(spark, sf):
    return ev.prediction_report(scored(spark, sf))


@query(
    "fea_11_adaptive_focal",
    q.with_(*BASE)
    + f"""SELECT symbol, {q.rnd('h')} AS hard_share, CAST(0.25 AS DOUBLE) AS alpha, CAST(CASE WHEN h > 0.4 THEN 3 WHEN h > 0.2 THEN 2 ELSE 1.5 END AS DOUBLE) AS gamma FROM (
  SELECT symbol, avg((confidence < cut)::INT) AS h FROM scored JOIN (SELECT symbol, quantile_cont(confidence, 0.75) AS cut FROM scored GROUP BY 1) USING (symbol) GROUP BY 1)""",
)
def fea_11_adaptive(spark, sf):
    return lb.adaptive_focal_parameters(scored(spark, sf)).withColumn("hard_share", rounded("hard_share"))
