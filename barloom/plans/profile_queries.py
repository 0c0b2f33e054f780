"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded, rounded_cols
from barloom.operators import labels as lb
from barloom.operators import profile as pf
from barloom.plans import sql as q
from barloom.plans.registry import query
from barloom.session import stored
from barloom.sources import tables

COLS = pf.NUMERIC


def avg_of(names: list[str]) -> str:
    """Row mean over the non-null columns."""
    return f"(SELECT avg(x) FROM (SELECT unnest([{', '.join(names)}]) AS x))"


def unpivot(src: str, cols: list[str], keep: str = "ts") -> str:
    return " UNION ALL ".join(
        f"SELECT symbol, {keep}, '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM {src} WHERE {c} IS NOT NULL" for c in cols
    )


SPARSE_SQL = """facts AS (
  SELECT c_mktsegment AS symbol, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS open_price, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def sparse_facts(spark, sf):
    """Order facts with nulls: no balance at or below zero, no price once filled."""
    o = tables.table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    cu = tables.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.join(cu, o.o_custkey == cu.c_custkey).select(
        F.col("c_mktsegment").alias("symbol"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("open_price"),
        F.col("o_orderpriority").alias("priority"),
    )


@query(
    "agg_01_missing",
    q.with_(SPARSE_SQL)
    + f"""SELECT symbol, n_rows, {q.rnds(['missing_balance', 'missing_open_price', 'missing_priority'])},
  {q.rnd('(missing_balance + missing_open_price + missing_priority) / 3')} AS missing_ratio,
  CAST((missing_balance > 0)::INT + (missing_open_price > 0)::INT + (missing_priority > 0)::INT AS BIGINT) AS columns_with_missing,
  {q.rnd('(missing_balance + missing_open_price + missing_priority) / 3')} AS avg_missing_ratio
FROM (SELECT symbol, count(*) AS n_rows, avg((balance IS NULL)::INT) AS missing_balance,
  avg((open_price IS NULL)::INT) AS missing_open_price, avg((priority IS NULL)::INT) AS missing_priority
  FROM facts GROUP BY symbol)""",
)
def agg_01(spark, sf):
    cols = ["balance", "open_price", "priority"]
    df = pf.missing(sparse_facts(spark, sf), cols)
    return df.select(
        "symbol", "n_rows", "columns_with_missing", *rounded_cols([f"missing_{c}" for c in cols] + ["missing_ratio", "avg_missing_ratio"])
    )


DIFFS = "dif AS (SELECT *, " + ", ".join(f"{c} - lag({c}) OVER w AS d_{c}" for c in COLS) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
NOISE_AGG = ", ".join(
    f"CASE WHEN count({c}) >= 10 THEN stddev_pop(d_{c}) / (stddev_pop({c}) + 1e-8) END AS noise_{c}" for c in COLS
)
NOISE_COLS = [f"noise_{c}" for c in COLS]
NOISE_SQL = f"""noise AS (SELECT *, {avg_of(NOISE_COLS)} AS noise FROM (SELECT symbol, count(*) AS n_rows, {NOISE_AGG} FROM dif GROUP BY symbol))"""


@query(
    "agg_02_noise",
    q.with_(q.ORDER_BARS, DIFFS, NOISE_SQL)
    + f"""SELECT symbol, {q.rnds(NOISE_COLS + ['noise'])},
  CASE WHEN noise IS NULL THEN 'unknown' WHEN noise < 0.1 THEN 'low' WHEN noise < 0.3 THEN 'medium' ELSE 'high' END AS noise_level
FROM noise""",
)
def agg_02(spark, sf):
    return pf.noise(tables.order_bars(spark, sf)).select("symbol", *rounded_cols(NOISE_COLS + ["noise"]), "noise_level")


RETS = "rets AS (SELECT *, " + ", ".join(
    f"({c} - lag({c}) OVER w) / nullif(lag({c}) OVER w, 0) AS r_{c}" for c in COLS
) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
VOL_COLS = [f"vol_{c}" for c in COLS]
VOL_SQL = f"""vols AS (SELECT *, {avg_of(VOL_COLS)} AS avg_volatility FROM (SELECT symbol, count(*) AS n_rows,
  {', '.join(f'CASE WHEN count({c}) > 10 THEN stddev_samp(r_{c}) END AS vol_{c}' for c in COLS)} FROM rets GROUP BY symbol)),
levels AS (SELECT *, CASE WHEN avg_volatility IS NULL THEN 'medium' WHEN avg_volatility > 0.1 THEN 'high'
  WHEN avg_volatility > 0.05 THEN 'medium' ELSE 'low' END AS noise_level FROM vols)"""


@query(
    "agg_03_return_noise",
    q.with_(q.INDEX_BARS, RETS, VOL_SQL) + f"SELECT symbol, n_rows, {q.rnds(VOL_COLS + ['avg_volatility'])}, noise_level FROM levels",
)
def agg_03(spark, sf):
    df = pf.return_noise(tables.index_bars(spark, sf))
    return df.select("symbol", "n_rows", *rounded_cols(VOL_COLS + ["avg_volatility"]), "noise_level")


CLASS_SQL = """classes AS (SELECT symbol, ts, CASE WHEN nret > 0.012 THEN 2 WHEN nret < -0.012 THEN 0 WHEN nret IS NOT NULL THEN 1 END AS target_class
  FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS nret FROM bars))"""


def labelled(spark, sf):
    return lb.direction_labels(tables.index_bars(spark, sf), F.lit(0.012), F.lit(-0.012))


@query(
    "agg_04_class_distribution",
    q.with_(q.INDEX_BARS, CLASS_SQL)
    + f"""SELECT symbol, column_name, class_value, n, {q.rnd('100.0 * n / sum(n) OVER w')} AS pct, count(*) OVER w AS n_classes,
  {q.rnd('max(n) OVER w * 1.0 / min(n) OVER w')} AS imbalance,
  CASE WHEN max(n) OVER w * 1.0 / min(n) OVER w < 1.5 THEN 'balanced' WHEN max(n) OVER w * 1.0 / min(n) OVER w < 3 THEN 'slightly_imbalanced'
       WHEN max(n) OVER w * 1.0 / min(n) OVER w < 10 THEN 'imbalanced' ELSE 'severely_imbalanced' END AS balance
FROM (SELECT symbol, column_name, class_value, count(*) AS n FROM (
  SELECT symbol, 'target_class' AS column_name, CAST(target_class AS VARCHAR) AS class_value FROM classes
  UNION ALL SELECT symbol, 'target_return', CAST(CAST(floor((lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1) * 1000 + 0.5) AS BIGINT) AS VARCHAR) FROM bars)
  WHERE class_value IS NOT NULL GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY symbol, column_name)""",
)
def agg_04(spark, sf):
    """Both class columns; the return is cut into classes of a tenth of a percent."""
    df = labelled(spark, sf).withColumn("target_return", F.floor(F.col("target_return") * 1000 + 0.5).cast("long"))
    out = pf.class_distributions(df)
    return out.withColumns({"pct": rounded("pct"), "imbalance": rounded("imbalance")})


BIN_SQL = """imb AS (SELECT symbol, CASE WHEN count(*) > 1 THEN max(n) * 1.0 / min(n) ELSE 1.0 END AS imbalance FROM
  (SELECT symbol, target_class, count(*) AS n FROM classes WHERE target_class IS NOT NULL GROUP BY 1, 2) GROUP BY symbol)"""


@query(
    "agg_05_binary_balance",
    q.with_(q.INDEX_BARS, CLASS_SQL, BIN_SQL) + f"SELECT symbol, {q.rnd('imbalance')} AS imbalance, imbalance < 3 AS is_balanced FROM imb",
)
def agg_05(spark, sf):
    return pf.binary_balance(labelled(spark, sf), "target_class").withColumn("imbalance", rounded("imbalance"))


@query(
    "agg_06_complexity_factors",
    q.with_(q.INDEX_BARS, RETS, VOL_SQL, CLASS_SQL, BIN_SQL)
    + """SELECT symbol, factors, CASE WHEN factors >= 3 THEN 'high' WHEN factors <= 1 THEN 'low' ELSE 'medium' END AS complexity FROM (
  SELECT l.symbol, CAST((n_rows < 500)::INT + 0 + (noise_level = 'high')::INT + (imbalance > 5)::INT AS BIGINT) AS factors
  FROM levels l JOIN imb USING (symbol))""",
)
def agg_06(spark, sf):
    bars = tables.index_bars(spark, sf)
    df = (
        pf.return_noise(bars)
        .select("symbol", "noise_level")
        .join(pf.missing(bars, COLS).select("symbol", "n_rows", "missing_ratio"), "symbol")
        .join(pf.binary_balance(labelled(spark, sf), "target_class").select("symbol", "imbalance"), "symbol")
    )
    return pf.complexity_factors(df).select("symbol", "factors", "complexity")


OUT_COLS = [f"outlier_{c}" for c in COLS]
OUTLIER_SQL = f"""fen AS (SELECT symbol, count(*) AS n, {', '.join(f'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}' for c in COLS)}
  FROM bars GROUP BY symbol),
outl AS (SELECT symbol, n, {', '.join(f'CASE WHEN n > 10 THEN avg(({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}))::INT) END AS outlier_{c}' for c in COLS)}
  FROM bars JOIN fen USING (symbol) GROUP BY symbol, n),
outs AS (SELECT *, {avg_of(OUT_COLS)} AS outlier_ratio FROM outl)"""
OUT_STATUS = "CASE WHEN outlier_ratio < 0.05 THEN 'low' WHEN outlier_ratio < 0.15 THEN 'moderate' WHEN outlier_ratio IS NOT NULL THEN 'high' END"


@query(
    "agg_07_outliers",
    q.with_(q.EVENT_BARS, OUTLIER_SQL) + f"SELECT symbol, {q.rnds(OUT_COLS + ['outlier_ratio'])}, {OUT_STATUS} AS outlier_status FROM outs",
)
def agg_07(spark, sf):
    return pf.outliers(tables.event_bars(spark, sf)).select("symbol", *rounded_cols(OUT_COLS + ["outlier_ratio"]), "outlier_status")


@query(
    "agg_08_quality",
    q.with_(q.EVENT_BARS, OUTLIER_SQL)
    + f"""SELECT symbol, n_rows, {q.rnd('outlier_ratio')} AS outlier_ratio, 'excellent' AS missing_status, size_adequacy, {q.rnd('score')} AS quality_score,
  CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'medium' ELSE 'low' END AS quality FROM (
  SELECT symbol, n AS n_rows, outlier_ratio,
    CASE WHEN n < 100 THEN 'insufficient' WHEN n < 1000 THEN 'small' WHEN n < 10000 THEN 'adequate' ELSE 'large' END AS size_adequacy,
    (1.0 + CASE {OUT_STATUS} WHEN 'low' THEN 1.0 WHEN 'moderate' THEN 0.7 ELSE 0.4 END
     + CASE WHEN n >= 10000 THEN 1.0 WHEN n >= 1000 THEN 0.8 WHEN n >= 100 THEN 0.5 ELSE 0.2 END) / 3.0 AS score FROM outs)""",
)
def agg_08(spark, sf):
    df = pf.quality(tables.event_bars(spark, sf))
    return df.select("symbol", "n_rows", *rounded_cols(["outlier_ratio", "quality_score"]), "missing_status", "size_adequacy", "quality")


EVENT_TYPES = {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "text", "value": "numeric", "props": "text"}


def types_sql(table: str, kinds: dict[str, str]) -> str:
    parts = []
    for c, k in kinds.items():
        if k == "numeric":
            kind = f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'numeric' END"
        elif k == "datetime":
            kind = "'datetime'"
        else:
            kind = f"CASE WHEN count(DISTINCT {c}) > count({c}) * 0.5 THEN 'high_cardinality' ELSE 'categorical' END"
        parts.append(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_values, {kind} AS kind FROM {table}")
    return " UNION ALL ".join(parts)


@query("agg_09_column_types", types_sql("events", EVENT_TYPES))
def agg_09(spark, sf):
    return pf.column_types(tables.table(spark, sf, "events"))


CORR_COLS = [f"corr_{a}_{b}" for a, b in pf.pairs(COLS)]


@query(
    "agg_10_complexity",
    q.with_(q.ORDER_BARS)
    + f"""SELECT symbol, n_rows, CAST(6 AS BIGINT) AS feature_count, {q.rnd('6.0 / n_rows')} AS feature_row_ratio,
  {q.rnd('high / 10.0')} AS high_corr_ratio, CASE WHEN high / 10.0 > 0.3 THEN 'high' ELSE 'low' END AS redundancy,
  CASE WHEN 6.0 / n_rows > 0.1 THEN 'high' WHEN 6.0 / n_rows > 0.05 THEN 'medium' ELSE 'low' END AS complexity,
  CAST(card AS DOUBLE) AS avg_cardinality, CAST(card AS DOUBLE) AS max_cardinality FROM (
  SELECT symbol, count(*) AS n_rows, count(DISTINCT dow) AS card,
    {' + '.join(f'coalesce((abs(corr({a}, {b})) > 0.8)::INT, 0)' for a, b in pf.pairs(COLS))} AS high
  FROM (SELECT *, strftime(ts, '%a') AS dow FROM bars) GROUP BY symbol)""",
)
def agg_10(spark, sf):
    bars = tables.order_bars(spark, sf)
    df = pf.complexity(bars.withColumn("dow", F.date_format("ts", "E")), COLS, ["dow"])
    return df.select(
        "symbol",
        "n_rows",
        "feature_count",
        *rounded_cols(["feature_row_ratio", "high_corr_ratio"]),
        "redundancy",
        "complexity",
        *rounded_cols(["avg_cardinality", "max_cardinality"]),
    )


MOMENT_COLS = ["mean", "std", "skewness", "kurtosis", "min", "max", "range", "cv"]


@query(
    "agg_11_moments",
    q.with_(q.EVENT_BARS)
    + f"""SELECT symbol, column_name, {q.rnds(MOMENT_COLS)},
  CASE WHEN abs(skewness) > 2 THEN 'high' WHEN abs(skewness) > 0.5 THEN 'moderate' ELSE 'low' END AS skew_level,
  CASE WHEN kurtosis > 3 THEN 'high' WHEN kurtosis > 0 THEN 'moderate' ELSE 'low' END AS kurtosis_level FROM (
  SELECT symbol, column_name, avg(v) AS mean, stddev_samp(v) AS std, skewness(v) AS skewness, kurtosis(v) AS kurtosis,
    min(v) AS min, max(v) AS max, max(v) - min(v) AS range, stddev_samp(v) / abs(avg(v)) AS cv
  FROM ({unpivot('bars', COLS)}) GROUP BY 1, 2 HAVING count(*) >= 3)""",
)
def agg_11(spark, sf):
    df = pf.moments(tables.event_bars(spark, sf))
    return df.select("symbol", "column_name", *rounded_cols(MOMENT_COLS), "skew_level", "kurtosis_level")


def season_sql(bars: str, season: str, min_rows: int, limit: float) -> str:
    return q.with_(bars) + f"""SELECT symbol, column_name, {q.rnd('strength')} AS strength, strength > {limit} AS significant,
  CASE WHEN sum((strength > {limit})::INT) OVER w > count(*) OVER w * 0.5 THEN 'strong' ELSE 'weak' END AS overall FROM (
  SELECT symbol, column_name, stddev_samp(m) / (any_value(sd) + 1e-8) AS strength FROM (
    SELECT symbol, column_name, season, avg(v) AS m FROM u GROUP BY 1, 2, 3) JOIN
    (SELECT symbol, column_name, stddev_samp(v) AS sd, count(*) AS n FROM u GROUP BY 1, 2) USING (symbol, column_name)
  WHERE n > {min_rows} GROUP BY 1, 2 HAVING count(*) > 1) WINDOW w AS (PARTITION BY symbol)""".replace(
        "FROM u", f"FROM (SELECT *, {season} AS season FROM ({unpivot('bars', COLS)})) u"
    )


@query("agg_12_weekday_effect", season_sql(q.EVENT_BARS, "isodow(ts) - 1", 7, 0.1))
def agg_12(spark, sf):
    return pf.weekday_effect(tables.event_bars(spark, sf)).withColumn("strength", rounded("strength"))


@query("agg_13_month_effect", season_sql(q.ORDER_BARS, "month(ts)", 30, 0.05))
def agg_13(spark, sf):
    return pf.month_effect(tables.order_bars(spark, sf)).withColumn("strength", rounded("strength"))


# the t-series coefficients in closed form: ratios of gamma functions
T_SUM = """CASE WHEN dof % 2 = 0
  THEN sin(th) * list_sum(list_transform(range(0, CAST((dof - 2) // 2 + 1 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * k)))
  ELSE 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, CAST((dof - 3) // 2 + 1 AS BIGINT)), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * k + 1)))) END"""


@query(
    "agg_14_trend",
    q.with_(q.ORDER_BARS)
    + f"""SELECT symbol, column_name, {q.rnd('slope', 4)} AS slope, {q.rnd('r')} AS r, {q.rnd('p')} AS p_value,
  CASE WHEN abs(r) > 0.3 AND p < 0.05 THEN CASE WHEN slope > 0 THEN 'upward' ELSE 'downward' END ELSE 'none' END AS direction,
  CASE WHEN abs(r) > 0.3 AND p < 0.05 THEN CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END ELSE 'weak' END AS significance
FROM (SELECT *, greatest(0, 1 - {T_SUM}) AS p FROM (
  SELECT *, atan(abs(r) * sqrt(dof / (1 - r * r)) / sqrt(dof)) AS th FROM (
    SELECT symbol, column_name, count(*) - 2 AS dof, regr_slope(v, x) AS slope, corr(v, x) AS r FROM (
      SELECT symbol, column_name, v, CAST(row_number() OVER (PARTITION BY symbol, column_name ORDER BY ts) - 1 AS DOUBLE) AS x
      FROM ({unpivot('bars', COLS)})) GROUP BY 1, 2 HAVING count(*) > 100)))""",
)
def agg_14(spark, sf):
    df = pf.trend(tables.order_bars(spark, sf))
    return df.select(
        "symbol", "column_name", rounded("slope", 4).alias("slope"), *rounded_cols(["r", "p_value"]), "direction", "significance"
    )


@query(
    "agg_15_gaps",
    q.with_(q.ORDER_BARS)
    + f"""SELECT symbol, {q.rnd('median_step')} AS median_step, count(CASE WHEN step > 3 * median_step THEN 1 END) AS n_gaps,
  {q.rnd('max(CASE WHEN step > 3 * median_step THEN step END)')} AS largest_gap,
  count(CASE WHEN step > 3 * median_step THEN 1 END) > 0 AS gaps_detected
FROM s JOIN (SELECT symbol, median(step) AS median_step FROM s GROUP BY 1) USING (symbol) GROUP BY symbol, median_step""".replace(
        "FROM s", "FROM (SELECT * FROM (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM bars) WHERE step IS NOT NULL) s"
    ),
)
def agg_15(spark, sf):
    df = pf.gaps(tables.order_bars(spark, sf))
    return df.withColumns({"median_step": rounded("median_step"), "largest_gap": rounded("largest_gap")})


@query(
    "agg_15_gaps_hourly",
    q.with_(q.EVENT_BARS)
    + f"""SELECT symbol, {q.rnd('median_step')} AS median_step, count(CASE WHEN step > 3 * median_step THEN 1 END) AS n_gaps,
  {q.rnd('max(CASE WHEN step > 3 * median_step THEN step END)')} AS largest_gap,
  count(CASE WHEN step > 3 * median_step THEN 1 END) > 0 AS gaps_detected
FROM s JOIN (SELECT symbol, median(step) AS median_step FROM s GROUP BY 1) USING (symbol) GROUP BY symbol, median_step""".replace(
        "FROM s",
        "FROM (SELECT * FROM (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS step FROM bars) WHERE step IS NOT NULL) s",
    ),
)
def agg_15h(spark, sf):
    df = pf.gaps(tables.event_bars(spark, sf))
    return df.withColumns({"median_step": rounded("median_step"), "largest_gap": rounded("largest_gap")})


STAT_SQL = f"""u AS ({unpivot('bars', COLS)}),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, column_name ORDER BY ts) AS rn, count(*) OVER g AS n,
  v - avg(v) OVER g AS cv, var_pop(v) OVER g AS va FROM u WINDOW g AS (PARTITION BY symbol, column_name)),
pw AS (SELECT *, greatest(10, n // 4) AS w FROM p),
pref AS (SELECT *, sum(cv) OVER o AS s1, sum(cv * cv) OVER o AS s2 FROM pw WINDOW o AS (PARTITION BY symbol, column_name ORDER BY rn)),
rolled AS (SELECT a.symbol, a.column_name, a.n, a.w, a.rn, a.va, (a.s1 - coalesce(b.s1, 0)) AS d1, a.s2 - coalesce(b.s2, 0) AS d2
  FROM pref a LEFT JOIN pref b ON a.symbol = b.symbol AND a.column_name = b.column_name AND b.rn = a.rn - a.w WHERE a.rn >= a.w),
rvar AS (SELECT *, CASE WHEN (d2 - d1 * d1 / w) / (w - 1) > 1e-10 * va THEN (d2 - d1 * d1 / w) / (w - 1) ELSE 0 END AS rv FROM rolled),
st AS (SELECT symbol, column_name, n, w, regr_slope(d1 / w, CAST(rn AS DOUBLE)) AS slope, stddev_pop(d1 / w) AS sd,
  max(rv) / (min(rv) + 1e-8) AS var_ratio
  FROM rvar GROUP BY 1, 2, 3, 4),
verdicts AS (SELECT *, CASE WHEN n < 20 THEN 'insufficient_data'
  WHEN (n < 2 * w OR abs(slope) < 0.1 * sd) AND (n < 2 * w OR var_ratio < 4) THEN 'stationary'
  WHEN (n < 2 * w OR abs(slope) < 0.1 * sd) OR (n < 2 * w OR var_ratio < 4) THEN 'weak_stationary' ELSE 'non_stationary' END AS verdict FROM st)"""


@query(
    "agg_16_stationarity",
    q.with_(q.ORDER_BARS, STAT_SQL)
    + f"""SELECT symbol, column_name, n, w, {q.rnd('slope', 4)} AS slope, {q.rnd('sd', 4)} AS sd, {q.rnd('var_ratio')} AS var_ratio, verdict,
  CASE WHEN sum((verdict = 'stationary')::INT) OVER s * 1.0 / count(*) OVER s > 0.7 THEN 'mostly_stationary'
       WHEN sum((verdict = 'stationary')::INT) OVER s * 1.0 / count(*) OVER s > 0.3 THEN 'mixed' ELSE 'mostly_non_stationary' END AS overall
FROM verdicts WINDOW s AS (PARTITION BY symbol)""",
)
def agg_16(spark, sf):
    df = pf.stationarity(tables.order_bars(spark, sf))
    return df.withColumns({"slope": rounded("slope", 4), "sd": rounded("sd", 4), "var_ratio": rounded("var_ratio")})


REGIME_SQL = """r AS (SELECT symbol, rn - 1 AS i, ret, count(*) OVER (PARTITION BY symbol) AS n FROM num WHERE ret IS NOT NULL),
rv AS (SELECT *, CASE WHEN i >= 19 THEN stddev_samp(ret) OVER o END AS vol, CASE WHEN i >= 19 THEN avg(ret) OVER o END AS av
  FROM r WINDOW o AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)),
ba AS (SELECT *, avg(vol) OVER b AS vb, avg(vol) OVER a AS va, avg(av) OVER b AS mb, avg(av) OVER a AS ma FROM rv
  WINDOW b AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
cnt AS (SELECT symbol, n, count(CASE WHEN vb > 0 AND abs(va - vb) > 0.5 * vb THEN 1 END) AS vol_changes,
  count(CASE WHEN abs(mb) > 1e-6 AND abs(ma - mb) > 0.3 * abs(mb) THEN 1 END) AS mean_changes
  FROM ba WHERE i >= 20 AND i < n - 20 GROUP BY 1, 2)"""


@query(
    "agg_17_regime_changes",
    q.with_(q.INDEX_BARS, q.NUMBERED, REGIME_SQL)
    + f"""SELECT symbol, vol_changes, mean_changes, vol_changes + mean_changes AS total_changes,
  {q.rnd('100.0 * (vol_changes + mean_changes) / n')} AS change_frequency, vol_changes + mean_changes > 0 AS detected FROM cnt""",
)
def agg_17(spark, sf):
    return pf.regime_changes(tables.index_bars(spark, sf)).withColumn("change_frequency", rounded("change_frequency"))


@query("agg_20_full_profile")
def agg_20(spark, sf):
    """One record per symbol; the parts carry their own comparison SQL above."""
    bars = lb.direction_labels(tables.order_bars(spark, sf), F.lit(0.012), F.lit(-0.012))
    bars = bars.withColumn("target_return", F.floor(F.col("target_return") * 1000 + 0.5).cast("long"))
    df = pf.full_profile(stored(bars, "profile-bars"))
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct")]
    return df.withColumns({n: F.to_json(n) for n in nested})


@query(
    "agg_07_exact_quantiles",
    f"SELECT event_type AS symbol, {q.rnd('p')} AS p, {q.rnd('value')} AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT event_type, {p} AS p, quantile_cont(value, {p}) AS value FROM events GROUP BY 1" for p in (0.05, 0.25, 0.5, 0.75, 0.95)
    )
    + ")",
)
def agg_07_quantiles(spark, sf):
    """Quantiles of raw events, whose types may each hold a third of all rows."""
    ticks = tables.event_ticks(spark, sf)
    return pf.exact_quantiles(ticks, "price", [0.05, 0.25, 0.5, 0.75, 0.95], ["symbol"]).select(
        "symbol", rounded("p").alias("p"), rounded("value").alias("value")
    )
