"""Feature, label, scaling, weighting, selection and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded, rounded_cols
from barloom.operators import augment as au
from barloom.operators import backtest as bk
from barloom.operators import features as ft
from barloom.operators import labels as lb
from barloom.operators import lookups as lk
from barloom.operators import profile as pf
from barloom.operators import selection as sl
from barloom.operators import series as se
from barloom.plans import sql as q
from barloom.plans.profile_queries import CLASS_SQL, labelled
from barloom.plans.registry import query
from barloom.session import stored
from barloom.sources import tables

FEATURE_SQL = [
    q.INDEX_BARS,
    q.NUMBERED,
    q.MOVES,
    q.RSI,
    q.MACD,
    q.ATR,
    f"""mom AS (SELECT *, close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY rn), 0) - 1 AS price_momentum,
  sum(volume) OVER (PARTITION BY symbol) AS vol_total, {q.roll('avg', 'volume', 21)} AS vma,
  {q.roll('max', 'high', 14)} AS hi14, {q.roll('min', 'low', 14)} AS lo14 FROM num),
feats AS (SELECT m.symbol, m.ts, m.rn, m.close, m.volume, rsi_14 AS rsi, macd, macd_signal,
  100 * (close / nullif(lag(close, 14) OVER w, 0) - 1) AS roc, -100 * (hi14 - close) / nullif(hi14 - lo14, 0) AS williams_r,
  atr.y AS atr, CASE WHEN m.rn >= 21 THEN stddev_samp(ret) OVER (PARTITION BY m.symbol ORDER BY m.rn ROWS 20 PRECEDING) * sqrt(252) END AS volatility_rolling,
  atr.y / close AS atr_normalized, CASE WHEN vol_total > 0 THEN vma ELSE 1 END AS volume_sma,
  CASE WHEN vol_total > 0 THEN volume / nullif(vma, 0) ELSE 1 END AS volume_ratio, price_momentum,
  price_momentum - lag(price_momentum) OVER w AS price_acceleration, (isodow(ts) - 1) / 6.0 AS day_of_week, month(ts) / 12.0 AS month
  FROM mom m LEFT JOIN rsi USING (symbol, rn) LEFT JOIN macd USING (symbol, rn) LEFT JOIN atr USING (symbol, rn)
  WINDOW w AS (PARTITION BY m.symbol ORDER BY m.rn))""",
]


def features(spark, sf):
    return ft.feature_suite(tables.index_bars(spark, sf))


@query("win_20_feature_suite", q.with_(*FEATURE_SQL) + f"SELECT symbol, ts, {q.rnds(ft.FEATURES)} FROM feats")
def win_20(spark, sf):
    return features(spark, sf).select("symbol", "ts", *rounded_cols(ft.FEATURES))


def _part(names: list[str], build):
    def run(spark, sf):
        s = se.by_symbol(tables.index_bars(spark, sf))
        return build(s).df.select("symbol", "ts", *rounded_cols(names))

    return run


def _part_sql(names: list[str]) -> str:
    return q.with_(*FEATURE_SQL) + f"SELECT symbol, ts, {q.rnds(names)} FROM feats"


query("win_15_annual_volatility", _part_sql(["volatility_rolling"]))(_part(["volatility_rolling"], ft.annual_volatility))
query("win_16_volume_features", _part_sql(["volume_sma", "volume_ratio"]))(
    _part(["volume_sma", "volume_ratio"], ft.volume_features)
)
query("win_17_momentum", _part_sql(["price_momentum", "price_acceleration"]))(
    _part(["price_momentum", "price_acceleration"], ft.momentum)
)
query("win_18_calendar", _part_sql(["day_of_week", "month"]))(
    _part(["day_of_week", "month"], lambda s: s.with_columns(ft.calendar()))
)

SEQ_FEATURES = ["close", "volume"]


@query(
    "win_22_sequences",
    q.with_(q.INDEX_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, {q.rnd('close')} AS label, CAST(len(x) AS INTEGER) AS length, {q.rnd('x[1]')} AS oldest, {q.rnd('x[15]')} AS newest,
  {q.rnd('list_sum(x)')} AS total FROM (
  SELECT symbol, ts, rn, close, list(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS x FROM num)
  WHERE rn >= 15""",
)
def win_22(spark, sf):
    df = ft.sequences(tables.index_bars(spark, sf).withColumn("label", F.col("close")), SEQ_FEATURES, "label")
    closes = F.transform("x", lambda v: v[0])
    return df.select(
        "symbol",
        "ts",
        rounded("label").alias("label"),
        F.size("x").alias("length"),
        rounded(closes[0]).alias("oldest"),
        rounded(closes[14]).alias("newest"),
        rounded(F.aggregate(closes, F.lit(0.0), lambda a, v: a + v)).alias("total"),
    )


@query(
    "win_23_ordered_split",
    q.with_(q.INDEX_BARS, q.NUMBERED)
    + "SELECT symbol, ts, rn + 1 <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM num",
)
def win_23(spark, sf):
    return ft.ordered_split(tables.index_bars(spark, sf)).select("symbol", "ts", "is_train")


@query(
    "win_24_direction_label",
    q.with_(q.INDEX_BARS, CLASS_SQL) + "SELECT symbol, ts, CAST(target_class AS INTEGER) AS target_class FROM classes",
)
def win_24(spark, sf):
    return labelled(spark, sf).select("symbol", "ts", "target_class")


SIGNAL_SQL = f"""ma AS (SELECT *, {q.roll('avg', 'close', 10)} AS fast, {q.roll('avg', 'close', 30)} AS slow FROM num),
sg AS (SELECT *, CASE WHEN pd < 0 AND d > 0 THEN 1 WHEN pd > 0 AND d < 0 THEN -1 ELSE 0 END AS signal FROM (
  SELECT *, sign(fast - slow) AS d, lag(sign(fast - slow)) OVER (PARTITION BY symbol ORDER BY rn) AS pd FROM ma))"""


@query("win_25_cross_signals", q.with_(q.INDEX_BARS, q.NUMBERED, SIGNAL_SQL) + "SELECT symbol, ts, signal FROM sg")
def win_25(spark, sf):
    return bk.sma_cross(tables.index_bars(spark, sf)).select("symbol", "ts", "signal")


# -- thresholds, scaling, weights -----------------------------------------------------------

THRESH_SQL = """nr AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS target_return FROM bars),
th AS (SELECT symbol, count(target_return) AS n_returns, count(*) AS size,
  CASE WHEN count(*) < 1000 THEN 0.12 WHEN count(*) < 5000 THEN 0.10 ELSE 0.08 END AS r,
  quantile_cont(target_return, 0.94) AS u12, quantile_cont(target_return, 0.06) AS l12, quantile_cont(target_return, 0.95) AS u10,
  quantile_cont(target_return, 0.05) AS l10, quantile_cont(target_return, 0.96) AS u08, quantile_cont(target_return, 0.04) AS l08
  FROM nr GROUP BY 1),
cuts AS (SELECT symbol, n_returns,
  CASE WHEN n_returns < 50 THEN 0.012 ELSE least(0.03, greatest(0.002, abs(CASE r WHEN 0.12 THEN u12 WHEN 0.10 THEN u10 ELSE u08 END))) END AS upper,
  CASE WHEN n_returns < 50 THEN -0.012 ELSE -least(0.03, greatest(0.002, abs(CASE r WHEN 0.12 THEN l12 WHEN 0.10 THEN l10 ELSE l08 END))) END AS lower
  FROM th)"""


@query("fea_01_adaptive_thresholds", q.with_(q.INDEX_BARS, THRESH_SQL) + f"SELECT symbol, n_returns, {q.rnds(['upper', 'lower'])} FROM cuts")
def fea_01(spark, sf):
    df = lb.adaptive_thresholds(lb.with_next_return(tables.index_bars(spark, sf)))
    return df.select("symbol", "n_returns", *rounded_cols(["upper", "lower"]))


ADAPTIVE_CLASS_SQL = """acl AS (SELECT nr.symbol, ts, target_return, CASE WHEN target_return > upper THEN 2 WHEN target_return < lower THEN 0
  WHEN target_return IS NOT NULL THEN 1 END AS target_class FROM nr JOIN cuts USING (symbol))"""


@query(
    "fea_01_adaptive_labels",
    q.with_(q.INDEX_BARS, THRESH_SQL, ADAPTIVE_CLASS_SQL)
    + f"SELECT symbol, ts, {q.rnd('target_return')} AS target_return, CAST(target_class AS INTEGER) AS target_class FROM acl",
)
def fea_01_labels(spark, sf):
    df = lb.adaptive_labels(tables.index_bars(spark, sf))
    return df.select("symbol", "ts", rounded("target_return").alias("target_return"), "target_class")


@query(
    "fea_02_alternate_thresholds",
    q.with_(q.INDEX_BARS, THRESH_SQL)
    + f"""SELECT symbol, category, 'adaptive_percentile' AS method, {q.rnd('least(0.025, greatest(0.003, abs(u)))')} AS upper,
  {q.rnd('-least(0.025, greatest(0.003, abs(l)))')} AS lower FROM (
  SELECT symbol, CASE WHEN n <= 250 THEN 'micro' WHEN n <= 1000 THEN 'small' WHEN n <= 5000 THEN 'medium' ELSE 'large' END AS category,
    CASE WHEN n <= 250 THEN a4 WHEN n <= 1000 THEN a3 WHEN n <= 5000 THEN a2 ELSE a1 END AS u,
    CASE WHEN n <= 250 THEN b4 WHEN n <= 1000 THEN b3 WHEN n <= 5000 THEN b2 ELSE b1 END AS l FROM (
    SELECT symbol, count(*) AS n, quantile_cont(target_return, 0.75) AS a4, quantile_cont(target_return, 0.25) AS b4,
      quantile_cont(target_return, 0.8) AS a3, quantile_cont(target_return, 0.2) AS b3, quantile_cont(target_return, 0.825) AS a2,
      quantile_cont(target_return, 0.175) AS b2, quantile_cont(target_return, 0.85) AS a1, quantile_cont(target_return, 0.15) AS b1
    FROM nr GROUP BY 1))""",
)
def fea_02(spark, sf):
    df = lb.alternate_thresholds(lb.with_next_return(tables.index_bars(spark, sf)))
    return df.select("symbol", "category", "method", *rounded_cols(["upper", "lower"]))


SCALED = ["scaled_close", "scaled_volume"]


@query(
    "fea_03_min_max",
    q.with_(q.INDEX_BARS)
    + f"""SELECT symbol, ts, {q.rnds(SCALED)}, {q.rnd('close')} AS back FROM (
  SELECT symbol, ts, close, CASE WHEN max(close) OVER w = min(close) OVER w THEN 0 ELSE (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) END AS scaled_close,
    CASE WHEN max(volume) OVER w = min(volume) OVER w THEN 0 ELSE (volume - min(volume) OVER w) / nullif(max(volume) OVER w - min(volume) OVER w, 0) END AS scaled_volume
  FROM bars WINDOW w AS (PARTITION BY symbol))""",
)
def fea_03(spark, sf):
    df = lb.min_max(tables.index_bars(spark, sf), ["close", "volume"])
    return df.select("symbol", "ts", *rounded_cols(SCALED), rounded(lb.unscale("close")).alias("back"))


@query(
    "fea_03_min_max_train",
    q.with_(q.INDEX_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, {q.rnd('(close - lo) / nullif(hi - lo, 0)')} AS scaled_close FROM (
  SELECT *, min(CASE WHEN tr THEN close END) OVER (PARTITION BY symbol) AS lo, max(CASE WHEN tr THEN close END) OVER (PARTITION BY symbol) AS hi
  FROM (SELECT *, rn + 1 <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) AS tr FROM num))""",
)
def fea_03_train(spark, sf):
    df = lb.min_max(ft.ordered_split(tables.index_bars(spark, sf)), ["close"], F.col("is_train"))
    return df.select("symbol", "ts", rounded("scaled_close").alias("scaled_close"))


@query(
    "fea_04_one_hot",
    q.with_(q.INDEX_BARS, CLASS_SQL)
    + """SELECT symbol, ts, CAST(target_class = 0 AS DOUBLE) AS low, CAST(target_class = 1 AS DOUBLE) AS neutral,
  CAST(target_class = 2 AS DOUBLE) AS high, CAST(target_class AS INTEGER) AS back FROM classes WHERE target_class IS NOT NULL""",
)
def fea_04(spark, sf):
    df = labelled(spark, sf).filter("target_class IS NOT NULL").withColumn("hot", lb.one_hot(F.col("target_class")))
    hot = F.col("hot")
    return df.select(
        "symbol", "ts", hot[0].alias("low"), hot[1].alias("neutral"), hot[2].alias("high"), lb.from_one_hot(hot).alias("back")
    )


@query(
    "fea_10_class_weights",
    q.with_(q.INDEX_BARS, CLASS_SQL)
    + f"""SELECT symbol, strategy, target_class, n, {q.rnd('weight / sum(weight) OVER (PARTITION BY symbol, strategy) * k')} AS weight FROM (
  SELECT symbol, CAST(target_class AS INTEGER) AS target_class, n, k, strategy,
    CASE strategy WHEN 'balanced' THEN t * 1.0 / (k * n) WHEN 'inverse' THEN t * 1.0 / n ELSE t * 0.5 / (k * n) + 0.5 END AS weight FROM (
    SELECT *, sum(n) OVER (PARTITION BY symbol) AS t, count(*) OVER (PARTITION BY symbol) AS k FROM (
      SELECT symbol, target_class, count(*) AS n FROM classes WHERE target_class IS NOT NULL GROUP BY 1, 2)),
  (SELECT unnest(['balanced', 'balanced_smooth', 'inverse']) AS strategy))""",
)
def fea_10(spark, sf):
    df, out = labelled(spark, sf), None
    for strategy in ("balanced", "balanced_smooth", "inverse"):
        part = lb.class_weights(df, strategy).withColumn("strategy", F.lit(strategy))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("weight", rounded("weight"))


@query(
    "fea_11_focal_parameters",
    q.with_(q.INDEX_BARS, CLASS_SQL)
    + f"""SELECT symbol, {q.rnd('imb')} AS imbalance, CAST(0.25 AS DOUBLE) AS alpha,
  CAST(CASE WHEN imb < 2 THEN 1.5 WHEN imb < 5 THEN 2 WHEN imb < 10 THEN 2.5 ELSE 3 END AS DOUBLE) AS gamma FROM (
  SELECT symbol, max(n) * 1.0 / min(n) AS imb FROM (SELECT symbol, target_class, count(*) AS n FROM classes WHERE target_class IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""",
)
def fea_11(spark, sf):
    return lb.focal_parameters(labelled(spark, sf)).withColumn("imbalance", rounded("imbalance"))


# -- relations and selection ---------------------------------------------------------------

REL = ["rsi", "macd", "roc", "williams_r", "atr", "price_momentum", "volume_ratio"]
REL_SQL = [
    *FEATURE_SQL,
    f"""fr AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY rn) / close - 1 AS target_return,
  {' AND '.join(f'{f} IS NOT NULL' for f in REL)} AS ok FROM feats)""",
]


def with_target(spark, sf):
    return lb.with_next_return(features(spark, sf))


@query(
    "agg_18_feature_stats",
    q.with_(*REL_SQL)
    + " UNION ALL ".join(
        f"SELECT symbol, '{f}' AS feature, {q.rnd(f'avg({f}) FILTER (ok)')} AS mean, {q.rnd(f'stddev_samp({f}) FILTER (ok)')} AS std, {q.rnd(f'min({f}) FILTER (ok)')} AS min, {q.rnd(f'max({f}) FILTER (ok)')} AS max, {q.rnd(f'avg(({f} IS NULL)::INT)')} AS missing_ratio FROM fr GROUP BY 1"
        for f in REL
    ),
)
def agg_18_stats(spark, sf):
    df = pf.feature_stats(with_target(spark, sf), REL)
    return df.select("symbol", "feature", *rounded_cols(["mean", "std", "min", "max", "missing_ratio"]))


@query(
    "agg_18_correlations",
    q.with_(*REL_SQL)
    + " UNION ALL ".join(
        f"SELECT symbol, '{a}' AS feature_a, '{b}' AS feature_b, {q.rnd(f'corr({a}, {b})')} AS corr FROM fr WHERE ok GROUP BY 1" for a, b in pf.pairs(REL)
    ),
)
def agg_18_corr(spark, sf):
    return pf.correlations(with_target(spark, sf), REL).withColumn("corr", rounded("corr"))


@query(
    "agg_18_target_correlations",
    q.with_(*REL_SQL)
    + " UNION ALL ".join(f"SELECT symbol, '{f}' AS feature, {q.rnd(f'coalesce(corr({f}, target_return), 0)')} AS corr FROM fr GROUP BY 1" for f in REL),
)
def agg_18_target(spark, sf):
    return pf.target_correlations(with_target(spark, sf), REL, "target_return").withColumn("corr", rounded("corr"))


def _nine_digits(spark, sf):
    """Nine decimals, so that equal values tie in both engines when they are ranked."""
    return with_target(spark, sf).withColumns({f: F.round(f, 9) for f in [*REL, "target_return"]})


def _corr_table(spark, sf):
    df = stored(with_target(spark, sf), "features")
    return df, sl.relations(df, ft.FEATURES, "target_return")


_PLACE = {f: i for i, f in enumerate(ft.FEATURES)}
_LATER = pf.pairs(ft.FEATURES)
STRONG_SQL = [
    *REL_SQL,
    f"""cells AS (SELECT {', '.join(f'corr({a}, {b}) AS c_{_PLACE[a]}_{_PLACE[b]}' for a, b in _LATER)} FROM fr
  WHERE {' AND '.join(f'{f} IS NOT NULL' for f in ft.FEATURES)})""",
    "strong AS ("
    + " UNION ALL ".join(f"SELECT {_PLACE[a]} AS i, {_PLACE[b]} AS j, '{a}' AS a, '{b}' AS b FROM cells WHERE isfinite(c_{_PLACE[a]}_{_PLACE[b]}) AND abs(c_{_PLACE[a]}_{_PLACE[b]}) > {sl.CORRELATED}" for a, b in _LATER)
    + ")",
]
GROUPS_SQL = [
    "close_ AS (SELECT list(a || '|' || b) AS near FROM strong)",
    f"""greedy AS (SELECT {ft.FEATURES!r} AS left_, CAST(NULL AS VARCHAR) AS features, -1 AS group_id
  UNION ALL SELECT list_filter(left_[2:], lambda f: NOT list_contains(taken, f)), CASE WHEN len(taken) > 0 THEN array_to_string(list_concat([left_[1]], taken), ',') END,
    group_id + CASE WHEN len(taken) > 0 THEN 1 ELSE 0 END
  FROM (SELECT g.*, list_filter(left_[2:], lambda f: list_contains(coalesce(near, []), left_[1] || '|' || f)) AS taken FROM greedy g, close_ WHERE len(left_) > 0))""",
]
FILTER_SQL = [
    "toward AS (" + " UNION ALL ".join(f"SELECT '{f}' AS f, abs(coalesce(corr({f}, target_return), 0)) AS t FROM fr" for f in ft.FEATURES) + ")",
    """visits AS (SELECT row_number() OVER (ORDER BY j, i) AS k, a, b, CASE WHEN x.t < y.t THEN a ELSE b END AS loser
  FROM strong JOIN toward x ON x.f = a JOIN toward y ON y.f = b)""",
    """gone AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS names
  UNION ALL SELECT v.k, CASE WHEN list_contains(names, a) OR list_contains(names, b) THEN names ELSE list_append(names, loser) END
  FROM gone JOIN visits v ON v.k = gone.k + 1)""",
]


@query("agg_19_redundancy_groups", q.with_(*STRONG_SQL, *GROUPS_SQL) + "SELECT CAST(group_id AS INTEGER) AS group_id, features FROM greedy WHERE features IS NOT NULL")
def agg_19(spark, sf):
    _, rel = _corr_table(spark, sf)
    groups = sl.redundancy_groups(ft.FEATURES, rel["corr"])
    return spark.createDataFrame([(i, ",".join(g)) for i, g in enumerate(groups)], "group_id int, features string")


@query(
    "fea_05_correlation_filter",
    q.with_(*STRONG_SQL, *FILTER_SQL) + f"SELECT f AS feature, NOT list_contains((SELECT arg_max(names, k) FROM gone), f) AS kept FROM (SELECT unnest({ft.FEATURES!r}) AS f)",
)
def fea_05(spark, sf):
    _, rel = _corr_table(spark, sf)
    kept = sl.correlation_filter(ft.FEATURES, rel["corr"], rel["target"])
    return spark.createDataFrame([(f, f in kept) for f in ft.FEATURES], "feature string, kept boolean")


@query(
    "fea_06_variance_filter",
    q.with_(*REL_SQL)
    + " UNION ALL ".join(
        f"SELECT symbol, '{f}' AS feature, {q.rnd(f'var_samp({f})')} AS variance, var_samp({f}) >= 0.01 AS kept FROM fr WHERE ok GROUP BY 1" for f in REL
    ),
)
def fea_06(spark, sf):
    return sl.variance_filter(features(spark, sf), REL).withColumn("variance", rounded("variance"))


RANK_CTE = "lr AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS feature, round({f}, 9) AS v, round(target_return, 9) AS t FROM fr WHERE ok AND target_return IS NOT NULL" for f in REL
) + "), rk AS (SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY v) + (count(*) OVER (PARTITION BY symbol, feature, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY symbol, feature ORDER BY t) + (count(*) OVER (PARTITION BY symbol, feature, t) - 1) / 2.0 AS rt FROM lr)"


@query(
    "fea_07_correlation_importance",
    q.with_(*REL_SQL, RANK_CTE)
    + f"SELECT symbol, feature, {q.rnd('abs(corr(v, t))')} AS score, {q.rnd('abs(corr(rv, rt))')} AS spearman FROM rk GROUP BY 1, 2",
)
def fea_07(spark, sf):
    df = sl.pearson_importance(_nine_digits(spark, sf), REL, "target_return")
    return df.select("symbol", "feature", *rounded_cols(["score", "spearman"]))


WHOLE_RANK_SQL = [
    "lw AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round({f}, 9) AS v, round(target_return, 9) AS t FROM fr WHERE ok AND target_return IS NOT NULL" for f in REL) + ")",
    """wr AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rv,
  rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0 AS rt FROM lw)""",
]


@query("fea_07_rank_correlation", q.with_(*REL_SQL, *WHOLE_RANK_SQL) + f"SELECT 'all' AS key, feature, {q.rnd('corr(rv, rt)')} AS spearman FROM wr GROUP BY 2")
def fea_07_rank(spark, sf):
    """Rank correlation over all symbols at once, as the selector takes it."""
    df = _nine_digits(spark, sf).withColumn("key", F.lit("all"))
    return sl.rank_correlation(df, REL, "target_return", "key").withColumn("spearman", rounded("spearman"))


MI_CTE = [
    "lc AS (" + " UNION ALL ".join(
        f"SELECT symbol, '{f}' AS feature, {f} AS v, CASE WHEN target_return > 0.012 THEN 2 WHEN target_return < -0.012 THEN 0 ELSE 1 END AS cls FROM fr WHERE ok AND target_return IS NOT NULL"
        for f in REL
    ) + ")",
    """dc AS (SELECT symbol, feature, [quantile_cont(v, 0.1), quantile_cont(v, 0.2), quantile_cont(v, 0.3), quantile_cont(v, 0.4), quantile_cont(v, 0.5),
  quantile_cont(v, 0.6), quantile_cont(v, 0.7), quantile_cont(v, 0.8), quantile_cont(v, 0.9)] AS cuts FROM lc GROUP BY 1, 2),
jt AS (SELECT symbol, feature, len(list_filter(cuts, lambda k: k < v)) AS bin, cls, count(*) * 1.0 AS n FROM lc JOIN dc USING (symbol, feature) GROUP BY 1, 2, 3, 4),
mi AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol, feature) * ln(n * sum(n) OVER (PARTITION BY symbol, feature)
  / (sum(n) OVER (PARTITION BY symbol, feature, bin) * sum(n) OVER (PARTITION BY symbol, feature, cls))) AS term FROM jt)""",
]


@query(
    "fea_08_mutual_information",
    q.with_(*REL_SQL, *MI_CTE) + f"SELECT symbol, feature, {q.rnd('greatest(0, sum(term))')} AS score FROM mi GROUP BY 1, 2",
)
def fea_08(spark, sf):
    df = lb.direction_labels(features(spark, sf), F.lit(0.012), F.lit(-0.012))
    return sl.mutual_information(df, REL, "target_class").withColumn("score", rounded("score"))


@query("fea_09_select_features")
def fea_09(spark, sf):
    df = stored(lb.direction_labels(features(spark, sf), F.lit(0.012), F.lit(-0.012)), "labelled")
    kept = sl.select_features(df, ft.FEATURES, "target_class")
    return spark.createDataFrame([(f, i) for i, f in enumerate(kept, 1)], "feature string, place int")


@query(
    "srt_02_top_features",
    q.with_(*REL_SQL, RANK_CTE)
    + f"""SELECT symbol, feature, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, position) AS place FROM (
  SELECT symbol, feature, abs(corr(v, t)) AS score, list_position({REL!r}, feature) AS position FROM rk GROUP BY 1, 2)) WHERE place <= 5""",
)
def srt_02(spark, sf):
    scores = sl.pearson_importance(_nine_digits(spark, sf), REL, "target_return")
    position = F.array_position(F.array(*[F.lit(f) for f in REL]), F.col("feature"))
    top = lk.top_features(scores.withColumn("position", position), 8)
    return top.select("symbol", "feature", F.col("place").cast("long").alias("place"))


# -- augmentation ---------------------------------------------------------------------------

AUG_COLS = ["close", "volume"]
AUG_BASE = """base AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, stddev_pop(close) OVER (PARTITION BY symbol) AS sd_close,
  stddev_pop(volume) OVER (PARTITION BY symbol) AS sd_volume FROM num),
rep AS (SELECT *, unnest([1, 2]) AS replica FROM base)"""
ROW_KEY = "symbol || ':' || replica || ':' || ts"


def _z(col: str) -> str:
    return q.hash_n(f"{ROW_KEY} || ':jitter-{col}'")


@query(
    "aug_01_jitter",
    q.with_(q.INDEX_BARS, q.NUMBERED, AUG_BASE)
    + f"SELECT symbol, ts, replica, {q.rnd('close + sd_close * 0.008 * ' + _z('close'))} AS close, {q.rnd('abs(volume + sd_volume * 0.008 * ' + _z('volume') + ')')} AS volume FROM rep",
)
def aug_01(spark, sf):
    df = au.jitter(tables.index_bars(spark, sf), AUG_COLS, 2)
    return df.select("symbol", "ts", "replica", *rounded_cols(AUG_COLS))


def _knots_sql(kind: str) -> str:
    cells = ", ".join(
        f"least(2.0, greatest(0.5, 1.0 + 0.15 * {q.hash_n(f'symbol || {chr(39)}:{chr(39)} || replica || {chr(39)}:{kind}-{i}{chr(39)}')})) AS k{i}"
        for i in range(5)
    )
    return f"kn AS (SELECT *, {cells} FROM rep)"


def _spline_sql(t: str, y: list[str]) -> str:
    d1, d2, d3 = (f"({y[i - 1]} - 2 * {y[i]} + {y[i + 1]})" for i in (1, 2, 3))
    m2 = f"((6 * {d2} - {d1} - {d3}) / 4)"
    m = [f"(2 * {d1} - {m2})", d1, m2, d3, f"(2 * {d3} - {m2})"]
    out = "CASE least(3, greatest(0, floor(t)))"
    for i in range(4):
        a, b = f"({i + 1} - t)", f"(t - {i})"
        out += f" WHEN {i} THEN {m[i]} * pow({a}, 3) / 6 + {m[i + 1]} * pow({b}, 3) / 6 + ({y[i]} - {m[i]} / 6) * {a} + ({y[i + 1]} - {m[i + 1]} / 6) * {b}"
    return out + " END"


@query(
    "aug_02_magnitude_warp",
    q.with_(q.INDEX_BARS, q.NUMBERED, AUG_BASE, _knots_sql("magnitude"))
    + f"""SELECT symbol, ts, replica, {q.rnd('close * least(2.0, greatest(0.5, m))')} AS close, {q.rnd('volume')} AS volume FROM (
  SELECT *, {_spline_sql('t', ['k0', 'k1', 'k2', 'k3', 'k4'])} AS m FROM (SELECT *, rn * 4.0 / (n - 1) AS t FROM kn))""",
)
def aug_02(spark, sf):
    df = au.magnitude_warp(tables.index_bars(spark, sf), AUG_COLS, 2)
    return df.select("symbol", "ts", "replica", *rounded_cols(AUG_COLS))


@query(
    "aug_03_time_warp",
    q.with_(q.INDEX_BARS, q.NUMBERED, AUG_BASE, _knots_sql("time"))
    + f"""SELECT p.symbol, p.ts, replica, {q.rnd('a.close + (b.close - a.close) * (pos - floor(pos))')} AS close,
  {q.rnd('a.volume + (b.volume - a.volume) * (pos - floor(pos))')} AS volume FROM (
  SELECT symbol, ts, replica, greatest(0.0, least(n - 1.0, m * ((n - 1) / 4.0))) AS pos FROM (
    SELECT *, {_spline_sql('t', ['0.0', 'k1', '(2 * k2)', '(3 * k3)', '(4 * k4)'])} AS m FROM (SELECT *, rn / ((n - 1) / 4.0) AS t FROM kn))) p
  JOIN num a ON a.symbol = p.symbol AND a.rn = CAST(floor(pos) AS BIGINT) JOIN num b ON b.symbol = p.symbol AND b.rn = CAST(ceil(pos) AS BIGINT)""",
)
def aug_03(spark, sf):
    df = au.time_warp(tables.index_bars(spark, sf), AUG_COLS, 2)
    return df.select("symbol", "ts", "replica", *rounded_cols(AUG_COLS))


@query(
    "aug_04_policy",
    q.with_(q.INDEX_BARS, CLASS_SQL)
    + f"""SELECT symbol, n_rows, m AS multiplier, CASE WHEN n_rows >= 10 THEN greatest(m - 1, 1) ELSE 0 END AS replicas,
  {q.rnd("CASE WHEN n_rows < 2000 THEN round(greatest(1.5, least(4.0, 1000.0 / n_rows)) * CASE WHEN share < 0.15 THEN 1.3 ELSE 1 END, 1) END")} AS alternate_multiplier FROM (
  SELECT symbol, n_rows, CASE WHEN n_rows < 1000 THEN 3 WHEN n_rows < 5000 THEN 2 ELSE 1 END AS m, share FROM (
    SELECT symbol, sum(n) AS n_rows, min(n) FILTER (target_class IS NOT NULL) * 1.0 / sum(n) FILTER (target_class IS NOT NULL) AS share FROM (
      SELECT symbol, target_class, count(*) AS n FROM classes GROUP BY 1, 2) GROUP BY 1))""".replace("SELECT symbol, n_rows, m AS", "SELECT symbol, CAST(n_rows AS BIGINT) AS n_rows, m AS", 1),
)
def aug_04(spark, sf):
    return au.policy(labelled(spark, sf)).withColumn("alternate_multiplier", rounded("alternate_multiplier"))


@query("aug_05_replica_checks")
def aug_05(spark, sf):
    return au.replica_checks(au.augment(labelled(spark, sf), AUG_COLS), AUG_COLS)


@query("aug_05_set_checks")
def aug_05_set(spark, sf):
    df = au.set_checks(au.augment(labelled(spark, sf), AUG_COLS), AUG_COLS)
    return df.select("symbol", "column_name", *rounded_cols(["m0", "s0", "m", "s"]), "valid")


JITTER_SQL = f"""jit AS (SELECT symbol, 0 AS replica, close, volume FROM num UNION ALL
  SELECT symbol, replica, close + sd_close * 0.008 * {_z('close')}, abs(volume + sd_volume * 0.008 * {_z('volume')}) FROM rep)"""


def jittered(spark, sf):
    """Originals and two jittered replicas."""
    bars = tables.index_bars(spark, sf)
    return bars.withColumn("replica", F.lit(0)).unionByName(au.jitter(bars, AUG_COLS, 2))


@query(
    "aug_05_replica_checks_jitter",
    q.with_(q.INDEX_BARS, q.NUMBERED, AUG_BASE, JITTER_SQL)
    + """SELECT symbol, replica, n, n = max(CASE WHEN replica = 0 THEN n END) OVER (PARTITION BY symbol) AND nulls <= 0.1 AS valid FROM (
  SELECT symbol, replica, count(*) AS n, greatest(avg((close IS NULL)::INT), avg((volume IS NULL)::INT)) AS nulls FROM jit GROUP BY 1, 2)""",
)
def aug_05_jitter(spark, sf):
    return au.replica_checks(jittered(spark, sf), AUG_COLS)


@query(
    "aug_05_set_checks_jitter",
    q.with_(q.INDEX_BARS, q.NUMBERED, AUG_BASE, JITTER_SQL)
    + " UNION ALL ".join(
        f"""SELECT symbol, '{x}' AS column_name, {q.rnds(['m0', 's0', 'm', 's'])}, abs(m - m0) <= 0.3 * s0 AND abs(s - s0) <= 0.3 * s0 AS valid FROM (
  SELECT symbol, avg({x}) FILTER (replica = 0) AS m0, stddev_pop({x}) FILTER (replica = 0) AS s0, avg({x}) AS m, stddev_pop({x}) AS s FROM jit GROUP BY 1)"""
        for x in AUG_COLS
    ),
)
def aug_05_set_jitter(spark, sf):
    df = au.set_checks(jittered(spark, sf), AUG_COLS)
    return df.select("symbol", "column_name", *rounded_cols(["m0", "s0", "m", "s"]), "valid")


@query(
    "aug_06_labels_kept",
    q.with_(q.INDEX_BARS, CLASS_SQL)
    + """SELECT symbol, replica, CAST(target_class AS INTEGER) AS target_class, count(*) AS n FROM classes
  JOIN (SELECT symbol, CASE WHEN count(*) < 10 THEN 0 WHEN count(*) < 1000 THEN 2 ELSE 1 END AS k FROM classes GROUP BY 1) USING (symbol),
  (SELECT unnest([0, 1, 2]) AS replica) WHERE replica <= k GROUP BY 1, 2, 3""",
)
def aug_06(spark, sf):
    """Every replica has its original's class counts."""
    return au.augment(labelled(spark, sf), AUG_COLS).groupBy("symbol", "replica", "target_class").agg(F.count(F.lit(1)).alias("n"))
