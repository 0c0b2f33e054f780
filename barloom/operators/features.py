"""Model features, sequence windows and ordered splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators import indicators as ind
from barloom.operators.series import Series, Smooth, by_symbol, smooth
from barloom.sources.bars import clean

FEATURES = [
    "rsi",
    "macd",
    "macd_signal",
    "roc",
    "williams_r",
    "atr",
    "volatility_rolling",
    "atr_normalized",
    "volume_sma",
    "volume_ratio",
    "price_momentum",
    "price_acceleration",
    "day_of_week",
    "month",
]

LOOKBACK = 15
TRAIN_SHARE = 0.7


def annual_volatility(s: Series, n: int = 21) -> Series:
    s = s.with_columns({"_ret": ind.pct_change(s.frames)})
    sd = F.stddev_samp("_ret").over(s.frames.last(n)) * ind.ANNUAL
    s = s.with_columns({"volatility_rolling": F.when(F.col("rn") >= n, sd)})
    return Series(s.df.drop("_ret"), s.frames, s.halo)


def volume_features(s: Series, n: int = 21) -> Series:
    """Mean volume and its ratio; both 1 for a symbol that trades no volume."""
    f = s.frames
    traded = F.sum("volume").over(f.whole()) > 0
    mean = ind.sma(f, n, "volume")
    return s.with_columns(
        {
            "volume_sma": F.when(traded, mean).otherwise(1.0),
            "volume_ratio": F.when(traded, ratio("volume", mean)).otherwise(1.0),
        }
    )


def momentum(s: Series, n: int = 5) -> Series:
    s = s.with_columns({"price_momentum": ind.pct_change(s.frames, k=n)})
    return s.with_columns({"price_acceleration": ind.change(s.frames, "price_momentum")})


def calendar() -> dict[str, Column]:
    return {"day_of_week": F.weekday("ts") / 6.0, "month": F.month("ts") / 12.0}


def feature_suite(bars: DataFrame) -> DataFrame:
    """All model features.  RSI, MACD and ATR share the smoothing passes."""
    n = 14
    s = ind._moves(by_symbol(clean(bars)), n)
    s = smooth(s, ind.ema_specs((12, 26)) + ind._rsi_specs(n) + [ind._atr_spec(n)])
    f = s.frames
    s = s.with_columns(
        {
            "macd": ind.full(26, F.col("_ema_12") - F.col("_ema_26")),
            "rsi": F.when(F.col("rn") >= n, ind._rsi_value()),
            "roc": ind.roc(f, n),
            "williams_r": ind.williams_r(f, n),
            "atr": F.col(f"atr_{n}"),
        }
    )
    s = smooth(s, [Smooth("_sig", "macd", 0.2, start=25)])
    s = s.with_columns({"macd_signal": ind.full(34, F.col("_sig")), "atr_normalized": ratio("atr", "close"), **calendar()})
    s = momentum(volume_features(annual_volatility(s)))
    return s.df.select("symbol", "ts", "open", "high", "low", "close", "volume", *FEATURES)


def sequences(df: DataFrame, features: list[str], label: str, lookback: int = LOOKBACK) -> DataFrame:
    """For every row with ``lookback`` rows before it: those rows' features in time order
    (array of arrays) and the row's own label."""
    s = by_symbol(df)
    past = s.frames.between(-lookback, -1)
    x = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(past)
    out = s.df.select("symbol", "ts", "rn", label, x.alias("x"))
    return out.filter(F.col("rn") >= lookback).drop("rn")


def ordered_split(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark the first floor(share * n) rows of every symbol as training rows."""
    w = Window.partitionBy("symbol")
    place, n = F.row_number().over(w.orderBy("ts")), F.count(F.lit(1)).over(w)
    return df.withColumn("is_train", place <= F.floor(n * share))
