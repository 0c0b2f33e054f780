"""Technical indicators over all symbols at once.

Each function takes and returns a ``Series``; a rolling value is null until its
window is full, so a symbol shorter than the window has nulls only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.series import (
    Frames,
    Series,
    Smooth,
    by_block,
    by_symbol,
    decay_rows,
    running_total,
    smooth,
)
from barloom.sources.bars import clean

SPANS = (9, 21, 50, 200)


def full(n: int, value: Column) -> Column:
    return F.when(F.col("rn") >= n - 1, value)


def sma(f: Frames, n: int, x: str = "close") -> Column:
    return full(n, F.avg(x).over(f.last(n)))


def change(f: Frames, x: str = "close", k: int = 1) -> Column:
    return F.col(x) - F.lag(x, k).over(f.ordered())


def pct_change(f: Frames, x: str = "close", k: int = 1) -> Column:
    prev = F.lag(x, k).over(f.ordered())
    return ratio(F.col(x) - prev, prev)


def roc(f: Frames, n: int = 14) -> Column:
    return 100.0 * pct_change(f, "close", n)


def williams_r(f: Frames, n: int = 14) -> Column:
    """-100 at the bottom of the last n bars' range, 0 at its top; the middle (-50) for a symbol that has closes but no
    highs or no lows at all."""
    no_range = (F.count("high").over(f.whole()) == 0) | (F.count("low").over(f.whole()) == 0)
    return F.when(no_range, F.lit(-50.0)).otherwise(_williams_r(f, n))


def _williams_r(f: Frames, n: int) -> Column:
    hi, lo = F.max("high").over(f.last(n)), F.min("low").over(f.last(n))
    return full(n, -100.0 * ratio(hi - F.col("close"), hi - lo))


def true_range(f: Frames) -> Column:
    prev = F.lag("close").over(f.ordered())
    span = F.col("high") - F.col("low")
    return F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def add_sma(s: Series, spans=SPANS) -> Series:
    return s.with_columns({f"sma_{n}": sma(s.frames, n) for n in spans})


def ema_specs(spans) -> list[Smooth]:
    return [Smooth(f"_ema_{n}", "close", 2.0 / (n + 1)) for n in spans]


def add_ema(s: Series, spans=SPANS) -> Series:
    s = smooth(s, ema_specs(spans))
    return _finish_ema(s, spans)


def _finish_ema(s: Series, spans) -> Series:
    s = s.with_columns({f"ema_{n}": full(n, F.col(f"_ema_{n}")) for n in spans})
    return Series(s.df.drop(*[f"_ema_{n}" for n in spans]), s.frames, s.halo)


def add_macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> Series:
    s = smooth(s, ema_specs((fast, slow)))
    s = s.with_columns({"macd": full(slow, F.col(f"_ema_{fast}") - F.col(f"_ema_{slow}"))})
    s = smooth(s, [Smooth("_sig", "macd", 2.0 / (signal + 1), start=slow - 1)])
    return _finish_macd(s, fast, slow, signal)


def _finish_macd(s: Series, fast: int, slow: int, signal: int) -> Series:
    sig = full(slow + signal - 1, F.col("_sig"))
    s = s.with_columns({"macd_signal": sig, "macd_hist": F.col("macd") - sig})
    return Series(s.df.drop("_sig", f"_ema_{fast}", f"_ema_{slow}"), s.frames, s.halo)


def add_bollinger(s: Series, n: int = 20, k: float = 2.0) -> Series:
    f = s.frames
    mid, sd = F.avg("close").over(f.last(n)), F.stddev_pop("close").over(f.last(n))
    s = s.with_columns(
        {
            "bb_high": full(n, mid + k * sd),
            "bb_mid": full(n, mid),
            "bb_low": full(n, mid - k * sd),
        }
    )
    wide = F.col("bb_high") - F.col("bb_low")
    return s.with_columns(
        {
            "bb_width": 100.0 * ratio(wide, "bb_mid"),
            "bb_pband": ratio(F.col("close") - F.col("bb_low"), wide),
        }
    )


def _wilder(out: str, x: str, n: int, first: int, seed: str) -> Smooth:
    """Wilder smoothing whose seed is the mean of the n rows from ``first`` on."""
    return Smooth(out, x, 1.0 / n, start=first + n - 1, seed=seed)


def _moves(s: Series, n: int) -> Series:
    """Per-bar inputs of the Wilder indicators and the means that seed them."""
    f = s.frames
    d = change(f)
    up = change(f, "high")
    down = -change(f, "low")
    zero = F.lit(0.0)
    first = F.col("rn") == 0
    s = s.with_columns(
        {
            "_gain": F.when(first, zero).otherwise(F.greatest(d, zero)),
            "_loss": F.when(first, zero).otherwise(F.greatest(-d, zero)),
            "_tr": true_range(f),
            "_pdm": F.when((up > down) & (up > 0), up).otherwise(zero),
            "_mdm": F.when((down > up) & (down > 0), down).otherwise(zero),
        }
    )
    return s.with_columns({f"_s{x}": F.avg(x).over(f.last(n)) for x in ("_gain", "_loss", "_tr", "_pdm", "_mdm")})


MOVES = ["_gain", "_loss", "_tr", "_pdm", "_mdm"]
MOVE_SCRATCH = MOVES + [f"_s{x}" for x in MOVES]


def _rsi_specs(n: int) -> list[Smooth]:
    return [_wilder("_ag", "_gain", n, 1, "_s_gain"), _wilder("_al", "_loss", n, 1, "_s_loss")]


def _rsi_value() -> Column:
    gain, loss = F.col("_ag"), F.col("_al")
    return F.when(loss == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + ratio(gain, loss)))


def add_rsi(s: Series, n: int = 14) -> Series:
    s = smooth(_moves(s, n), _rsi_specs(n))
    s = s.with_columns({f"rsi_{n}": F.when(F.col("rn") >= n, _rsi_value())})
    return Series(s.df.drop("_ag", "_al", *MOVE_SCRATCH), s.frames, s.halo)


def _atr_spec(n: int) -> Smooth:
    return _wilder(f"atr_{n}", "_tr", n, 0, "_s_tr")


def add_atr(s: Series, n: int = 14) -> Series:
    s = smooth(_moves(s, n), [_atr_spec(n)])
    return Series(s.df.drop(*MOVE_SCRATCH), s.frames, s.halo)


def _dm_specs(n: int) -> list[Smooth]:
    return [_wilder(f"_w{x}", x, n, 1, f"_s{x}") for x in ("_tr", "_pdm", "_mdm")]


def _dx(s: Series, n: int) -> Series:
    s = s.with_columns(
        {"di_plus": 100.0 * ratio("_w_pdm", "_w_tr"), "di_minus": 100.0 * ratio("_w_mdm", "_w_tr")}
    )
    total = F.col("di_plus") + F.col("di_minus")
    dx = 100.0 * F.coalesce(ratio(F.abs(F.col("di_plus") - F.col("di_minus")), total), F.lit(0.0))
    s = s.with_columns({"_dx": F.when(F.col("rn") >= n, dx)})
    return s.with_columns({"_s_dx": F.avg("_dx").over(s.frames.last(n))})


def _adx_spec(n: int) -> Smooth:
    return _wilder(f"adx_{n}", "_dx", n, n, "_s_dx")


def add_adx(s: Series, n: int = 14) -> Series:
    s = _dx(smooth(_moves(s, n), _dm_specs(n)), n)
    s = smooth(s, [_adx_spec(n)])
    return Series(s.df.drop("_dx", "_s_dx", "_w_tr", "_w_pdm", "_w_mdm", *MOVE_SCRATCH), s.frames, s.halo)


def add_stochastic(s: Series, n: int = 14, d: int = 3) -> Series:
    f = s.frames
    hi, lo = F.max("high").over(f.last(n)), F.min("low").over(f.last(n))
    s = s.with_columns({"stoch_k": full(n, 100.0 * ratio(F.col("close") - lo, hi - lo))})
    values = F.count("stoch_k").over(f.last(d))
    return s.with_columns({"stoch_d": F.when(values == d, F.avg("stoch_k").over(f.last(d)))})


def add_obv(s: Series) -> Series:
    """Signed running volume; null for a symbol without any volume."""
    sign = F.coalesce(F.signum(change(s.frames)), F.lit(0.0))
    s = running_total(s.with_columns({"_sv": sign * F.col("volume")}), "_sv", "_obv")
    if s.halo:
        own = s.df.filter("rn >= blk_start").groupBy("symbol").agg(F.sum("volume").alias("_vol"))
        s = Series(s.df.join(own, "symbol"), s.frames, True)
    else:
        s = s.with_columns({"_vol": F.sum("volume").over(s.frames.whole())})
    s = s.with_columns({"obv": F.when(F.col("_vol") > 0, F.col("_obv"))})
    return Series(s.df.drop("_sv", "_obv", "_vol"), s.frames, s.halo)


def add_return_volatility(s: Series, n: int = 20) -> Series:
    """Sample deviation of the last n returns, in percent; row n is the first with n returns."""
    s = s.with_columns({"_ret": pct_change(s.frames)})
    sd = 100.0 * F.stddev_samp("_ret").over(s.frames.last(n))
    s = s.with_columns({f"ret_std_{n}": F.when(F.col("rn") >= n, sd)})
    return Series(s.df.drop("_ret"), s.frames, s.halo)


SUITE = (
    [f"sma_{n}" for n in SPANS]
    + [f"ema_{n}" for n in SPANS]
    + ["macd", "macd_signal", "macd_hist"]
    + ["bb_high", "bb_mid", "bb_low", "bb_width", "bb_pband"]
    + ["adx_14", "di_plus", "di_minus", "rsi_14", "stoch_k", "stoch_d", "obv", "atr_14", "ret_std_20"]
)

# rows of history that settle every indicator of the suite: the slowest is EMA(200);
# ADX smooths twice
SUITE_LOOKBACK = max(decay_rows(2.0 / 201.0), 2 * decay_rows(1.0 / 14.0) + 28)


def suite(s: Series) -> Series:
    """All indicators.  The smoothings run in two stages (the second needs the first's
    results), each in two shared window passes."""
    n = 14
    s = _moves(add_sma(s), n)
    s = smooth(s, ema_specs(SPANS + (12, 26)) + _rsi_specs(n) + [_atr_spec(n)] + _dm_specs(n))
    s = s.with_columns(
        {
            "macd": full(26, F.col("_ema_12") - F.col("_ema_26")),
            "rsi_14": F.when(F.col("rn") >= n, _rsi_value()),
        }
    )
    s = _dx(s, n)
    s = smooth(s, [Smooth("_sig", "macd", 0.2, start=25), _adx_spec(n)])
    s = _finish_ema(_finish_macd(s, 12, 26, 9), SPANS)
    s = add_return_volatility(add_obv(add_stochastic(add_bollinger(s))))
    scratch = ["_ag", "_al", "_dx", "_s_dx", "_w_tr", "_w_pdm", "_w_mdm", *MOVE_SCRATCH]
    return Series(s.df.drop(*scratch), s.frames, s.halo)


def indicator_suite(bars: DataFrame) -> DataFrame:
    """Bars of an hour or longer with all 25 indicator columns."""
    return suite(by_symbol(clean(bars))).result("rn")


def indicator_suite_blocked(bars: DataFrame, block_rows: int = 65_536, bucket: Column | None = None) -> DataFrame:
    """The same for bars finer than an hour: no task holds more than one block."""
    return suite(by_block(clean(bars), SUITE_LOOKBACK, block_rows, bucket)).result("rn")


def select_indicators(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The bar columns and the asked-for indicators that exist; Catalyst then drops the
    windows nobody reads."""
    bar = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    return df.select(*bar, *[w for w in wanted if w in df.columns and w not in bar])


ANNUAL = math.sqrt(252.0)
