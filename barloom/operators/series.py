"""Ordered series: window frames, row positions, block layout and the
exponential-smoothing scan.

Two layouts are offered:

* ``by_symbol`` - one window partition per symbol.  Meant for bars of an hour or
  longer: a symbol has at most one bar per interval, so a partition is bounded by
  the calendar (8,784 rows per year at one hour), however many raw ticks the
  symbol holds.
* ``by_block`` - for finer bars.  Each symbol is cut into blocks of
  ``block_rows`` rows and every block carries a copy of the ``lookback`` rows
  before it, so no task sees more than ``block_rows + lookback`` rows of one
  symbol.  Results equal the first layout's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import c


@dataclass(frozen=True)
class Frames:
    """Window specifications over one ordered series per key."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def between(self, lo: int, hi: int):
        return self.ordered().rowsBetween(lo, hi)

    def last(self, n: int):
        """The current row and the n-1 rows before it."""
        return self.between(-(n - 1), 0)

    def running(self):
        return self.between(Window.unboundedPreceding, 0)

    def before(self):
        return self.between(Window.unboundedPreceding, -1)

    def entire(self):
        return self.between(Window.unboundedPreceding, Window.unboundedFollowing)

    def whole(self):
        return Window.partitionBy(*self.keys)


BY_SYMBOL = Frames()


@dataclass
class Series:
    """A numbered table (``rn`` counts rows of a symbol from 0) and its frames."""

    df: DataFrame
    frames: Frames = field(default_factory=Frames)
    halo: bool = False

    def with_columns(self, cols: dict[str, Column]) -> "Series":
        return Series(self.df.withColumns(cols), self.frames, self.halo)

    def result(self, *drop: str) -> DataFrame:
        df = self.df.filter("rn >= blk_start").drop("blk", "blk_start") if self.halo else self.df
        return df.drop(*drop)


def by_symbol(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> Series:
    """Number the rows of every symbol; all later windows share this one exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return Series(df.withColumn("rn", F.row_number().over(w) - 1), Frames(keys, order))


def numbered_by_bucket(df: DataFrame, bucket: Column, order: str = "ts", key: str = "symbol") -> DataFrame:
    """Row positions of long series without one task per symbol.

    Rows are counted per (symbol, calendar bucket); the counts, one row per bucket,
    are summed over the earlier buckets; rows are then numbered inside their bucket
    only.  ``bucket`` must not decrease with ``order``.  ``n_rows`` is the symbol's length.
    """
    df = df.withColumn("bkt", bucket)
    counts = df.groupBy(key, "bkt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key,
        "bkt",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"),
        F.sum("n").over(Window.partitionBy(key)).alias("n_rows"),
    )
    inside = Window.partitionBy(key, "bkt").orderBy(order)
    return (
        df.join(offsets, [key, "bkt"])
        .withColumn("rn", (F.row_number().over(inside) - 1 + F.col("off")).cast("long"))
        .drop("bkt", "off")
    )


def by_block(
    df: DataFrame, lookback: int, block_rows: int = 65_536, bucket: Column | None = None, order: str = "ts"
) -> Series:
    """Cut every symbol into blocks that also hold the ``lookback`` rows before them.

    Calendar days are the default bucket for numbering (86,400 rows at one second).
    """
    bucket = F.col(order).cast("date") if bucket is None else bucket
    block_of = lambda row: F.floor(row / block_rows).cast("long")
    last = F.least(block_of(F.col("rn") + lookback), block_of(F.col("n_rows") - 1))
    spread = (
        numbered_by_bucket(df, bucket, order)
        .withColumn("blk", F.explode(F.sequence(block_of(F.col("rn")), last)))
        .withColumn("blk_start", F.col("blk") * block_rows)
        .drop("n_rows")
    )
    return Series(spread, Frames(("symbol", "blk"), ("rn",)), halo=True)


def decay_rows(alpha: float, nats: float = 45.0) -> int:
    """Rows after which a smoothing weight is below e^-nats of the newest one."""
    return math.ceil(nats / -math.log(1.0 - alpha))


@dataclass(frozen=True)
class Smooth:
    """One exponential smoothing: y = (1-alpha)*y' + alpha*x from row ``start`` on,
    where ``seed`` (default x itself) is the value at ``start``."""

    out: str
    x: str
    alpha: float
    start: int = 0
    seed: str | None = None


def smooth(series: Series, specs: list[Smooth]) -> Series:
    """Run several exponential smoothings over a series as window sums.

    The recurrence is a weighted sum, so inside a segment of rows it is
    ``q^j * sum(x * q^-j)``.  Segments keep ``q^-j`` finite; the value at the end of
    the earlier segments enters with weight ``q^(j+1)``.  All specs share two window
    passes.  Rows before ``start`` are null.
    """
    steepest = max(-math.log(1.0 - s.alpha) for s in specs)
    seg_rows = 2048 if steepest * 2048 < 600 else 512
    if steepest * seg_rows >= 600:
        raise ValueError("alpha too large for the segment scan; use a span of 2 or more")
    f = series.frames
    seg, j = F.floor(F.col("rn") / seg_rows), F.col("rn") % seg_rows
    df = series.df.withColumn("_seg", seg).withColumn("_j", j.cast("double"))
    inside = Window.partitionBy(*f.keys, "_seg").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)

    def q(s: Smooth) -> str:
        return f"{1.0 - s.alpha!r}D"

    def weighted(s: Smooth) -> str:
        v = f"CASE WHEN rn = {s.start} THEN {s.seed or s.x} WHEN rn > {s.start} THEN {s.alpha!r}D * {s.x} ELSE 0D END"
        return f"({v}) * pow({q(s)}, -_j)"

    df = df.withColumns({f"_l_{s.out}": F.sum(F.expr(weighted(s))).over(inside) for s in specs})
    df = df.withColumns({f"_l_{s.out}": F.expr(f"_l_{s.out} * pow({q(s)}, _j)") for s in specs})
    ends = {f"_e_{s.out}": F.expr(f"CASE WHEN _j = {seg_rows - 1} THEN _l_{s.out} END") for s in specs}
    df = df.withColumns({name: F.collect_list(end).over(f.before()) for name, end in ends.items()})

    def folded(s: Smooth) -> str:
        q_seg = f"{(1.0 - s.alpha) ** seg_rows!r}D"
        carry = f"aggregate(_e_{s.out}, 0D, (acc, e) -> acc * {q_seg} + e)"
        return f"CASE WHEN rn >= {s.start} THEN _l_{s.out} + {carry} * pow({q(s)}, _j + 1) END"

    df = df.withColumns({s.out: F.expr(folded(s)) for s in specs})
    scratch = ["_seg", "_j"] + [f"_{k}_{s.out}" for k in "le" for s in specs]
    return Series(df.drop(*scratch), f, series.halo)


def running_total(series: Series, x: Column | str, out: str) -> Series:
    """Running sum; over blocks the earlier blocks' totals are added by a join on
    one row per block."""
    if not series.halo:
        return series.with_columns({out: F.sum(c(x)).over(series.frames.running())})
    own = F.when(F.col("rn") >= F.col("blk_start"), c(x))
    df = series.df.withColumn("_own", own)
    totals = df.groupBy("symbol", "blk").agg(F.sum("_own").alias("_t"))
    before = Window.partitionBy("symbol").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("symbol", "blk", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_t"))
    df = df.join(totals, ["symbol", "blk"]).withColumn(
        out, F.col("_t") + F.sum("_own").over(series.frames.running())
    )
    return Series(df.drop("_t", "_own"), series.frames, True)


def fill_gaps(series: Series, names: list[str]) -> Series:
    """Forward fill, then backward fill.  After the forward fill only the rows before a
    symbol's first value are null, and they all take that first value."""
    f = series.frames
    return series.with_columns(
        {
            n: F.coalesce(F.last(n, ignorenulls=True).over(f.running()), F.first(n, ignorenulls=True).over(f.entire()))
            for n in names
        }
    )


def last_rows(df: DataFrame, n: int, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The n newest rows per symbol with their place (1 = newest)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
