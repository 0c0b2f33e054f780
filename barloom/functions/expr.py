"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Col, den: Col) -> Column:
    """num/den, null where the denominator is zero or null."""
    return c(num) / F.nullif(c(den), F.lit(0.0))


def rounded(x: Col, digits: int = 6) -> Column:
    return F.round(c(x).cast("double"), digits)


def rounded_cols(names: list[str], digits: int = 6) -> list[Column]:
    return [rounded(n, digits).alias(n) for n in names]


def clip(x: Col, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c(x)))


def safe_ln(x: Col) -> Column:
    return F.when(c(x) > 0, F.ln(c(x)))


def band(x: Col, steps: list[tuple[float, object]], otherwise: object, below: bool = True) -> Column:
    """Label a value by the first step it falls below (or, ``below=False``, exceeds)."""
    col, out = c(x), None
    for limit, label in steps:
        cond = col < limit if below else col > limit
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def argmax_first(cols: list[Col]) -> Column:
    """Index of the largest of several columns; the first one wins ties."""
    best = F.greatest(*[c(x) for x in cols])
    out = F.when(c(cols[0]) == best, F.lit(0))
    for i, x in enumerate(cols[1:], 1):
        out = out.when(c(x) == best, F.lit(i))
    return out


def row_mean(cols: list[Col]) -> Column:
    """Mean over the non-null columns of a row; null when all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c(x), F.lit(0.0)) for x in cols])
    n = reduce(lambda a, b: a + b, [c(x).isNotNull().cast("int") for x in cols])
    return total / F.nullif(n.cast("double"), F.lit(0.0))


def row_count(conds: list[Column]) -> Column:
    """How many of several conditions hold (null counts as not)."""
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("long") for x in conds])


def hash_uniform(*key: Col) -> Column:
    """A uniform draw in (0,1) from the md5 of the key parts joined by ``:``.

    Unlike ``rand(seed)`` the draw belongs to the key, so it is the same on any
    partitioning and after a lost executor recomputes its rows.
    """
    text = F.concat_ws(":", *[c(k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def hash_normal(*key: Col) -> Column:
    """A standard normal draw from two keyed uniforms (Box-Muller)."""
    u, v = hash_uniform(*key, F.lit("a")), hash_uniform(*key, F.lit("b"))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)
