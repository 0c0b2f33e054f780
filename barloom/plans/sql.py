"""Pieces of the DuckDB comparison SQL."""

from __future__ import annotations


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rnds(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{rnd(n, digits)} AS {n}" for n in names)


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


ORDER_BARS = """bars AS (
  SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

NATION_BARS = """bars AS (
  SELECT n_name AS symbol, CAST(o_orderdate AS DATE) AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""

EVENT_BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


def _damp(c: str) -> str:
    return f"round(100.0 * pow({c} / 250000.0, CAST(0.01 AS DOUBLE)), 6) AS {c}"


INDEX_BARS = (
    ORDER_BARS.replace("bars AS", "raw_bars AS", 1)
    + f""",
bars AS (SELECT symbol, ts, {_damp('open')}, {_damp('high')}, {_damp('low')}, {_damp('close')}, volume FROM raw_bars)"""
)

# every bar with its position, the previous bar and the one-bar return
NUMBERED = """num AS (
  SELECT *, row_number() OVER w - 1 AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
         close / nullif(lag(close) OVER w, 0) - 1 AS ret
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def ewm(name: str, src: str, x: str, alpha: str, start: int = 0, seed: str | None = None) -> str:
    """Recursive smoothing of ``x`` over ``src`` from row ``start`` on -> name(symbol, rn, y)."""
    return f"""{name} AS (
  SELECT symbol, rn, CAST({seed or x} AS DOUBLE) AS y FROM {src} WHERE rn = {start}
  UNION ALL
  SELECT n.symbol, n.rn, {alpha} * n.{x} + (1 - {alpha}) * e.y
  FROM {name} e JOIN {src} n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


MOVES = """mv AS (
  SELECT *, CASE WHEN rn = 0 THEN 0 ELSE greatest(close - pc, 0) END AS gain,
         CASE WHEN rn = 0 THEN 0 ELSE greatest(pc - close, 0) END AS loss,
         CASE WHEN rn = 0 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
         CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm
  FROM num),
seeded AS (
  SELECT *, avg(gain) OVER w AS sgain, avg(loss) OVER w AS sloss, avg(tr) OVER w AS str, avg(pdm) OVER w AS spdm,
         avg(mdm) OVER w AS smdm
  FROM mv WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING))"""

RSI = ",\n".join(
    [
        ewm("ag", "seeded", "gain", "(1.0/14)", 14, "sgain"),
        ewm("al", "seeded", "loss", "(1.0/14)", 14, "sloss"),
        """rsi AS (
  SELECT ag.symbol, ag.rn, CASE WHEN al.y = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ag.y / al.y) END AS rsi_14
  FROM ag JOIN al USING (symbol, rn))""",
    ]
)

ATR = ewm("atr", "seeded", "tr", "(1.0/14)", 13, "str")


def ema(n: int) -> str:
    return ewm(f"ema{n}", "num", "close", f"(2.0/{n + 1})")


MACD = ",\n".join(
    [
        ema(12),
        ema(26),
        "line AS (SELECT a.symbol, a.rn, a.y - b.y AS m FROM ema12 a JOIN ema26 b USING (symbol, rn) WHERE a.rn >= 25)",
        ewm("sig", "line", "m", "0.2", 25),
        """macd AS (SELECT l.symbol, l.rn, l.m AS macd, CASE WHEN l.rn >= 33 THEN s.y END AS macd_signal
  FROM line l LEFT JOIN sig s USING (symbol, rn))""",
    ]
)

ADX = ",\n".join(
    [
        ewm("wtr", "seeded", "tr", "(1.0/14)", 14, "str"),
        ewm("wpdm", "seeded", "pdm", "(1.0/14)", 14, "spdm"),
        ewm("wmdm", "seeded", "mdm", "(1.0/14)", 14, "smdm"),
        """di AS (
  SELECT t.symbol, t.rn, 100 * p.y / nullif(t.y, 0) AS di_plus, 100 * m.y / nullif(t.y, 0) AS di_minus
  FROM wtr t JOIN wpdm p USING (symbol, rn) JOIN wmdm m USING (symbol, rn)),
dx AS (SELECT *, coalesce(100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0), 0) AS dx FROM di),
dxs AS (SELECT *, avg(dx) OVER (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING) AS sdx FROM dx)""",
        ewm("adx", "dxs", "dx", "(1.0/14)", 27, "sdx"),
    ]
)


def roll(fn: str, x: str, n: int) -> str:
    """A rolling aggregate that is null until its window is full."""
    w = f"OVER (PARTITION BY symbol ORDER BY rn ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN rn >= {n - 1} THEN {fn}({x}) {w} END"


def hash_u(key: str) -> str:
    return f"((CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def hash_n(key: str) -> str:
    return f"(sqrt(-2.0 * ln({hash_u(key + chr(32) + '|| ' + repr(':a'))})) * cos(2.0 * pi() * {hash_u(key + chr(32) + '|| ' + repr(':b'))}))"
