"""Price and RSI alert rules on the newest bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import two_decimals
from barloom.operators.indicators import add_rsi
from barloom.operators.series import by_symbol, last_rows
from barloom.sources.bars import clean

# fixed values: condition fields and rule types, ours and those existing users have stored
CONDITION = "reference double, rsi_limit double, valor_referencia double, limiar_rsi double"
STORED_TYPES = {
    "preco_acima": "price_above",
    "preco_abaixo": "price_below",
    "rsi_sobrecompra": "rsi_overbought",
    "rsi_sobrevenda": "rsi_oversold",
}
MIN_BARS = 60
HISTORY_DAYS = 260


def parse_rules(rules: DataFrame) -> DataFrame:
    """Condition text to a struct; stored type names are accepted beside ours."""
    names = F.create_map(*[F.lit(x) for pair in STORED_TYPES.items() for x in pair])
    kind = F.coalesce(names[F.col("type")], F.col("type"))
    given = F.from_json("condition", CONDITION)
    condition = F.struct(
        F.coalesce(given["reference"], given["valor_referencia"]).alias("reference"),
        F.coalesce(given["rsi_limit"], given["limiar_rsi"]).alias("rsi_limit"),
    )
    return rules.withColumns({"condition": condition, "type": kind})


def _plain(x: Column) -> Column:
    """A limit as it was written: without decimals when whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def evaluate_rules(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Fired rules (rule_id, symbol, message) from one row per symbol with ``close`` and
    ``rsi_14``.

    The join is on symbol; the latest bars are one row per symbol, which the optimiser
    broadcasts when their size allows, and skewed rule tables are split by AQE otherwise.
    """
    active = rules.filter("active").select("rule_id", "symbol", "type", "condition", "message")
    df = active.join(latest.select("symbol", "close", "rsi_14"), "symbol")
    close, rsi, ref = F.col("close"), F.col("rsi_14"), F.col("condition.reference")
    high = F.coalesce(F.col("condition.rsi_limit"), F.lit(70.0))
    low = F.coalesce(F.col("condition.rsi_limit"), F.lit(30.0))
    price = lambda word: F.concat(F.lit(" - Price ("), two_decimals(close), F.lit(f") {word} "), two_decimals(ref), F.lit("!"))
    level = lambda word, sign, lim: F.concat(F.lit(" - RSI ("), two_decimals(rsi), F.lit(f") {word} ({sign} "), _plain(lim), F.lit(")!"))
    kind = F.col("type")
    what = (
        F.when((kind == "price_above") & (close > ref), price("ABOVE"))
        .when((kind == "price_below") & (close < ref), price("BELOW"))
        .when((kind == "rsi_overbought") & (rsi > high), level("OVERBOUGHT", ">", high))
        .when((kind == "rsi_oversold") & (rsi < low), level("OVERSOLD", "<", low))
    )
    head = F.concat(F.lit("ALERT: ID:"), F.col("rule_id").cast("string"), F.lit(" - "), F.col("symbol"))
    custom = F.when(F.col("message") != "", F.concat(F.lit(" - "), F.col("message")))
    text = F.concat(head, F.coalesce(custom, F.lit("")), what)
    return df.filter(what.isNotNull()).select("rule_id", "symbol", text.alias("message"))


def rule_symbols(rules: DataFrame) -> DataFrame:
    return rules.filter("active").select("symbol").distinct()


def not_fired(alerts: DataFrame, fired: DataFrame) -> DataFrame:
    return alerts.join(fired.select("message"), "message", "left_anti")


def latest_indicators(bars: DataFrame) -> DataFrame:
    """Newest bar per symbol with its RSI, the only indicator the rules read."""
    rsi = add_rsi(by_symbol(clean(bars))).df.select("symbol", "ts", "close", "rsi_14")
    return last_rows(rsi, 1).drop("place")


def alert_run(bars: DataFrame, rules: DataFrame, as_of: Column, fired: DataFrame | None = None) -> DataFrame:
    """One alert cycle: symbols with active rules, 260 days of history, at least 60 bars,
    indicators, rules, minus the messages that fired before."""
    day = F.col("ts").cast("date")
    recent = bars.filter(day.between(F.date_sub(as_of, HISTORY_DAYS), as_of))
    recent = recent.join(rule_symbols(rules), "symbol", "left_semi")
    enough = recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_BARS)
    recent = recent.join(enough.select("symbol"), "symbol", "left_semi")
    alerts = evaluate_rules(latest_indicators(recent), rules)
    return alerts if fired is None else not_fired(alerts, fired)


def dashboard(quotes: DataFrame, macro: DataFrame, points: DataFrame, tail: int = 5) -> DataFrame:
    """Quotes, latest macro values and the tail of each series, as one
    long table (section, name, ts, value, change_pct)."""
    none = F.lit(None).cast("double")
    q = quotes.select(
        F.lit("quotes").alias("section"),
        F.col("symbol").alias("name"),
        F.col("ts").cast("date").alias("ts"),
        F.col("price").alias("value"),
        "change_pct",
    )
    m = macro.select(
        F.lit("macro").alias("section"), F.col("series_id").alias("name"), F.col("date").alias("ts"), "value", none.alias("change_pct")
    )
    t = last_rows(points, tail, "series_id", "date").select(
        F.lit("series").alias("section"), F.col("series_id").alias("name"), F.col("date").alias("ts"), "value", none.alias("change_pct")
    )
    return q.unionByName(m).unionByName(t)
