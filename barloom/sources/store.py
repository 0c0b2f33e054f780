"""Payload cache keys, expiry, and keyed tables kept as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_key(origin: Column, endpoint: Column, params: dict[str, Column] | None = None) -> Column:
    """md5 of ``origin:endpoint:params`` with the parameters as JSON text in key order."""
    if params:
        parts = []
        for name in sorted(params):
            quoted = F.to_json(F.array(params[name]))  # ["value"] with JSON escapes
            value = F.coalesce(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("null"))
            parts.append(F.concat(F.lit(f'"{name}": '), value))
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    else:
        text = F.lit("")
    return F.md5(F.concat_ws(":", origin, endpoint, text))


def latest_payload(raw: DataFrame, now: float, key: str = "key") -> DataFrame:
    """Newest payload per key with its state: ``live`` while now - ts < ttl, ``expired``
    after that, ``bad_json`` when live text does not parse (both are to be evicted).

    The newest one is an aggregate, so a key with very many versions merges map-side.
    """
    newest = raw.groupBy(key).agg(F.max_by(F.struct("value", "ts", "ttl"), F.struct("ts", "value")).alias("p"))
    parsed = F.try_parse_json("p.value")
    state = (
        F.when(F.lit(now) - F.col("p.ts") >= F.col("p.ttl"), "expired")
        .when(parsed.isNull(), "bad_json")
        .otherwise("live")
    )
    return newest.select(key, F.col("p.value").alias("value"), F.col("p.ts").alias("ts"), state.alias("state"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """New snapshot of a keyed table: the last change of a key replaces its row, a last
    change marked deleted removes it."""
    cols = base.columns
    rest = [c for c in cols if c not in keys]
    old = base.withColumns({deleted: F.lit(False), seq: F.lit(-1).cast("long")})
    new = changes.select(*cols, F.col(deleted), F.col(seq).cast("long").alias(seq))
    row = F.struct(*rest, deleted)
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by(row, seq).alias("r"))
    return last.filter(~F.col(f"r.{deleted}")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_new(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unique insert: rows whose key is there already are refused."""
    fresh = rows.join(base.select(*keys), keys, "left_anti").select(*base.columns)
    return base.unionByName(fresh)


def update_fields(base: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Overwrite the given fields of matching rows where the change has a value.
    ``changes`` holds one row per key."""
    new = changes.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = base.join(new, keys, "left")
    return joined.select(
        *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def delete_keys(base: DataFrame, keys_to_drop: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(keys_to_drop.select(*keys), keys, "left_anti")
