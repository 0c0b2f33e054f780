"""Spark types of the results of Arrow functions; made without a session."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, STRING, BINARY, DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType()


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def many(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)
