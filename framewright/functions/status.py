"""Statuses of rows: 0 for success, negative codes for errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes, names and messages of errors; in braces, what an error carries. -1000 is an addition of this
# library.
ERRORS = {
    -1: ("BufferTooSmall", "Buffer too small: {required} bytes required"),
    -2: ("InvalidChannelCount", "Invalid channel count: expected {expected}, got {actual}"),
    -3: ("CorruptedHeader", "Corrupted packet header (invalid magic bytes)"),
    -4: ("UnsupportedVersion", "Unsupported codec version: {version}"),
    -5: ("InvalidStrategy", "Invalid compression strategy ID: {strategy_id}"),
    -6: ("UnexpectedEndOfInput", "Unexpected end of input (truncated data)"),
    -7: ("InvalidZigZagValue", "Invalid ZigZag encoded value"),
    -8: ("InvalidRiceParameter", "Invalid Rice parameter k={k} (must be 0-3)"),
    -9: ("BitPositionOverflow", "Bit position overflow in BitWriter"),
    -10: ("RiceQuotientOverflow", "Rice quotient overflow: value {value} too large for k={k} (quotient would exceed 255)"),
    -1000: ("WidthUnsupported", "Block width unsupported: more than 15 bits a value"),
}


def error_name(code: Column) -> Column:
    """Name of a status, null for 0 and unknown codes."""
    out = F.lit(None).cast("string")
    for k, (name, _) in ERRORS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def error_code(name: Column) -> Column:
    """Code of a name, null for unknown names."""
    out = F.lit(None).cast("int")
    for k, (known, _) in ERRORS.items():
        out = F.when(name == known, k).otherwise(out)
    return out


def error_message(code: Column, **details: Column) -> Column:
    """The sentence for a status, with its details; one that is not given counts as 0, as it is when an error comes
    from its code alone."""
    out = F.lit(None).cast("string")
    for k, (_, text) in ERRORS.items():
        parts = re.split(r"\{(\w+)\}", text)
        words = [details.get(p, F.lit(0)).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)]
        out = F.when(code == k, F.concat(*words)).otherwise(out)
    return out


def error_table(spark: SparkSession) -> DataFrame:
    """code, name of the errors that packets share with other implementations."""
    return spark.createDataFrame([(k, v[0]) for k, v in ERRORS.items() if k > -1000], "code int, name string")
