"""Small constant tables as inline VALUES, so the optimizer knows their exact size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def literal(v: object) -> str:
    """SQL text of a Python constant."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A local relation from literal rows (numbers, text, booleans, dates as text, None)."""
    struct = T.StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], struct)
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    raw = ", ".join(f"`{f.name}`" for f in struct.fields)
    typed = ", ".join(f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in struct.fields)
    return spark.sql(f"select {typed} from values {body} as t({raw})")
