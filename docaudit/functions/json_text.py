"""JSON helpers that need Python objects (only JSON artifacts reach them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pretty_json(c: Column) -> Column:
    """Two-space pretty print; null for text that is not JSON or is null, false, 0 or "".

    The function is built here so that it travels to the executors by value.
    """
    import pandas as pd

    def pretty(raw: pd.Series) -> pd.Series:
        import json

        def shape(value):
            """Whole floats print without a fraction; array-index keys come first, ascending."""
            if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
                return int(value)
            if isinstance(value, list):
                return [shape(v) for v in value]
            if isinstance(value, dict):
                index = sorted((k for k in value if k.isdigit() and str(int(k)) == k), key=int)
                rest = [k for k in value if k not in set(index)]
                return {k: shape(value[k]) for k in [*index, *rest]}
            return value

        def one(text):
            if text is None:
                return None
            try:
                value = json.loads(text, parse_constant=lambda name: 1 / 0)
            except (ValueError, ZeroDivisionError, RecursionError):
                return None
            truthy = isinstance(value, (dict, list)) or bool(value)
            return json.dumps(shape(value), indent=2, ensure_ascii=False) if truthy else None

        return raw.map(one)

    pretty.__annotations__ = {"raw": pd.Series, "return": pd.Series}
    return F.pandas_udf(pretty, T.StringType())(c)
