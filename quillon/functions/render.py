"""Rows as ``v1|v2|`` lines, for consumers of the text protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render_double(x: Column) -> Column:
    """Shortest round-trip digits without an exponent; integral values under 1e15 get one decimal."""
    s = x.cast("string")
    exponent = F.regexp_extract(s, "E(-?[0-9]+)$", 1)
    shift = F.when(exponent == "", 0).otherwise(exponent).cast("int")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(s, "^-|E.*$", "")
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.concat(whole, F.when(part == "0", "").otherwise(part))
    # a decimal point after so many digits
    point = F.length(whole) + shift
    spread = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    integral = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when(s == "-0.0", "-0.0")
        .when((x == F.floor(x).cast("double")) & (F.abs(x) < 1e15), integral)
        .when(exponent == "", s)
        .otherwise(F.concat(sign, spread))
    )


def render_rows(df: DataFrame) -> DataFrame:
    """One ``line`` column: each value followed by ``|``, null as nothing; the order of rows stays."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        if isinstance(f.dataType, T.FloatType):
            c = render_double(c.cast("double"))
        elif isinstance(f.dataType, T.DoubleType):
            c = render_double(c)
        cells += [F.coalesce(c.cast("string"), F.lit("")), F.lit("|")]
    return df.select(F.concat(*cells).alias("line"))
