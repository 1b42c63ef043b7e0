"""Values as Python's ``str()`` prints them (F22, F24), in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCIENTIFIC = r"^(-?)(\d)\.(\d+)E(-?\d+)$"


def _exponent_text(s: Column) -> Column:
    """``d.dddE±n`` as Python prints that float."""
    sign, head, tail = (F.regexp_extract(s, _SCIENTIFIC, i) for i in (1, 2, 3))
    e = F.regexp_extract(s, _SCIENTIFIC, 4).cast("int")
    tail = F.when(tail == "0", F.lit("")).otherwise(tail)
    digits = F.concat(head, tail)
    padded = F.rpad(digits, F.greatest(e + 1, F.length(digits)), F.lit("0"))
    after = F.substring(padded, e + 2, F.length(padded))
    size = F.abs(e).cast("string")
    return (F.when((e >= 16) | (e < -4), F.concat(
                sign, head, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)), F.lit("e"),
                F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size)))
            .when(e >= 0, F.concat(sign, F.substring(padded, F.lit(1), e + 1), F.lit("."),
                                   F.when(after == "", F.lit("0")).otherwise(after)))
            .otherwise(F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)))


def float_text(x: Column) -> Column:
    """A double as Python prints a float. Both sides print the shortest digits;
    Spark turns to an exponent from 1e7 on and below 1e-3, Python from 1e16 on
    and below 1e-4, with a sign and two digits. The few that need more than a
    cast go through a lambda, which keeps the generated code small."""
    s = x.cast("double").cast("string")
    return (F.when(s.contains("E"), F.get(F.transform(F.array(s), _exponent_text), F.lit(0)))
            .otherwise(F.replace(F.replace(s, F.lit("Infinity"), F.lit("inf")), F.lit("NaN"), F.lit("nan"))))


def json_text(v: Column) -> Column:
    """A JSON value (variant) as Python prints what it parses to: text as is,
    True, False and None, whole numbers of any size, floats. Arrays and objects keep
    their JSON text."""
    kind = F.schema_of_variant(v)
    # a number with a point and nothing behind it is a decimal of scale 0 as well, but a long would have held up to 18 digits
    whole = kind.rlike(r"^(BIGINT|DECIMAL\((19|[23]\d), *0\))$")
    return (F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
            .when(whole, F.try_variant_get(v, "$", "decimal(38,0)").cast("string"))
            .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), float_text(F.try_variant_get(v, "$", "double")))
            .when(kind == "VOID", F.lit("None")).otherwise(F.to_json(v)))
