"""Records of several sources merged by priority, and the best of several candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(c: Column, kind: T.DataType) -> Column:
    """The value where it counts as present: not null, not empty text, not an empty list, not nought."""
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, T.NumericType):
        return F.when(c != 0, c)
    return c


def merge(base: DataFrame, extra: DataFrame, key: str, prefer_new: bool = True, always_new: Sequence[str] = ()) -> DataFrame:
    """``base`` with the values of ``extra`` for equal keys; lists are taken whole, never mixed.

    With ``prefer_new`` a present value of ``extra`` wins, else it fills gaps only; ``always_new`` columns win in
    either case. ``extra`` has one row a key at most (see ``best``). Columns only in ``extra`` are added. Rows of
    ``base`` with a null key stay as they are and are not shuffled to one reducer.
    """
    kinds = {f.name: f.dataType for f in base.schema} | {f.name: f.dataType for f in extra.schema if f.name not in base.columns}
    other = extra.where(F.col(key).isNotNull()).select([F.col(c).alias(f"__x_{c}") for c in extra.columns])
    salted = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    joined = base.withColumn("__key", salted).join(other, F.col("__key") == F.col(f"__x_{key}").cast("string"), "left").drop("__key")
    out = []
    for c, kind in kinds.items():
        if c not in base.columns:
            out.append(F.col(f"__x_{c}").alias(c))
        elif c == key or c not in extra.columns:
            out.append(F.col(c))
        else:
            own, new = filled(F.col(c), kind), filled(F.col(f"__x_{c}"), kind)
            first = (new, own) if prefer_new or c in always_new else (own, new)
            out.append(F.coalesce(*first, F.col(c)).alias(c))
    return joined.select(out)


def best(rows: DataFrame, key: str, weight: Column, order: Column) -> DataFrame:
    """The row of each key with the largest whole-number weight, of equal ones the first by a unique order; null weights count as nought.

    Weight and order make one decimal number, so that a hash aggregate finds the best of each key without moving rows;
    the rows are then joined with it.
    """
    rank = F.coalesce(weight, F.lit(0)).cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") - order.cast("decimal(19,0)")
    w = rows.where(F.col(key).isNotNull()).withColumn("__rank", rank.cast("decimal(38,0)"))
    top = w.groupBy(key).agg(F.max("__rank").alias("__rank"))
    return w.join(top, [key, "__rank"]).select(rows.columns)
