"""One formula, two evaluations: Spark columns for the data, numpy for a handful of driver-side points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ColumnMath:
    """Formulas as expressions that Catalyst compiles; undefined values are NULL."""

    sin, cos, tan, asin, acos, atan2 = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan2
    sqrt, exp, log, floor, abs = F.sqrt, F.exp, F.log, F.floor, F.abs

    @staticmethod
    def lit(x):
        return F.lit(float(x))

    @staticmethod
    def where(cond: Column, a, b) -> Column:
        return F.when(cond, a).otherwise(b)

    @staticmethod
    def valid(cond: Column, a) -> Column:
        return F.when(cond, a)

    @staticmethod
    def clip(x: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), x))

    @staticmethod
    def mod(x: Column, n: float) -> Column:
        return F.pmod(x, F.lit(float(n)))

    @staticmethod
    def iterate(start: Column, step, times: int) -> Column:
        """``step`` applied again and again without nesting the expression."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start.cast("double"), lambda acc, _: step(acc))

    @staticmethod
    def div(a: Column, b: Column) -> Column:
        return F.try_divide(a, b)


class ArrayMath:
    """The same formulas on numpy arrays; undefined values are NaN."""

    sin, cos, tan = staticmethod(np.sin), staticmethod(np.cos), staticmethod(np.tan)
    asin, acos, atan2 = staticmethod(np.arcsin), staticmethod(np.arccos), staticmethod(np.arctan2)
    sqrt, exp, log, floor, abs = staticmethod(np.sqrt), staticmethod(np.exp), staticmethod(np.log), staticmethod(np.floor), staticmethod(np.abs)

    @staticmethod
    def lit(x):
        return np.float64(x)

    @staticmethod
    def where(cond, a, b):
        return np.where(cond, a, b)

    @staticmethod
    def valid(cond, a):
        return np.where(cond, a, np.nan)

    @staticmethod
    def clip(x, low, high):
        return np.clip(x, low, high)

    @staticmethod
    def mod(x, n):
        return np.mod(x, n)

    @staticmethod
    def iterate(start, step, times: int):
        for _ in range(times):
            start = step(start)
        return start

    @staticmethod
    def div(a, b):
        with np.errstate(all="ignore"):
            return np.divide(a, b)


def bind(df, columns: dict):
    """Add columns that later steps can use many times at the cost of one.

    The values pass through a generator of one row, across which the optimiser neither copies expressions nor pushes
    filters; it is part of the generated code like a projection.
    """
    if not columns:
        return df
    keep = [F.col(f"`{k}`") for k in df.columns if k not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def math_of(*values):
    return ColumnMath if any(isinstance(v, Column) for v in values) else ArrayMath
