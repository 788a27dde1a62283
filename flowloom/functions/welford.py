"""Running moments as aggregates, with the conventions of the online form: 0 where undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def variance(x: Column) -> Column:
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def deviation(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def checked(values: Column, max_deviations: float, max_value: float, carry: bool = True) -> Column:
    """Moments of an ordered array that rejects a value over both bounds.

    A value is rejected where it passes ``max_deviations`` deviations, as they would
    be with it, and ``max_value``. Variances divide by the count before the value.
    With ``carry`` off the sum of squares starts anew at each value, which is the
    literal form of the online update. Returns (n, avg, var, std_dev).
    """
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("avg"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("var"), F.lit(0.0).alias("std_dev"))

    def step(acc: Column, x: Column) -> Column:
        delta = x - acc["avg"]
        avg = acc["avg"] + delta / (acc["n"] + 1)
        m2 = acc["m2"] + delta * (x - avg)
        std = F.sqrt(m2 / F.greatest(acc["n"], F.lit(1)))
        first = F.struct(F.lit(1).cast("long").alias("n"), x.alias("avg"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("var"), F.lit(0.0).alias("std_dev"))
        taken = F.struct((acc["n"] + 1).alias("n"), avg.alias("avg"), (m2 if carry else F.lit(0.0)).alias("m2"), (m2 / F.greatest(acc["n"], F.lit(1))).alias("var"), std.alias("std_dev"))
        return F.when(acc["n"] == 0, first).when((x > max_deviations * std) & (x > max_value), acc).otherwise(taken)

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), zero, step, lambda a: F.struct(a["n"].alias("n"), a["avg"].alias("avg"), a["var"].alias("var"), a["std_dev"].alias("std_dev")))
