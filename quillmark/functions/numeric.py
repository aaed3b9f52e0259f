"""Numeric expressions that Spark lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column) -> Column:
    """The complementary error function, from the maths library that Spark ships."""
    return F.reflect(F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), x).cast("double")


def even_round(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, half to even, as Python rounds.

    Spark's ``round`` and ``bround`` start from the shortest decimal and differ on some
    values; this takes one Arrow batch at a time.
    """

    @F.pandas_udf("double")
    def rounded(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None or t != t else round(t, digits))

    return rounded(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clipped(x: Column, lo: float, hi: float) -> Column:
    """Within [lo, hi]; null stays null, though ``least`` and ``greatest`` skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
