"""Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Keeps expression trees linear when an intermediate is used several times
    (inlining would otherwise copy it into every use), and works inside other
    higher-order functions, where staged projections cannot be used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row, however many filters
    and projections use it: a one-element explode, through which the optimizer
    pushes no filter on the new column and copies no expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def nstruct(**fields: Column) -> Column:
    """Struct with explicit field names (aliases inside lambdas may be trimmed)."""
    args = []
    for name, value in fields.items():
        args += [F.lit(name), value]
    return F.named_struct(*args)
