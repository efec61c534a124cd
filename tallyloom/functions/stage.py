"""Columns that are computed once.

The optimizer folds a computed column into the expressions that use it. Inside an array function that
would compute it again for every element, so such columns go through a one-element generator, which
the optimizer does not fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``withColumn`` whose value is computed once per row."""
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(column)).alias(name))
