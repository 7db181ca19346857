"""What column expressions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it (inside lambdas Spark repeats what is repeated)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def known(value: Column) -> Column:
    """A row for each value that isn't null. Unlike a filter on it, which Spark moves below and computes again, it computes value once a row."""
    return F.explode(F.array_compact(F.array(value)))
