"""Steering the optimizer where its rewrites would repeat costly work."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinned(c: Column) -> Column:
    """The same value, computed once at this step.

    The partition id is never negative but counts as nondeterministic, so filters (also those inferred from an
    explode) stay above the step instead of being pushed below it with a copy of the expression inside.
    """
    return F.when(F.spark_partition_id() >= 0, c)
