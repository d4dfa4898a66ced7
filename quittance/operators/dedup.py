"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(
    df: DataFrame, keys: Sequence[str], cluster_by: Sequence[str] | None = None
) -> DataFrame:
    """The first row per key, ordered by every other column ascending with NULLs last.

    The order is total up to identical rows, so the survivor does not depend on partitioning.
    Filtering on row_number = 1 lets Spark keep one row per key in every input task before the
    shuffle, so a key with a huge number of copies reaches its reducer as one row per task.
    NULL keys count as one key.

    ``cluster_by`` shuffles all rows by fewer columns, some of ``keys``, for the sake of what
    comes next. There is no pruning before that shuffle, so the columns must be known to have
    no hot values.
    """
    if cluster_by:
        df = df.repartition(*cluster_by)
    rest = [c for c in df.columns if c not in keys]
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in rest])
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
