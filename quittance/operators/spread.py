"""Left joins that stay balanced when a few join keys hold most of the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.session import shuffle_width


@dataclass(frozen=True)
class HotKeys:
    """Keys that would overload a shuffle partition, each with the number of parts to cut it in.

    There are at most ``width / 2`` of them, since each holds more than ``2 / width`` of the
    rows, and their parts add up to at most ``1.5 * width``.
    """

    parts: tuple[tuple[object, int], ...] = ()
    null_parts: int = 0
    rows: int = field(default=0, compare=False)  # of the table they were looked for in

    def __bool__(self) -> bool:
        return bool(self.parts) or self.null_parts > 1


#: Groups of tasks whose summaries are merged side by side before they meet.
_MERGES = 64
#: Spark's summaries follow no more keys.
_MOST_TRACKED = 1_000_000


def _tracked(width: int) -> int:
    """How many keys a summary follows so that none with ``2 / width`` of the rows is lost.

    A summary of n keys errs by at most 3.5 / n of the rows and reports what is surely above that.
    """
    return max(64, 1 << math.ceil(math.log2(3.5 * width)))


def candidates(df: DataFrame, key: str, width: int) -> tuple[int, int, list]:
    """Rows, rows without a key, and keys among which are all with more than ``2 / width`` of them.

    Every task sums its keys up in a summary of bounded size (counters that give way to each other);
    only summaries move, and they are merged in groups of tasks first.
    """
    n = _tracked(width)
    summary = F.expr(f"approx_top_k_accumulate(`{key}`, {n})")
    parts = df.groupBy((F.spark_partition_id() % _MERGES).alias("part")).agg(
        summary.alias("summary"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(key).isNull()).alias("missing"),
    )
    merged = parts.groupBy(F.lit(0).alias("all")).agg(  # no row of no rows
        F.expr(f"approx_top_k_combine(summary, {n})").alias("summary"),
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
    )
    top = F.expr(f"approx_top_k_estimate(summary, {n})").alias("top")
    found = merged.select("rows", "missing", top).first()
    if found is None:
        return 0, 0, []
    total = found["rows"]
    # An estimate is never below the true count.
    keys = [r["item"] for r in found["top"] if r["item"] is not None and r["count"] * width > 2 * total]
    return total, found["missing"], keys


def find_hot_keys(df: DataFrame, key: str, width: int | None = None) -> HotKeys:
    """The values of ``key`` with more than ``2 / width`` of the rows, and how to cut them up.

    Summaries name the candidates, fewer than ``width``; only if there are any, their rows are
    counted exactly, on every task first. The keys only steer how rows are spread; none of them
    changes a result.
    """
    width = width or shuffle_width(df.sparkSession)
    if _tracked(width) > _MOST_TRACKED:  # every key is counted, and again only the hot ones leave
        total, missing = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
        asked = df.where(F.col(key).isNotNull())
    else:
        total, missing, keys = candidates(df, key, width)
        asked = df.where(F.col(key).isin(keys)) if keys else None
    hot = []
    if asked is not None:
        counted = asked.groupBy(F.col(key).alias("item")).agg(F.count(F.lit(1)).alias("rows"))
        rows = counted.where(F.col("rows") * width > 2 * total).orderBy("item").collect()
        hot = [(r["item"], math.ceil(r["rows"] * width / total)) for r in rows]
    null_parts = math.ceil(missing * width / total) if missing * width > 2 * total else 0
    return HotKeys(parts=tuple(hot), null_parts=null_parts, rows=total)


def left_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: HotKeys = HotKeys()
) -> DataFrame:
    """``left`` left-joined to ``right`` on ``key``.

    Without hot keys this is the plain join. With them, the left rows of a hot key are dealt
    over its parts by a hash of ``spread_by``, the matching right rows are repeated once per
    part, and the join is on key and part. NULL keys match nothing and are only dealt out.
    """
    if not hot:
        return left.join(right, key, "left")
    key_type = left.schema[key].dataType
    spark = left.sparkSession
    # HotKeys bounds this table by the shuffle width, so the broadcast cannot grow with the data.
    parts = F.broadcast(
        spark.createDataFrame(
            [(k, n) for k, n in hot.parts], f"`{key}` {key_type.simpleString()}, _parts int"
        )
    )
    dealt = F.xxhash64(F.col(spread_by))
    left = left.join(parts, key, "left").withColumn(
        "_part",
        F.when(F.col(key).isNull(), F.pmod(dealt, F.lit(max(hot.null_parts, 1))))
        .otherwise(F.pmod(dealt, F.coalesce(F.col("_parts"), F.lit(1))))
        .cast("int"),
    )
    right = right.join(parts, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"], "left").drop("_part")
