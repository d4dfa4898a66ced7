"""What the operators share: shipping code, stored tables, byte batches and running totals."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quittance.session import work_folder

#: Bits that ``monotonically_increasing_id`` gives to the row within its partition.
ROW_BITS = 33


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_quittance_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quittance-ship-")
    archive = os.path.join(folder, "quittance.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(archive)
    context._quittance_shipped = True


def stored(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the cluster's shared folder and read again: the lineage ends there."""
    path = work_folder(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def runs(values: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Cut strings or bytes into runs of about ``most_bytes`` as (first row, rows).

    One longer value makes a run of its own.
    """
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most_bytes:
            yield first, i - first
            first, held = i, 0
        held += int(size)
    if first < len(sizes):
        yield first, len(sizes) - first


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple]:
    """Cut a batch into runs of rows whose values in ``column`` add up to about ``most_bytes``.

    Yields (first row, values as Python objects). One longer value makes a run of its own.
    """
    values = batch.column(column)
    for first, rows in runs(values, most_bytes):
        yield first, values.slice(first, rows).to_pylist()


def numbered(df: DataFrame, *order: str, purpose: str) -> DataFrame:
    """``df`` stored in the given order, with ``position`` counting rows from 0 over the table.

    Rows are dealt out by range, so equal values of the first columns can spread over tasks. Only
    one number per partition meets in one place.
    """
    row = F.monotonically_increasing_id()
    dealt = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", row), purpose
    )
    part = F.shiftright("_at", ROW_BITS)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    local = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        dealt.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of the table above
        .withColumn("position", F.col("_off") + local)
        .drop("_at", "_part", "_off")
    )
