"""Raw billing extracts: typed CSV in, full-refresh Parquet tables out.

A table or a set of tables is replaced by writing the new one beside the old and then changing a
small file that names it. A load that fails leaves what was there, and a reader that has begun
keeps its files until they are pruned.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.schemas import RAW_DDL, raw_schema
from quittance.sources import files, split_csv

_CSV = {"header": True, "quote": '"', "escape": '"'}
_CURRENT = "current"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool | str = False
) -> DataFrame:
    """Read a headed CSV with a declared schema; a row that does not fit fails the job.

    Columns go by position. Files stay splittable, so a quoted line break is such a misfit.
    ``line_breaks`` accepts them, still with many tasks a file, where quotes enclose whole fields.
    As ``"whole"`` it accepts other quotes too; one task then reads a whole file.
    """
    options = {**_CSV, "mode": "FAILFAST", "multiLine": bool(line_breaks)}
    if line_breaks and line_breaks != "whole":
        return split_csv.read(spark, path, schema, options)
    return spark.read.schema(schema).options(**options).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a headed CSV that reads back unchanged but for blanks, which come back NULL."""
    df.write.mode("overwrite").options(
        **_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def store_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table into a folder that does not exist yet and return it as stored."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_clustered(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``store_table`` with the rows dealt over ``buckets`` by a hash of ``key``.

    What is grouped by the key, or joined on it with a table of as many buckets, needs no shuffle.
    A bucket is read by one task, so no value of the key may hold a large part of the rows.
    """
    spark, entry = df.sparkSession, f"quittance_{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(entry)
        return spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")


def read_clustered(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that ``store_clustered`` has written, with its layout.

    Spark takes a layout from its catalogue only. The entry is gone when this returns: the table is
    resolved by then, its files belong to the folder, and no other session sees the entry's name.
    """
    entry, place = f"quittance_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema
    )
    try:
        spark.sql(
            f"CREATE TABLE {entry} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        return spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")


def _version() -> str:
    """A name for a new version; later ones sort behind earlier ones of the same clock."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def refresh_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` and return it as stored; it may be computed from the old one."""
    spark, version = df.sparkSession, _version()
    stored = store_table(df, f"{path}/{version}")
    files.replace_text(spark, f"{path}/{_CURRENT}", version)
    return stored


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the present version of what is at ``path``."""
    version = files.read_text(spark, f"{path}/{_CURRENT}")
    if version is None:
        raise LookupError(f"nothing has been loaded into {path}")
    return f"{path}/{version}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def load_raw(
    spark: SparkSession,
    csv_folder: str,
    raw_folder: str,
    wide_ids: bool = False,
    line_breaks: bool | str = False,
) -> dict[str, DataFrame]:
    """Load ``<csv_folder>/<table>.csv`` for all raw tables, all or none."""
    version = _version()
    try:
        raw = {
            table: store_table(
                read_csv(
                    spark, f"{csv_folder}/{table}.csv", raw_schema(table, wide_ids), line_breaks
                ),
                f"{raw_folder}/{version}/{table}",
            )
            for table in RAW_DDL
        }
    except Exception:
        files.delete(spark, f"{raw_folder}/{version}")
        raise
    files.replace_text(spark, f"{raw_folder}/{_CURRENT}", version)
    return raw


def read_raw(spark: SparkSession, raw_folder: str) -> dict[str, DataFrame]:
    folder = current(spark, raw_folder)
    return {table: spark.read.parquet(f"{folder}/{table}") for table in RAW_DDL}


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions at ``path``; the present one always stays."""
    present = current(spark, path).rsplit("/", 1)[1]
    versions = [n for n in files.names_in(spark, path) if n[:1].isdigit()]
    for name in versions[: max(0, len(versions) - keep)]:
        if name != present:
            files.delete(spark, f"{path}/{name}")


def load_manifest(raw: dict[str, DataFrame]) -> DataFrame:
    """One row per loaded table with its row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(table).alias("table_name"), "row_count"
        )
        for table, df in raw.items()
    ]
    return reduce(DataFrame.unionAll, counts)
