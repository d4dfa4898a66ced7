"""Small files and whole folders, on whatever file system Spark's paths name."""

from __future__ import annotations

import os
import time
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    system, place = _at(spark, folder)
    if not system.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(place))


def delete(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its text; false if somebody else has already done so.

    Readers see no file or the whole text, and of several writers at once exactly one succeeds: the
    text is written beside it and then linked (local disks) or renamed without overwriting.
    """
    system, place = _at(spark, path)
    system.mkdirs(place.getParent())
    if system.getUri().getScheme() == "file":
        target = Path(place.toUri().getPath())
        beside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        beside.write_text(text, encoding="utf-8")
        try:
            os.link(beside, target)
            return True
        except FileExistsError:
            return False
        finally:
            beside.unlink()
    if system.exists(place):
        return False
    _, beside = _at(spark, f"{place.getParent()}/.{place.getName()}.{uuid.uuid4().hex}")
    _write(system, beside, text)
    try:
        _rename(spark, system, beside, place, "NONE")
        return True
    except Py4JJavaError:
        system.delete(beside, False)
        if system.exists(place):
            return False
        raise


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written; None if there is none."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    return time.time() - system.getFileStatus(place).getModificationTime() / 1000


def size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """The number of files in a folder and their bytes."""
    system, place = _at(spark, folder)
    content = system.getContentSummary(place)
    return content.getFileCount(), content.getLength()


def _write(system, place, text: str) -> None:
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _rename(spark: SparkSession, system, source, target, how: str) -> None:
    """Rename a file in one step, ``how`` being OVERWRITE or NONE."""
    rename = getattr(spark._jvm.org.apache.hadoop.fs.Options.Rename, how)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(system.makeQualified(source), system.makeQualified(target), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one, whole."""
    system, place = _at(spark, path)
    if system.getUri().getScheme() == "file":  # Hadoop would move a file of checksums separately
        target = Path(place.toUri().getPath())
        target.parent.mkdir(parents=True, exist_ok=True)
        local = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        local.write_text(text, encoding="utf-8")
        target.with_name(f".{target.name}.crc").unlink(missing_ok=True)
        local.replace(target)
        return
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}")
    _write(system, beside, text)
    _rename(spark, system, beside, place, "OVERWRITE")
