"""CSV files with line breaks within quotes, read by many tasks a file.

Where a range of a file begins, within quotes or not, depends on all quotes before it. A first pass
counts the quotes of every range, running sums over the ranges of a file give how each begins, and
a second pass puts records together range by range. Records that cross from one range into another
are joined from their pieces, of which every range has at most two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = ["file", "start"]
# A piece that ends or goes through a record of an earlier range, one that begins a record.
_HEAD, _TAIL = 1, 2
_PIECES = "text string, number bigint, piece int, first boolean"
#: A record whose quotes stand around whole fields, doubled within them.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\n]*+)'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, file, start): every line of the files and the range it begins in."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, start, number, inside, left): whether a range begins and ends within quotes.

    A row per range, numbered in the order of files and their ranges.
    """
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*_RANGE).agg(F.sum(quotes).alias("quotes"))
    so_far = F.sum("quotes").over(Window.partitionBy("file").orderBy("start"))
    # One row per range meets in one place, as in the broadcast.
    number = F.row_number().over(Window.orderBy(*_RANGE)).cast("long")
    return counted.select(
        *_RANGE,
        number.alias("number"),
        ((so_far - F.col("quotes")) % 2 == 1).alias("inside"),
        (so_far % 2 == 1).alias("left"),
    )


def _placed(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(text, place): the lines of ``ranges``; a place says which range, if inside and if a file's first.

    A broadcast join leaves the lines of a task in their order.
    """
    place = F.col("number") * 4 + F.col("inside").cast("long") * 2 + (F.col("start") == 0).cast("long")
    return lines.join(F.broadcast(ranges.select(*_RANGE, place.alias("place"))), _RANGE).select("text", "place")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array | None, np.ndarray | None]]:
    """(place, lines, whether quotes are open before each and after the last), and without lines at its end."""
    place, odd = None, False
    for batch in batches:
        places = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(places)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            if a == b:
                continue
            here = int(places[a])
            if here != place:
                if place is not None:
                    yield place, None, None
                place, odd = here, bool(here & 2)
            texts = batch.column(0).slice(a, b - a)
            quotes = pc.count_substring(texts, '"').to_numpy(zero_copy_only=False)
            within = np.cumsum(np.concatenate([[int(odd)], quotes])) % 2 == 1
            odd = bool(within[-1])
            yield place, texts, within
    if place is not None:
        yield place, None, None


def _text(lines: pa.Array) -> str:
    return "\n".join(lines.to_pylist())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in the same range, but for the first of a file."""
    opened, lead, first, begun = None, False, False, None
    for place, texts, within in _runs(batches):
        if texts is None:
            opened, begun = None, None
            continue
        if place != begun:  # the end of another range's record comes first
            opened, lead, first, begun = None, bool(place & 2), bool(place & 1), place
        at = 0
        if within[0]:
            closed = np.flatnonzero(~within[1:])
            at = int(closed[0]) + 1 if len(closed) else len(texts)
            if not lead:
                opened.append(_text(texts.slice(0, at)))
            if not len(closed):
                continue
            if not lead and not first:
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(opened)], pa.string())], ["text"])
            if not lead:
                first = False
            opened, lead = None, False
        # Where records begin; behind the last whole one stands what is still open.
        starts = at + np.flatnonzero(~within[at:])
        if len(starts) and starts[-1] < len(texts):
            opened = [_text(texts.slice(int(starts[-1])))]
        skipped = int(first and len(starts) > 1)
        if len(starts) > 1 + skipped:
            lists = pa.ListArray.from_arrays(pa.array(starts[skipped:], pa.int32()), texts)
            yield pa.RecordBatch.from_arrays([pc.binary_join(lists, "\n")], ["text"])
        first = first and not skipped


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range holds of records that begin or end in another one."""
    opened, lead, first, begun = None, False, False, None

    def row(piece: int) -> pa.RecordBatch:
        values = {"text": "\n".join(opened), "number": begun >> 2, "piece": piece, "first": first}
        return pa.RecordBatch.from_pylist([values], schema=kind)

    kind = pa.schema(
        [("text", pa.string()), ("number", pa.int64()), ("piece", pa.int32()), ("first", pa.bool_())]
    )
    for place, texts, within in _runs(batches):
        if texts is None:
            if opened is not None:
                yield row(_HEAD if lead else _TAIL)
            opened, begun = None, None
            continue
        fresh = place != begun
        if fresh:
            opened, lead, first, begun = ([] if place & 2 else None), bool(place & 2), False, place
        if lead:
            closed = np.flatnonzero(~within[1:])
            opened.append(_text(texts.slice(0, int(closed[0]) + 1 if len(closed) else len(texts))))
            if not len(closed):
                continue
            yield row(_HEAD)
            opened, lead = None, False
        if not within[-1]:
            opened = None
            continue
        starts = np.flatnonzero(~within[:-1])
        if len(starts):
            opened, first = [_text(texts.slice(int(starts[-1])))], bool(fresh and place & 1 and not starts[-1])
        else:
            opened.append(_text(texts))


def _joined(pieces: DataFrame) -> DataFrame:
    """(text, first) of the records that cross ranges: a tail and the heads that follow it."""
    order = Window.partitionBy("file").orderBy("number", "piece")
    numbered = pieces.withColumn("record", F.sum((F.col("piece") == _TAIL).cast("int")).over(order))
    in_order = F.sort_array(F.collect_list(F.struct("number", "piece", "text")))
    return numbered.groupBy("file", "record").agg(
        F.array_join(F.transform(in_order, lambda p: p["text"]), "\n").alias("text"),
        F.max("first").alias("first"),
    ).select("text", "first")


def _checked(text: Column) -> Column:
    """The record, which fails where a quote stands inside a field that is not quoted."""
    message = "a quote within a field that is not quoted: read such files whole"
    return F.when(F.contains(text, F.lit('"')) & ~text.rlike(_RECORD), F.raise_error(F.lit(message))).otherwise(text)


def read(
    spark: SparkSession, path: str, schema: T.StructType, options: dict[str, object]
) -> DataFrame:
    """Headed CSV files, quoted fields of which may hold line breaks.

    Quotes have to enclose whole fields and be doubled within them; anything else fails. The table
    of ranges that is broadcast has a row for each one: one per file and
    ``spark.sql.files.maxPartitionBytes`` of it.
    """
    lines = _lines(spark, path)
    ranges = _ranges(lines)
    whole = _placed(lines, ranges).mapInArrow(_whole, "text string")
    crossed = ranges.where("inside OR left")
    pieces = _placed(lines, crossed).mapInArrow(_pieces, _PIECES)
    files = F.broadcast(crossed.select("number", "file"))
    records = whole.unionAll(_joined(pieces.join(files, "number")).where("NOT first").select("text"))
    text = F.col("text")
    text = F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    settings = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    row = F.from_csv(_checked(F.col("text")), ddl, settings)
    return records.select(text.alias("text")).where("text <> ''").select(row.alias("row")).select("row.*")
