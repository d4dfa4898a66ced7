"""Token files: whole texts as frequency-ranked ids in byte-aligned variable-length coding.

The ids of a corpus are replaced by their rank in order of falling frequency, so the commonest 256
take one byte. Four ranks share a control byte with two bits each, the length of the rank less
one; control bytes stand together, before all data bytes. Both directions are numpy table lookups
over a whole block of documents.

A block is

    magic, documents, ids, data bytes          4 unsigned 32-bit numbers
    doc_id of each document                    signed 64-bit
    present                                    1 byte per document, 0 where the doc_id is missing
    ids of each document                       unsigned 32-bit
    control bytes                              (ids + 3) // 4
    data bytes

little-endian throughout. Blocks are in ascending doc_id order and never split a document. They
are the rows of a Parquet table, because Spark's writer commits a task's file only once and on any
file system; the ranks stand beside them in a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quittance.llm.shared import runs, ship, slices, stored
from quittance.llm.units import column_encoder

MAGIC = 0x31465451
#: A block is closed once it holds this many ids.
BLOCK_IDS = 1 << 18
#: Bytes of text encoded in one go: the more, the fewer units that differ in each.
COLUMN_BYTES = 1 << 23

#: For each control byte, the lengths of its four ranks.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    n = len(values)
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(
        axis=1, dtype=np.uint8
    )
    rows = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), rows[np.arange(4) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind control and data bytes."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    values = padded[starts]
    for k in (1, 2, 3):
        long = np.flatnonzero(sizes > k)
        values[long] |= padded[starts[long] + k] << np.uint32(8 * k)
    return values & _MASKS[sizes]


def write_block(doc_ids: list[int | None], ranks: list[np.ndarray]) -> bytes:
    joined = np.concatenate(ranks) if ranks else np.zeros(0, np.uint32)
    control, data = pack(joined)
    head = np.array([MAGIC, len(doc_ids), len(joined), len(data)], "<u4")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    present = np.array([d is not None for d in doc_ids], np.uint8)
    lengths = np.array([len(r) for r in ranks], "<u4")
    return b"".join(x.tobytes() for x in (head, keys, present, lengths)) + control + data


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, ranks of all documents)."""
    magic, docs, n, size = map(int, np.frombuffer(block, "<u4", 4))
    if magic != MAGIC:
        raise ValueError("not a block of a token file")
    at = 16
    keys = np.frombuffer(block, "<i8", docs, at)
    present = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    middle = at + -(-n // 4)
    if len(block) != middle + size:
        raise ValueError("a block of a token file is cut short")
    doc_ids = [int(k) if p else None for k, p in zip(keys, present, strict=True)]
    return doc_ids, lengths, unpack(block[at:middle], block[middle:], n)


def _blocks(rows: Iterator[pa.RecordBatch], rank_of: np.ndarray, width: str) -> Iterator[tuple]:
    """(first id of the block counted within the partition, ids, block)."""
    doc_ids, ranks, start, held = [], [], 0, 0
    for batch in rows:
        for first, ids in slices(batch, 1):
            for d, raw in zip(batch.column(0).slice(first, len(ids)).to_pylist(), ids, strict=True):
                doc_ids.append(d)
                ranks.append(rank_of[np.frombuffer(raw, width)])
                held += len(ranks[-1])
                if held >= BLOCK_IDS:
                    yield start, held, write_block(doc_ids, ranks)
                    doc_ids, ranks, start, held = [], [], start + held, 0
    if doc_ids:
        yield start, held, write_block(doc_ids, ranks)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int | None = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write ``folder/blocks`` and ``folder/ranks`` for all rows of ``docs``.

    ``end_id`` is appended to every document. A missing or empty text has only that. Rows without
    a doc_id come first; rows that share one stand side by side in the order of a hash of their ids,
    so a doc_id that many rows share is spread over tasks. Other columns are never read. Each text
    is encoded once: the ids are counted and stored, and then dealt out by ranges of doc_id.
    """
    spark = docs.sparkSession
    ship(spark)
    size = _vocabulary_size(tokenizer, end_id)
    width = "<u2" if size <= 1 << 16 else "<u4"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, total = column_encoder(tokenizer).encode_column, np.zeros(size, np.int64)
        names = ["doc", "ids", "counts"]
        for batch in batches:
            for first, rows in runs(batch.column(1), COLUMN_BYTES):
                ids, lengths = to_ids(batch.column(1).slice(first, rows))
                ends = np.cumsum(lengths)
                if end_id is not None:
                    ids = np.insert(ids, ends, end_id)
                    ends += np.arange(1, rows + 1)
                total += np.bincount(ids, minlength=size)
                offsets = np.append(0, ends * np.dtype(width).itemsize)
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(width))]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, buffers)
                keys = batch.column(0).slice(first, rows)
                nothing = pa.nulls(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([keys, raw.cast(pa.binary()), nothing], names)
        # A last row of each task tells how often it has seen each id.
        own = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()])]
        yield pa.RecordBatch.from_arrays(own, names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total += np.frombuffer(counts, np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    keyed = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    coded = stored(keyed.mapInArrow(encoded, "doc bigint, ids binary, counts binary"), "token-ids")
    ids = coded.where(F.col("ids").isNotNull()).select("doc", "ids")
    counts = coded.where(F.col("counts").isNotNull()).select("counts")
    counts = counts.mapInArrow(counted, "id bigint, n bigint")
    frequencies = counts.groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id that occurs, so never more than the vocabulary has.
    ordered = sorted(frequencies.collect(), key=lambda r: (-r["n"], r["id"]))
    id_of = np.array([r["id"] for r in ordered], np.uint32)
    rank_of = np.zeros(size, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    rows = [(rank, r["id"], r["n"]) for rank, r in enumerate(ordered)]
    spark.createDataFrame(rows, "rank int, id bigint, n bigint").coalesce(1).write.parquet(
        f"{folder}/ranks"
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for first, n, block in _blocks(batches, rank_of, width):
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "first": first, "n": n, "block": block}], schema=kind
            )

    kind = pa.schema(
        [("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("block", pa.binary())]
    )
    (
        ids.withColumn("tie", F.xxhash64("ids"))
        .repartitionByRange("doc", "tie")
        .sortWithinPartitions("doc", "tie", "ids")
        .mapInArrow(blocks, "part int, first bigint, n bigint, block binary")
        .write.option("compression", "zstd")
        .parquet(f"{folder}/blocks")
    )


@lru_cache(maxsize=2)
def _vocabulary_size(tokenizer: str, end_id: int | None) -> int:
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True).values())
    return max(largest, end_id or 0) + 1


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document; ``start`` counts the ids of all before it.

    ``ids`` holds unsigned 32-bit numbers, little-endian, as binary.
    """
    ship(spark)
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # at most the vocabulary
    id_of = np.zeros(len(ranks) + 1, "<u4")
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("ids"))
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    placed = blocks.join(F.broadcast(offsets), "part").select(  # one row per file
        (F.col("offset") + F.col("first")).alias("start"), "block"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, block in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, lengths, packed = read_block(block.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = id_of[packed].tobytes()
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start.as_py() + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(cut, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
