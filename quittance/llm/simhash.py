"""SimHash near-duplicates by covering locality-sensitive hashing.

Two fingerprints that differ in at most ``radius`` bits must share a bucket in some table. Each of
the 64 bit positions gets a vector of radius + 1 bits, none of them zero. For every non-zero
vector v there is a table, whose mask holds the positions whose vector has an odd product with v;
a bucket is the fingerprint under that mask. The vectors of ``radius`` differing positions span
less than the whole space, so some v is orthogonal to all of them: in that table no differing
position is looked at and the two fingerprints collide. No pair is left to chance.

Fingerprints are made distinct first, so copies are one row. A bucket too large for one task is
cut into blocks and each pair of blocks is a task of its own; every task holds a bounded number of
fingerprints and returns a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quittance.llm.components import components, files_for
from quittance.llm.shared import fresh, ship, slices, stored

#: A bucket with more fingerprints is compared block by block.
BLOCK = 2048
_ROWS = 1 << 16


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """The majority bits of the hashes of all shingles, as a signed 64-bit number."""
    split = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(split) - words + 1)
    ends = ends[-n:]
    hashed = partial(xxh64_intdigest, seed=seed)
    pieces = (joined[s:e] for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True))
    hashes = np.fromiter(map(hashed, pieces), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        rows = hashes[at : at + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    docs: DataFrame,
    words: int = 4,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, text_hash, fp) per row; ``text_hash`` tells apart rows that share an id.

    Words are runs of anything but ASCII white space, ASCII letters in lower case. A text with
    fewer words than a shingle is one shingle; without words the fingerprint is 0.
    """
    ship(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words, seed) for _, texts in slices(batch, 2) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                [id_column, "text_hash", "fp"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    text = F.col(text_column)
    return docs.select(id_column, F.xxhash64(text).alias("text_hash"), text).mapInArrow(
        made, f"`{id_column}` {kind}, text_hash bigint, fp bigint"
    )


def covering_masks(radius: int) -> list[int]:
    """The masks of all tables, as signed 64-bit numbers."""
    vectors = (1 << radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(64) if (i % vectors + 1 & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join whatever of ``members`` is joined by steps of at most ``radius`` bits."""
    found, rest = [], members
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            p = frontier.pop()
            near = np.bitwise_count(rest ^ p) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                found += [(int(p), int(q)) for q in reached]
                frontier += list(reached)
    return found


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows in chunks that never cut a bucket: (where buckets start, and the end; fps)."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:4]:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(starts) > 1:
            yield starts, columns[4][: starts[-1]]
        held = [c[starts[-1] :] for c in columns]
    if held is not None:
        yield np.array([0, len(held[0])]), held[4]


def links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, enough of them to join every component.

    Two fingerprints within ``radius`` bits are always joined by links of that kind.
    """
    ship(fps.sparkSession)
    tables = F.array(
        *[
            F.struct(F.lit(k).cast("short").alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket"))
            for k, m in enumerate(covering_masks(radius))
        ]
    )
    dealt = fps.select(F.inline(tables), "fp")
    large = (
        dealt.groupBy("tab", "bucket")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > block)
        .select("tab", "bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    )
    large = stored(large, "large-buckets")
    of = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    placed = (
        dealt.join(large, ["tab", "bucket"], "left")
        .withColumn("own", F.coalesce(of, F.lit(0)))
        .select("tab", "bucket", "own", other.alias("other"), "fp")
        .select("tab", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, members in _buckets(batches):
            starts, ends = starts[:-1], starts[1:]
            sizes = ends - starts
            pairs = starts[sizes == 2]
            a, b = members[pairs], members[pairs + 1]
            near = np.bitwise_count(a ^ b) <= radius
            found = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                found += _forest(members[s:e], radius)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
                )

    keys = ["tab", "bucket", "i", "j"]
    return (
        placed.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(linked, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    radius: int = 4,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, text_hash, fp, component_id, chosen) per row of ``docs``.

    ``component_id`` is the smallest id among all rows that links of at most ``radius`` bits lead
    to, the row itself included. ``chosen`` marks one text of each component, that of the smallest
    id (rows that repeat it in full are all marked). Missing, empty and wordless texts have
    fingerprint 0 and are linked like any other. A missing id is larger than any other: it never
    names a component with another row. Other columns are never read.
    """
    rows = stored(fingerprints(docs, words, seed, id_column, text_column), "fingerprints")
    first = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "text_hash"))
    most = rows.count()  # from the footers of the stored files
    distinct = rows.groupBy("fp").agg(first.alias("first")).coalesce(files_for(most))
    distinct = stored(distinct, "distinct-fingerprints")
    # A bucket's forest has fewer links than the bucket has fingerprints.
    found = links(distinct.select("fp"), radius)
    joined = components(found, most=most * len(covering_masks(radius))).withColumnRenamed("node", "fp")
    member = distinct.join(joined, "fp", "left")
    linked = member.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    least = (
        member.join(linked, "root", "left")
        .select("fp", F.coalesce("least", "first").alias("least"))
    )
    same = F.col(id_column).eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return rows.join(least, "fp").select(
        id_column, "text_hash", "fp", F.col("least.id").alias("component_id"), same.alias("chosen")
    )


def keep_one(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``found``, in the columns of ``docs``."""
    chosen = found.where("chosen").select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    text_hash = F.xxhash64(F.col(f"d.{text_column}"))
    kept = docs.alias("d").join(
        chosen.alias("c"), F.col(f"d.{id_column}").eqNullSafe(F.col("c._id")) & (text_hash == F.col("c._hash")), "left_semi"
    )
    again = Window.partitionBy(id_column, F.xxhash64(text_column)).orderBy(F.lit(0))
    nth = fresh(docs, "nth")
    return kept.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).select(docs.columns)
