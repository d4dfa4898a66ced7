"""Benchmark decontamination by spaced seeds.

A document holds benchmark text where ``WINDOW`` of its words in a row, laid against as many of an
item, agree in all but ``MISSES`` places. An item with fewer words must be there as a whole, all but
two of 9 words or more, all but one of 5 or more, every one of fewer. To find such places without
comparing everything, both sides are hashed under fixed masks that look at some positions of a
window and ignore the rest. The masks are chosen so that at least one of them fits any such window
whatever the places that differ. Hashes of documents and items are joined, and around every hit the
words themselves are compared.

Documents first look their hashes up in a Bloom filter of the item hashes, of a fixed size however
large the benchmark is: it only saves rows from the join, which decides.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quittance.llm.shared import ship, slices, stored

#: Words of a window, and how many of them may differ.
WINDOW, MISSES = 13, 3
#: Fixed masks: 1 is looked at, 0 ignored. Every window with at most ``MISSES`` differences has a
#: place where one of them fits (``tests/llm`` tries all).
MASKS = ("111111", "11101011", "11101101", "1100100111", "1011000111", "111000101001")
#: Places that may differ in an item too short for a window, from so many words on.
SHORT_MISSES = ((9, 2), (5, 1), (0, 0))
#: Words kept on either side of a hit, hits closer together making one region.
MARGIN = 32
#: The Bloom filter has 2 ** BITS bits and PROBES of them per hash.
BITS, PROBES = 26, 3

_BREAK = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u3020\uff00-\uff0f\uff1a-\uff20]")
_CHARACTER_WORDS = re.compile("([\u3040-\u30ff\u3400-\u9fff])")
#: First bytes of all characters of the two patterns above.
_LEADS = re.compile(rb"[\xc2\xe2-\xe9\xef]")
_GOLDEN = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; in scripts without spaces, single characters."""
    text = (text or "").lower()
    data = text.encode()
    if _LEADS.search(data):
        data = _CHARACTER_WORDS.sub(r" \1 ", _MARKS.sub(" ", text)).encode()
    return data.translate(_BREAK).split()


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for every place where the mask fits, of the words it looks at."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(mask, 2), np.uint64)
    for k, look in enumerate(mask):
        if look == "1":
            total += hashes[k : k + n] * np.uint64((2 * k + 1) * _GOLDEN & _FULL)
    total ^= total >> np.uint64(31)
    total *= np.uint64(_GOLDEN)
    return total ^ (total >> np.uint64(29))


def misses_in(size: int) -> int:
    """How many words of an item, or of a window of it, may differ."""
    if size >= WINDOW:
        return MISSES
    return next(misses for least, misses in SHORT_MISSES if size >= least)


def short_masks(size: int) -> list[str]:
    """Masks over all of a short item, one of which fits wherever ``misses_in(size)`` words differ.

    The item is cut into two blocks more than words may differ, so two blocks are always whole; each
    mask looks at two of them.
    """
    misses = misses_in(size)
    if not misses:
        return ["1" * size]
    block = [k * (misses + 2) // size for k in range(size)]
    return [
        "".join("1" if b in pair else "0" for b in block)
        for pair in itertools.combinations(range(misses + 2), 2)
    ]


def masks_for(lengths: set[int]) -> list[str]:
    """The fixed masks, and those for each length of items shorter than a window."""
    return [*MASKS, *(m for n in sorted(lengths) if 0 < n < WINDOW for m in short_masks(n))]


def agreement(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """(first, words, equal words) of the benchmark text in two aligned runs; none if there is none."""
    equal = window == item
    if len(equal) < WINDOW:
        places = np.flatnonzero(equal)
        if not len(places) or len(equal) - len(places) > misses_in(len(equal)):
            return None
        return int(places[0]), int(places[-1] - places[0]) + 1, len(places)
    upto = np.concatenate([[0], np.cumsum(equal)])
    enough = np.flatnonzero(upto[WINDOW:] - upto[:-WINDOW] >= WINDOW - MISSES)
    if not len(enough):
        return None
    covered = np.zeros(len(equal), bool)
    for s in enough:
        covered[s : s + WINDOW] = True
    places = np.flatnonzero(covered & equal)
    first, last = int(places[0]), int(places[-1])
    return first, last - first + 1, int((covered & equal).sum())


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_key, item_id, words): each different item once, its words as hashes."""
    kind = benchmark.schema[id_column].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [word_hashes(t).view(np.int64) for _, texts in slices(batch, 2) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))],
                ["item_key", "item_id", "words"],
            )

    keyed = benchmark.select(
        F.xxhash64(id_column, text_column).alias("item_key"),
        F.col(id_column).alias("item_id"),
        F.col(text_column).alias("text"),
    )
    items = keyed.mapInArrow(hashed, f"item_key bigint, item_id {kind}, words array<bigint>")
    return items.where(F.size("words") > 0).dropDuplicates(["item_key"])


def _seeds(items: DataFrame) -> DataFrame:
    """(hash, item_key, size, at): every seed of every item."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, found in zip(batch.column(0), batch.column(1), strict=True):
                hashes = np.array(found.as_py(), np.int64).view(np.uint64)
                n = len(hashes)
                for mask in MASKS if n >= WINDOW else short_masks(n):
                    seeds = seed_hashes(hashes, mask).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(seeds),
                            pa.array(np.full(len(seeds), key.as_py(), np.int64)),
                            pa.array(np.full(len(seeds), n, np.int32)),
                            pa.array(np.arange(len(seeds), dtype=np.int32)),
                        ],
                        ["hash", "item_key", "size", "at"],
                    )

    return items.select("item_key", "words").mapInArrow(
        made, "hash bigint, item_key bigint, size int, at int"
    )


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter's bits in words of 64: never more than 2 ** (BITS - 6) rows reach the driver."""
    shifts = [k * (64 - BITS) // (PROBES - 1) for k in range(PROBES)]
    bits = F.explode(
        F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit((1 << BITS) - 1)) for s in shifts])
    )
    one = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    rows = (
        seeds.select(bits.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << BITS - 6, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def _in_bloom(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the filter."""
    found = np.arange(len(hashes))
    for k in range(PROBES):
        shift = np.uint64(k * (64 - BITS) // (PROBES - 1))
        bit = (hashes[found] >> shift) & np.uint64((1 << BITS) - 1)
        set_ = (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
        found = found[set_.astype(bool)]
    return found


def regions_of(hashes: np.ndarray, masks: list[str], table: np.ndarray) -> Iterator[tuple]:
    """(first word, words, places of hits, hashes of hits) of every region with hits."""
    places, values, ends = [], [], []
    for mask in masks:
        seeds = seed_hashes(hashes, mask)
        found = _in_bloom(seeds, table)
        places.append(found)
        values.append(seeds[found])
        ends.append(found + len(mask))
    at, end = np.concatenate(places), np.concatenate(ends)
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, end, value = at[order], end[order], np.concatenate(values)[order]
    cuts = np.flatnonzero(at[1:] - at[:-1] > 2 * MARGIN) + 1
    for s, e in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
        low, high = max(0, int(at[s]) - MARGIN), min(len(hashes), int(end[s:e].max()) + MARGIN)
        yield low, hashes[low:high], at[s:e], value[s:e]


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(id, text_hash, item_id, doc_start, item_start, n_words, n_equal): every aligned overlap.

    Starts count words from 0. One row per document text, item and alignment; a document's rows
    that repeat in full are told once. Missing and empty texts hold nothing, items without words are
    nowhere, missing ids stay missing. An empty benchmark or no documents give no rows. Other columns
    are never read.
    """
    spark = docs.sparkSession
    ship(spark)
    items = stored(_items(benchmark, item_column, item_text_column), "benchmark-items")
    short = items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct()
    masks = masks_for({r["n"] for r in short.collect()})  # fewer than WINDOW numbers
    seeds = stored(_seeds(items), "benchmark-seeds")
    table = spark.sparkContext.broadcast(_bloom(seeds))  # 8 MiB, whatever the benchmark
    kind = docs.schema[id_column].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            rows = [
                (doc, text_hash, low, found.view(np.int64), at, value.view(np.int64))
                for first, texts in slices(batch, 2)
                for doc, text_hash, text in zip(
                    batch.column(0).slice(first, len(texts)).to_pylist(),
                    batch.column(1).slice(first, len(texts)).to_pylist(),
                    texts,
                    strict=True,
                )
                for low, found, at, value in regions_of(word_hashes(text), masks, bits)
            ]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], batch.schema.field(0).type),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.list_(pa.int64())),
                        pa.array(columns[4], pa.list_(pa.int64())),
                        pa.array(columns[5], pa.list_(pa.int64())),
                    ],
                    ["doc", "text_hash", "low", "words", "at", "hash"],
                )

    text = F.col(text_column)
    regions = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(
        scanned,
        f"doc {kind}, text_hash bigint, low bigint, words array<bigint>, at array<bigint>, hash array<bigint>",
    )
    regions = stored(regions.withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.inline(F.arrays_zip(F.col("at").alias("doc_at"), F.col("hash"))))
    aligned = (
        hits.join(seeds, "hash")
        .select("region", "item_key", "size", (F.col("doc_at") - F.col("at")).alias("start"))
        .distinct()
    )
    # The words of the region that lie against the item: from word ``skip`` of the item on.
    skip = F.greatest(F.lit(0), F.col("low") - F.col("start"))
    window = F.slice("words", F.col("start") + F.col("skip") - F.col("low") + 1, F.col("size") - F.col("skip"))
    laid = (
        aligned.join(regions.select("region", "doc", "text_hash", "low", "words"), "region")
        .withColumn("skip", skip)
        .select("doc", "text_hash", "item_key", "start", "skip", window.alias("window"))
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                theirs = np.array(r["words"][r["skip"] : r["skip"] + len(r["window"])])
                if len(theirs) < min(WINDOW, len(r["words"])):
                    continue  # the document begins or ends within the item
                if seen := agreement(np.array(r["window"]), theirs):
                    first, n, equal = seen
                    place = r["skip"] + first
                    found.append((r["doc"], r["text_hash"], r["item_id"], r["start"] + place, place, n, equal))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names
            )

    item_type = benchmark.schema[item_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, text_hash bigint, item_id {item_type}, doc_start bigint, "
        "item_start bigint, n_words bigint, n_equal bigint"
    )
    names = [id_column, "text_hash", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
    types = pa.schema(_arrow(spark, schema)).types
    return laid.join(items, "item_key").drop("item_key").mapInArrow(verified, schema).distinct()


def _arrow(spark, ddl: str) -> list:
    """Arrow fields of a row type given as DDL."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl).fields]


def keep_clean(
    docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that have no row in ``found``, in the columns of ``docs``."""
    bad = stored(
        found.select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).distinct(),
        "contaminated",
    )
    same = F.col(f"d.{id_column}").eqNullSafe(F.col("b._id")) & (
        F.xxhash64(F.col(f"d.{text_column}")) == F.col("b._hash")
    )
    return docs.alias("d").join(bad.alias("b"), same, "left_anti").select(docs.columns)
