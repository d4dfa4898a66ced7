"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays.

The trees are fitted on the driver to a bounded sample of labelled rows and predict the log-odds
of a good document. Every tree becomes a run of nodes in five arrays (feature, threshold, left,
right, value); scoring walks all trees for all rows of a batch at once, one level per step. On
features where more can only be worse (symbols, capitals, repetition), or only better, the score
is monotonic: splits that go against it are not taken, and each split bounds what may stand below.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.document_stats import COUNTS, FEATURES, statistics
from quittance.llm.shared import ship, slices

#: -1: the score never rises with the feature, 1: it never falls.
MONOTONIC = {
    "symbols_per_word": -1,
    "dup_lines_per_line": -1,
    "repeats_per_word": -1,
    "capitals_per_char": -1,
    "commonest_per_word": -1,
    "closed_lines": 1,
}
#: Counts grow with the length of a text, which is no fault; only shares are judged.
JUDGED = tuple(f for f in FEATURES if f not in COUNTS)


@dataclass(frozen=True)
class Trees:
    """Flat trees: node arrays, where each tree's root stands, the depth and the base score."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """The score of each row of judged features; a leaf points to itself."""
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            low = rows[line, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows), -50, 50)))


class _Fit:
    """One boosting run over binned features."""

    def __init__(self, rows, good, signs, rounds, depth, rate, smooth, least):
        self.signs, self.depth, self.rate, self.smooth, self.least = signs, depth, rate, smooth, least
        self.nodes: list[list] = []
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in rows.T]
        self.bins = np.stack(
            [np.searchsorted(c, x, side="left") for c, x in zip(self.cuts, rows.T, strict=True)], 1
        )
        share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score, self.roots = np.full(len(rows), self.base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            self.slope, self.weight = good - p, p * (1 - p)
            self.step = np.zeros(len(rows))
            self.roots.append(self._grow(np.arange(len(rows)), depth, -np.inf, np.inf))
            score += self.step

    def _value(self, slope, weight, low, high):
        return np.clip(slope / (weight + self.smooth), low, high)

    def _grow(self, members: np.ndarray, depth: int, low: float, high: float) -> int:
        """Add the node for ``members``, and all below; values stay within the bounds."""
        me = len(self.nodes)
        self.nodes.append([0, np.inf, me, me, 0.0])
        slope, weight = self.slope[members].sum(), self.weight[members].sum()
        split = self._split(members, slope, weight, low, high) if depth else None
        if split is None:
            value = float(self._value(slope, weight, low, high)) * self.rate
            self.nodes[me][4] = value
            self.step[members] = value
            return me
        f, cut, left, right = split
        below = self.bins[members, f] <= cut
        middle = (left + right) / 2
        bounds = {-1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}
        a, b = bounds.get(self.signs[f], ((low, high), (low, high)))
        here = self._grow(members[below], depth - 1, *a)
        there = self._grow(members[~below], depth - 1, *b)
        self.nodes[me] = [f, float(self.cuts[f][cut]), here, there, 0.0]
        return me

    def _split(self, members, slope, weight, low, high):
        best, found = 1e-6, None
        whole = slope * slope / (weight + self.smooth)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            bins = self.bins[members, f]
            s = np.cumsum(np.bincount(bins, self.slope[members], len(cuts) + 1))[:-1]
            w = np.cumsum(np.bincount(bins, self.weight[members], len(cuts) + 1))[:-1]
            left, right = self._value(s, w, low, high), self._value(slope - s, weight - w, low, high)
            gain = s * s / (w + self.smooth) + (slope - s) ** 2 / (weight - w + self.smooth) - whole
            allowed = (w >= self.least) & (weight - w >= self.least)
            allowed &= self.signs[f] * (right - left) >= 0
            gain = np.where(allowed, gain, 0)
            cut = int(gain.argmax())
            if gain[cut] > best:
                best, found = gain[cut], (f, cut, left[cut], right[cut])
        return found


def fit(
    rows: np.ndarray,
    good: np.ndarray,
    signs: Mapping[str, int] = MONOTONIC,
    rounds: int = 40,
    depth: int = 3,
    rate: float = 0.3,
    smooth: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Fit trees to rows of judged features and 0/1 labels; without rows every score is 0."""
    if not len(rows):
        rows, good, rounds = np.zeros((1, len(JUDGED))), np.array([0.5]), 0
    order = [signs.get(f, 0) for f in JUDGED]
    run = _Fit(rows, good.astype(float), order, rounds, depth, rate, smooth, least)
    columns = list(zip(*run.nodes, strict=True)) or [[], [], [], [], []]
    kinds = [np.int64, np.float64, np.int64, np.int64, np.float64]
    arrays = [np.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return Trees(*arrays, np.array(run.roots, np.int64), depth, run.base)


def labelled_statistics(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> tuple[np.ndarray, np.ndarray]:
    """Judged features and labels of at most ``most_rows`` labelled documents, one for each id.

    Which ids are taken depends on their hash alone: those with the least hashes, looked for below a
    threshold that twice as many pass, so few rows are sorted however many labels there are. Of
    labels that share an id the least counts, of its documents the one with the least statistics.
    Labels without an id, without a value or without a document are left out.
    """
    ship(docs.sparkSession)
    known = (
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    count, place = known.count(), F.xxhash64("id")
    if count > 2 * most_rows:
        known = known.where(place < F.lit(int((2 * most_rows / count - 0.5) * 2.0**64)))
    chosen = known.orderBy(place, "id").limit(most_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # At most ``most_rows`` pairs of numbers are broadcast.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for _, texts in slices(batch, 1) for t in texts]
            stats = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), stats], ["id", "label", "stats"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    measures = rows.mapInArrow(measured, f"id {kind}, label double, stats array<double>")
    one = measures.groupBy("id").agg(F.min(F.struct("label", "stats")).alias("row"))
    table = one.select("row.label", "row.stats").toArrow()
    judged = [FEATURES.index(f) for f in JUDGED]
    stats = np.array(table["stats"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*stats.T, table["label"].to_numpy()))  # the same trees however rows arrive
    return stats[order][:, judged], table["label"].to_numpy()[order]


def judge(stats: np.ndarray, trees: Trees, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept) of rows of ``FEATURES``."""
    n_words, repeats = stats[:, 0], stats[:, COUNTS.index("n_repeat_words")]
    failed = (n_words < 10) | (100 * repeats > 20 * n_words)
    score = trees.probability(stats[:, [FEATURES.index(f) for f in JUDGED]])
    return failed, score, ~failed & (score >= least)


def quality_rules(
    docs: DataFrame,
    trees: Trees,
    least: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, the counts, base_failed, score, kept) per row of ``docs``.

    The base rules fail a text with fewer than 10 words or with more than a fifth of its words in
    repeated runs; the trees judge the rest, a probability of ``least`` being enough. A missing or
    empty text has no words and fails. Repeated rows are judged alike; no row is dropped, and
    other columns are never read.
    """
    ship(docs.sparkSession)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for _, texts in slices(batch, 1) for t in texts]
            stats = np.array(found, float).reshape(-1, len(FEATURES))
            failed, score, kept = judge(stats, trees, least)
            counts = [pa.array(stats[:, k].astype(np.int64)) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed), pa.array(score), pa.array(kept)],
                [id_column, *COUNTS, "base_failed", "score", "kept"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(id_column, text_column).mapInArrow(
        judged, f"`{id_column}` {kind}, {counts}, base_failed boolean, score double, kept boolean"
    )


def keep_good(
    docs: DataFrame, trees: Trees, least: float = 0.5, text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    ship(docs.sparkSession)
    at, columns = docs.columns.index(text_column), docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for _, texts in slices(batch, at) for t in texts]
            stats = np.array(found, float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(judge(stats, trees, least)[2]))

    return docs.select(columns).mapInArrow(kept, docs.schema)
