"""Cross-tokenizer alignment: which tokens of one tokenizer cover which of another, by intervals.

Tokenizer A is byte-level BPE of the tokenizers library and sees a space and the text; tokenizer B
is a sentencepiece model, which puts that space there itself. Both cut the same bytes, so each token
is an interval of them. Documents are laid end to end, all A and B tokens are sorted by their starts
(``lexsort``) and the furthest end so far is carried along (``maximum.accumulate``); a new group
begins where a start reaches it. Within groups every A token is expanded to the B tokens that it
overlaps. Overlapping tokens that end at the same byte are linked.

How often a pair of ids is linked in the corpus decides how good a link is. Of two tokens that
end together the shorter is a tail of the longer, so the vocabularies bound the number of different
pairs, whatever the corpus: at most the bytes of both vocabularies (``most_pairs``; half a million
for the public files). Each task counts its links before anything is shuffled, and the counted
pairs fit a broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.byte_bpe import ByteTable
from quittance.llm.shared import ship, slices, stored
from quittance.llm.units import UnitEncoder

#: Longer units are encoded each time they come up.
REMEMBERED_CHARS = 40
#: Units in each of the two generations a worker remembers.
REMEMBERED_UNITS = 400_000
#: Pairs that a task holds uncounted at most.
HELD_LINKS = 1 << 21

_UNIT = re.compile(" +[^ ]*")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class PieceEncoder:
    """Ids of texts by a sentencepiece model, unit by unit.

    No piece has a space behind another character, so no merge crosses from a word to the space
    after it. A text is cut there, each unit is encoded alone, and short units are remembered.
    """

    def __init__(self, model: bytes):
        self._library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = list(map(self._library.id_to_piece, range(self._library.get_piece_size())))
        self._by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        self._space = array("I", [self._library.piece_to_id("▁")]).tobytes()
        self.tokens = [
            bytes([int(m[1], 16)])
            if (m := _BYTE_PIECE.fullmatch(p)) and self._library.is_byte(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of a space and each text, as little-endian bytes."""
        if len(self._known) > REMEMBERED_UNITS:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        cut = [_UNIT.findall(f" {t}") if self._by_unit else [f" {t}"] for t in texts]
        missing, long = [], []
        for u in {u for units in cut for u in units if u not in known}:
            ids = older.get(u)
            if ids is None:
                missing.append(u)
            else:
                known[u] = ids
        # The library puts the first space there itself, but not before nothing.
        coded = self._library.encode([u[1:] for u in missing], num_threads=1)
        for u, ids in zip(missing, coded, strict=True):
            known[u] = self._space if u == " " else array("I", ids).tobytes()
            if len(u) > REMEMBERED_CHARS:
                long.append(u)
        found = [b"".join(map(known.__getitem__, units)) for units in cut]
        for u in long:
            del known[u]
        return found


class Sides(NamedTuple):
    """Ids of tokens laid end to end, with the byte behind each."""

    ids: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends


def coalesce(a: Sides, b: Sides) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A token and of each B token, and the number of groups.

    Both sides cover the same bytes; groups are numbered from 0 in order.
    """
    starts = np.concatenate([a.starts, b.starts])
    ends = np.concatenate([a.ends, b.ends])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), np.int64)
    opens[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(a.ids)], group[len(a.ids) :], int(opens.sum())


def overlaps(a: Sides, b: Sides) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of an A and a B token that share a byte, as places in ``a`` and ``b``."""
    first = np.searchsorted(b.ends, a.starts, "right")
    behind = np.searchsorted(b.starts, a.ends, "left")
    n = behind - first
    in_a = np.repeat(np.arange(len(a.ids)), n)
    return in_a, np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Labels:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size: int):
        self._size = size
        ends = (b",", b"|", b";", b"")
        self._written = np.array([b"%d%s" % (i, e) for e in ends for i in range(size)], object)

    def write(self, a: Sides, b: Sides, a_group, b_group, a_last, b_last) -> list[bytes]:
        """The labels in order; ``a_last``/``b_last``: places behind the last tokens of documents."""
        groups = int(a_group[-1]) + 1 if len(a_group) else 0
        n_a, n_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
        a_kind, b_kind = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        a_kind[a_end - 1] = 1
        b_kind[b_end - 1] = 2
        b_kind[b_last - 1] = 3
        line = np.empty(len(a.ids) + len(b.ids), object)
        line[np.arange(len(a.ids)) + (b_end - n_b)[a_group]] = self._written[
            a_kind * self._size + a.ids
        ]
        line[np.arange(len(b.ids)) + a_end[b_group]] = self._written[b_kind * self._size + b.ids]
        return line.tolist()


class Aligner:
    """Aligns batches of texts; one per worker process."""

    def __init__(self, a_json: str, b_model: bytes):
        rules = json.loads(a_json)
        rules["added_tokens"] = []  # their strings within a text are plain text
        plain = json.dumps(rules, ensure_ascii=False)
        self._a = UnitEncoder(plain)
        self._b = PieceEncoder(b_model)
        self._a_table = ByteTable(plain)
        self._b_table = ByteTable.of(self._b.tokens)
        self._ahead = len(self._a.encode(["x"])[0])
        self.a_tokens, self.b_tokens = self._a_table.tokens, self._b_table.tokens
        self.a_size, self.b_size = len(self._a_table.sizes), len(self._b_table.sizes)
        self._labels = Labels(max(self.a_size, self.b_size))

    def _encoded(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both sides; none where they do not spell a space and the text."""
        # A word before the text changes nothing behind it and lets the text be cut at its space.
        coded = self._a.encode([f"x {t}" if t else None for t in texts])
        a = [np.frombuffer(c[self._ahead :], "<u4") for c in coded]
        b = [np.frombuffer(c, "<u4") for c in self._b.encode([t or "" for t in texts])]
        for k, t in enumerate(texts):
            if not t:
                a[k] = b[k] = np.zeros(0, "<u4")
                continue
            raw = f" {t}".encode()
            if self._a_table.decode(a[k]) != raw or self._b_table.decode(b[k]) != raw:
                a[k] = b[k] = np.zeros(0, "<u4")
        return a, b

    def align(self, texts: list[str | None], digest: bool) -> Iterator[tuple]:
        """Per text: n_a, n_b, n_groups, links (codes of id pairs), groups as text or digest."""
        a_ids, b_ids = self._encoded(texts)
        a_last, b_last = (np.cumsum([len(i) for i in side]) for side in (a_ids, b_ids))
        joined = [np.concatenate([np.zeros(0, "<u4"), *side]).astype(np.int64) for side in (a_ids, b_ids)]
        a = Sides(joined[0], np.cumsum(self._a_table.sizes[joined[0]]))
        b = Sides(joined[1], np.cumsum(self._b_table.sizes[joined[1]]))
        a_group, b_group, _ = coalesce(a, b)
        in_a, in_b = overlaps(a, b)
        together = a.ends[in_a] == b.ends[in_b]
        in_a, in_b = in_a[together], in_b[together]
        links = (a.ids[in_a] * self.b_size + b.ids[in_b]).astype(self.code)
        link_last = np.searchsorted(in_a, a_last, "left")
        some = np.flatnonzero(np.diff(b_last, prepend=0))
        labels = self._labels.write(a, b, a_group, b_group, a_last[some], b_last[some])
        a_at = b_at = link_at = 0
        for a_to, b_to, link_to in zip(a_last.tolist(), b_last.tolist(), link_last.tolist()):
            line = b"".join(labels[a_at + b_at : a_to + b_to])
            if digest:
                line = hashlib.sha256(line).hexdigest() if line else ""
            else:
                line = line.decode()
            n_groups = int(a_group[a_to - 1] - a_group[a_at]) + 1 if a_to > a_at else 0
            yield a_to - a_at, b_to - b_at, n_groups, links[link_at:link_to].tobytes(), line
            a_at, b_at, link_at = a_to, b_to, link_to

    @property
    def code(self) -> str:
        """The number type that holds the code of any pair: A's id times B's size, plus B's id."""
        return "<u4" if self.a_size * self.b_size <= 1 << 32 else "<u8"


@lru_cache(maxsize=1)
def aligner(a_json: str, b_model: bytes) -> Aligner:
    return Aligner(a_json, b_model)


def most_pairs(a_tokens: list[bytes], b_tokens: list[bytes]) -> int:
    """How many pairs of ids can ever be linked: those where one token is a tail of the other."""

    def tails(some: list[bytes], of: list[bytes], least: int) -> int:
        times = Counter(some)
        return sum(times[t[k:]] for t in of for k in range(least, len(t)))

    return tails(b_tokens, a_tokens, 0) + tails(a_tokens, b_tokens, 1)  # equal tokens count once


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts added up."""
    codes, back = np.unique(codes, return_inverse=True)
    return codes, np.bincount(back, counts, len(codes)).astype(np.int64)


def alignments(
    docs: DataFrame,
    a_json: str,
    b_model: bytes,
    digest: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One stored row per row of ``docs``: the id, n_a, n_b, n_groups, links and groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (ids in order), or its sha256 with ``digest``; ``links`` the
    codes of the linked id pairs in order (``Aligner.code``). A text that is missing, empty, or that
    either tokenizer does not spell back has no tokens: zeros, no links and an empty string. Rows
    are neither dropped nor merged, ids may be missing or repeat, other columns are never read.
    """
    ship(docs.sparkSession)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_json, b_model).align
        for batch in batches:
            for first, texts in slices(batch, 1):
                n_a, n_b, n_groups, links, groups = zip(*align(texts, digest), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        *[pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups)],
                        pa.array(links, pa.binary()),
                        pa.array(groups, pa.string()),
                    ],
                    [id_column, "n_a", "n_b", "n_groups", "links", "groups"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, n_a bigint, n_b bigint, n_groups bigint, links binary, groups string"
    )
    rows = docs.select(id_column, text_column).mapInArrow(aligned, schema)
    return stored(rows, "alignments", "zstd")


def pair_counts(aligned: DataFrame, code: str) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair of ids."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, code), np.zeros(0, np.int64)
        held, n = [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([np.zeros(0, code), *held])
            return _counted(
                np.concatenate([codes, new]), np.concatenate([counts, np.ones(len(new), np.int64)])
            )

        for batch in batches:
            for _, links in slices(batch, 0):
                held.append(np.frombuffer(b"".join(links), code))
                n += len(held[-1])
                if n >= HELD_LINKS:
                    codes, counts = fold()
                    held, n = [], 0
        codes, counts = fold()
        yield pa.RecordBatch.from_arrays(
            [pa.array(codes.astype(np.int64)), pa.array(counts)], ["pair", "n"]
        )

    per_task = aligned.select("links").mapInArrow(counted, "pair bigint, n bigint")
    return per_task.groupBy("pair").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum for ``links``.

    A pair's count is the number of links in the whole corpus that hold it. ``n_best`` counts the
    links whose pair has the highest count of all pairs with that B id, ties included; ``count_sum``
    adds the counts of the links.
    """
    spark = aligned.sparkSession
    sizes = aligner(a_json, b_model)
    code, b_size = sizes.code, sizes.b_size
    # No more rows than ``most_pairs`` says, however large the corpus is.
    table = pair_counts(aligned, code).toArrow()
    pairs, n = (np.asarray(pc.fill_null(table[c], 0)) for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    highest = np.zeros(b_size, np.int64)
    np.maximum.at(highest, pairs % b_size, n)
    shared = spark.sparkContext.broadcast((pairs.astype(code), n, n == highest[pairs % b_size]))
    kept = [c for c in aligned.columns if c not in ("links", "n_links", "n_best", "count_sum")]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            for first, links in slices(batch, len(kept)):
                codes = np.frombuffer(b"".join(links), code)
                at = np.searchsorted(pairs, codes)
                size = np.dtype(code).itemsize
                last = np.cumsum([len(raw) // size for raw in links])
                columns = [batch.column(k).slice(first, len(links)) for k in range(len(kept))]
                for values in (np.ones(len(at), np.int64), best[at], n[at]):
                    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[last]
                    columns.append(pa.array(np.diff(upto, prepend=0)))
                yield pa.RecordBatch.from_arrays(
                    columns, [*kept, "n_links", "n_best", "count_sum"]
                )

    schema = aligned.select(kept).schema
    for name in ("n_links", "n_best", "count_sum"):
        schema = schema.add(name, "long")
    return aligned.select(*kept, "links").mapInArrow(looked_up, schema)
