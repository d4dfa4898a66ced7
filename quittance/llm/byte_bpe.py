"""Byte-level BPE by the tokenizers library, from a file of ranks, and back to bytes.

The library merges characters, so each of the 256 bytes stands for one visible character. Bytes
that are visible characters in Latin-1 keep their own code point, the others take those from 256
on. A rank file gives no merges: the merge that makes a token is found by merging its bytes with
the tokens ranked before it until two are left.

Decoding needs no library: the byte table is turned round, token after token is laid into one
byte string by numpy, and only that is read as UTF-8, so a character split between two tokens is
whole again.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType

from quittance.llm.shared import ship, slices
from quittance.llm.units import byte_characters, encoder


#: Units in a generation of a worker: in the pipeline it lives on beside those of all other stages.
REMEMBERED_UNITS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``; none if no merges lead to it."""
    most, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = most, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], most)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=2)
def tokenizer_from_ranks(path: str, pattern: str) -> str:
    """The JSON of a tokenizer of that library with the given ranks and splitting pattern."""
    ranks, chars = read_ranks(path), byte_characters()

    def shown(token: bytes) -> str:
        return "".join(chars[b] for b in token)

    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := _halves(token, ranks)):
            merges.append([shown(pair[0]), shown(pair[1])])
    split = {
        "type": "Split",
        "pattern": {"Regex": pattern},
        "behavior": "Isolated",
        "invert": False,
    }
    level = {
        "type": "ByteLevel",
        "add_prefix_space": False,
        "trim_offsets": False,
        "use_regex": False,
    }
    model = {
        "type": "BPE",
        "dropout": None,
        "unk_token": None,
        "continuing_subword_prefix": None,
        "end_of_word_suffix": None,
        "fuse_unk": False,
        "byte_fallback": False,
        "ignore_merges": True,  # a piece that is a token is that token
        "vocab": {shown(t): r for t, r in ranks.items()},
        "merges": merges,
    }
    whole = {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [],
        "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]},
        "post_processor": None,
        "decoder": level,
        "model": model,
    }
    return json.dumps(whole)


class ByteTable:
    """The bytes of each id, laid end to end; decodes whole id arrays by indexing."""

    def __init__(self, tokenizer: str):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(tokenizer)["model"]["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in shown)
        self._lay(tokens)

    @classmethod
    def of(cls, tokens: list[bytes]) -> ByteTable:
        """A table of tokens whose bytes are known."""
        table = cls.__new__(cls)
        table._lay(tokens)
        return table

    def _lay(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.cumsum(self.sizes) - self.sizes
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        shift = np.repeat(self._starts[ids] - (ends - sizes), sizes)
        return self._bytes[np.arange(ends[-1]) + shift].tobytes()

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points of the text.

        A character split between tokens belongs to each of them: the start is that of the
        character the first byte is part of, the end lies behind that of the last byte.
        """
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        data = np.frombuffer(raw, dtype=np.uint8)
        upto = np.cumsum((data & 0xC0) != 0x80)
        return upto[starts] - 1, upto[ends - 1]


@lru_cache(maxsize=2)
def byte_table(tokenizer: str) -> ByteTable:
    return ByteTable(tokenizer)


def encode(
    docs: DataFrame,
    tokenizer: str,
    offsets: bool = False,
    round_trip: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the text, with ``ids`` (unsigned 32-bit numbers, little-endian, as binary).

    With ``offsets``, also ``starts`` and ``ends``: arrays of code point positions per token. With
    ``round_trip``, also ``decoded``: the bytes that the ids decode to, in the same pass. A missing
    or empty text has no ids. Rows are neither dropped nor merged; of the other columns those named
    like a new one give way to it.
    """
    ship(docs.sparkSession)
    made = ["ids", *["starts", "ends"] * offsets, *["decoded"] * round_trip]
    kept = [c for c in docs.columns if c not in (text_column, *made)]
    last = len(kept)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, table = encoder(tokenizer, REMEMBERED_UNITS).encode, byte_table(tokenizer)
        for batch in batches:
            for first, texts in slices(batch, last):
                raw = to_ids(texts)
                ids = [np.frombuffer(r, "<u4") for r in raw]
                columns = [batch.column(k).slice(first, len(texts)) for k in range(last)]
                columns.append(pa.array(raw, pa.binary()))
                if offsets:
                    spans = [
                        table.offsets(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)
                    ]
                    for side in (0, 1):
                        columns.append(pa.array([s[side] for s in spans], pa.list_(pa.int64())))
                if round_trip:
                    columns.append(pa.array(map(table.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    schema = docs.select(kept).schema.add("ids", "binary")
    for name in made[1:]:
        schema = schema.add(name, BinaryType() if name == "decoded" else ArrayType(LongType()))
    return docs.select(*kept, text_column).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, tokenizer: str, as_text: bool = True) -> DataFrame:
    """``encoded`` with ``decoded``: the text, or with ``as_text=False`` its bytes.

    Bytes that are no UTF-8 (ids cut out of a text) become replacement characters in a text.
    Missing ids decode to an empty text.
    """
    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "decoded"]
    at = kept.index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(tokenizer)
        for batch in batches:
            for first, ids in slices(batch, at):
                raw = [table.decode(np.frombuffer(i or b"", "<u4")) for i in ids]
                column = (
                    pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())
                    if as_text
                    else pa.array(raw, pa.binary())
                )
                rest = [batch.column(k).slice(first, len(ids)) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, column], [*kept, "decoded"])

    schema = encoded.select(kept).schema.add("decoded", "string" if as_text else "binary")
    return encoded.select(kept).mapInArrow(decoded, schema)
