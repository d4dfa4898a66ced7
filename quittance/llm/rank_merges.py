"""BPE encoding and decoding by contiguous rank arrays, for tokenizers with word ends.

A text is cut at spaces and line breaks, which such a tokenizer drops, and each new stretch goes
through the tokenizer's own normalizer and splitter; what they leave are words of bytes. The merges
are done here. The parts of a word lie side by side in an array, one column from each boundary to
the next, and beside it lie the ranks of the pairs that meet at a boundary. Each step scans the
ranks for the least, deletes that boundary and looks up the ranks of the two neighbours anew, until
no pair has a rank. Words of equal length lose one boundary a step alike, so a whole batch of them
is one rectangle and every step is a few numpy calls. Scanning costs the square of the length, so a
word of more than ``SHORT_BYTES`` bytes keeps its pairs in a heap instead; both take the leftmost of
the least ranks, hence give the same ids.

Each worker remembers the ids of short stretches and words. Decoding lays the tokens of the ids out
by a table and joins them as the library does when the tokenizer has no decoder: by one space.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quittance.llm.shared import ship, slices
from quittance.llm.units import byte_characters

#: Words of more bytes are merged by a heap.
SHORT_BYTES = 96
#: Longer stretches are encoded each time they come up.
REMEMBERED_CHARS = 40
#: Stretches, and words, in each of the two generations a worker remembers.
REMEMBERED = 400_000
#: Stands for the rank of a pair that has none.
NO_RANK = np.iinfo(np.int32).max

#: Letters that are normal forms already and have a lower case of one character, and the marks
#: behind a word: two words to the splitter.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([,.;:!?)]*)")


class Merges:
    """The merges of a BPE model whose characters stand for bytes."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        missing = [c for c in chars for end in ("", suffix) if c + end not in vocab]
        if missing or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a model of plain byte merges")
        self._inner = np.array([vocab[c] for c in chars], np.int32)
        self._last = np.array([vocab[c + suffix] for c in chars], np.int32)
        self._size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self._size + right
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank_of = keys[order], order.astype(np.int32)
        self._ranked: dict[tuple[int, int], int] | None = None
        every = np.arange(256)
        first, second = np.repeat(self._inner, 256), np.tile(self._inner, 256)
        self._inner_ranks = self._ranks(first, second)
        self._last_ranks = self._ranks(first, self._last[np.tile(every, 256)])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts."""
        keys = left * np.int64(self._size) + right
        at = np.searchsorted(self._keys, keys)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == keys, self._rank_of[at], NO_RANK)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian bytes."""
        found: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            if size > SHORT_BYTES:
                for k in which.tolist():
                    found[k] = self._long(words[k])
            elif size:
                raw = b"".join(map(words.__getitem__, which.tolist()))
                self._short(np.frombuffer(raw, np.uint8).reshape(-1, size), which, found)
        return found

    def _short(self, data: np.ndarray, which: np.ndarray, found: list[bytes]) -> None:
        """Merge words of one length, a row each; their ids go to ``found`` at ``which``."""
        parts = self._inner[data]
        parts[:, -1] = self._last[data[:, -1]]
        pairs = data[:, :-1].astype(np.int64) * 256 + data[:, 1:]
        ranks = self._inner_ranks[pairs]
        if pairs.shape[1]:
            ranks[:, -1] = self._last_ranks[pairs[:, -1]]
        while len(which):
            width = parts.shape[1]
            if width == 1:
                done = np.ones(len(which), bool)
            else:
                rows = np.arange(len(which))
                at = ranks.argmin(axis=1)
                least = ranks[rows, at]
                done = least == NO_RANK
            if done.any():
                raw, step = parts[done].astype("<u4").tobytes(), 4 * width
                for k, row in enumerate(which[done].tolist()):
                    found[row] = raw[k * step : (k + 1) * step]
                keep = ~done
                which, parts, ranks = which[keep], parts[keep], ranks[keep]
                if not len(which):
                    return
                rows, at, least = np.arange(len(which)), at[keep], least[keep]
            # The boundary behind part ``at`` goes: its part takes the merge, the next one vanishes.
            parts[rows, at] = self._merged[least]
            columns = np.arange(width)
            n = len(which)
            parts = parts[columns != (at + 1)[:, None]].reshape(n, width - 1)
            ranks = ranks[columns[:-1] != at[:, None]].reshape(n, width - 2)
            for near in (at - 1, at):
                some = np.flatnonzero((near >= 0) & (near < width - 2))
                left = near[some]
                ranks[some, left] = self._ranks(parts[some, left], parts[some, left + 1])

    def _long(self, word: bytes) -> bytes:
        """Merge one word by a heap of (rank, place)."""
        if self._ranked is None:
            pairs = (divmod(k, self._size) for k in self._keys.tolist())
            self._ranked = dict(zip(pairs, self._rank_of.tolist(), strict=True))
        ranked, merged = self._ranked.get, self._merged
        data = np.frombuffer(word, np.uint8)
        parts = self._inner[data].tolist()
        parts[-1] = int(self._last[data[-1]])
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = (ranked((parts[k], parts[k + 1])) for k in range(n - 1))
        heap = [(rank, k) for k, rank in enumerate(ranks) if rank is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if parts[k] < 0 or right == n or ranked((parts[k], parts[right])) != rank:
                continue  # a part of this pair has changed since
            parts[k], parts[right] = int(merged[rank]), -1
            after[k] = end = after[right]
            if end < n:
                before[end] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    rank = ranked((parts[left], parts[after[left]]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, left))
        return array("I", [p for p in parts if p >= 0]).tobytes()


class RankEncoder:
    """Ids of texts by a tokenizer given as the text of its JSON."""

    def __init__(self, tokenizer: str):
        rules = json.loads(tokenizer)
        self._library = Tokenizer.from_str(tokenizer)
        self._merges = Merges(rules["model"])
        added = rules["added_tokens"]
        odd = [t for t in added if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if odd or any(re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens must be found in the text as they stand, without spaces")
        self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        names = sorted(self._added, key=len, reverse=True)
        self._specials = re.compile("(%s)" % "|".join(map(re.escape, names or ["(?!)"])))
        self._byte_of = {c: b for b, c in enumerate(byte_characters())}
        self._plain = self._has_plain_words()
        self._known: dict[str, bytes] = {}
        self._words: dict[bytes | str, bytes] = dict(self._added)
        self._older: tuple[dict, dict] = ({}, {})

    def _pieces(self, stretch: str) -> list[bytes]:
        """The words that the tokenizer's own normalizer and splitter make of a stretch."""
        rules = self._library
        normal = rules.normalizer.normalize_str(stretch) if rules.normalizer else stretch
        cut = rules.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self._byte_of.__getitem__, shown)) for shown, _ in cut]

    def _has_plain_words(self) -> bool:
        """Whether white space is dropped and letters are lower-cased and kept together."""
        asked = ["The", "ÉTÉ,", "Łódź?!", "naïve.)", "XYZZY;:", "ǅ", "a"]
        plain = all(self._plain_words(s) == self._pieces(s) for s in asked)
        if self._pieces("a \n b") != self._pieces("a") + self._pieces("b"):
            raise ValueError("not a tokenizer that drops white space")
        return plain

    @staticmethod
    def _plain_words(stretch: str) -> list[bytes] | None:
        found = _PLAIN.fullmatch(stretch)
        if found is None:
            return None
        word, marks = found.groups()
        return [word.lower().encode(), marks.encode()] if marks else [word.lower().encode()]

    def _cut(self, stretch: str) -> list[bytes | str]:
        """The words of a stretch, and the added tokens in it as strings."""
        words = self._plain_words(stretch) if self._plain else None
        if words is not None:
            return words
        if not self._specials.search(stretch):
            return self._pieces(stretch)
        parts = self._specials.split(stretch)
        return list(
            chain.from_iterable([p] if k % 2 else self._pieces(p) for k, p in enumerate(parts) if p)
        )

    def _learn(self, new: Iterable[str]) -> list[str]:
        """Learn stretches; returns those too long to remember for good."""
        known, words, (old_known, old_words) = self._known, self._words, self._older
        cut: dict[str, list[bytes | str]] = {}
        for s in new:
            ids = old_known.get(s)
            if ids is None:
                cut[s] = self._cut(s)
            else:
                known[s] = ids
        missing, long = [], []
        for w in set(chain.from_iterable(cut.values())).difference(words):
            ids = old_words.get(w)
            if ids is None:
                missing.append(w)
            else:
                words[w] = ids
        words.update(zip(missing, self._merges.ids(missing), strict=True))
        find = words.__getitem__
        for s, ws in cut.items():
            known[s] = find(ws[0]) if len(ws) == 1 else b"".join(map(find, ws))
            if len(s) > REMEMBERED_CHARS:
                long.append(s)
        for w in missing:
            if len(w) > REMEMBERED_CHARS:
                del words[w]
        return long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian bytes; a missing text is an empty one."""
        if max(len(self._known), len(self._words)) > REMEMBERED:
            self._older, self._known, self._words = (self._known, self._words), {}, dict(self._added)
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        long = self._learn(set(chain.from_iterable(cut)).difference(self._known))
        find = self._known.__getitem__
        found = [b"".join(map(find, stretches)) for stretches in cut]
        for s in long:
            del self._known[s]
        return found


class TokenTable:
    """Texts of ids, for tokenizers without a decoder: tokens joined by one space."""

    def __init__(self, tokenizer: str):
        rules = json.loads(tokenizer)
        if rules.get("decoder"):
            raise ValueError("this tokenizer has a decoder of its own")
        tokens = rules["model"]["vocab"] | {t["content"]: t["id"] for t in rules["added_tokens"]}
        self._tokens = np.full(max(tokens.values()) + 1, None, object)
        for token, i in tokens.items():
            self._tokens[i] = token.encode()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; ids without a token are left out, as the library does."""
        known = self._tokens[ids[ids < len(self._tokens)]].tolist()
        return b" ".join(filter(None, known)) if None in known else b" ".join(known)


@lru_cache(maxsize=2)
def rank_encoder(tokenizer: str) -> RankEncoder:
    """One encoder per worker process and tokenizer, kept from task to task."""
    return RankEncoder(tokenizer)


@lru_cache(maxsize=2)
def token_table(tokenizer: str) -> TokenTable:
    return TokenTable(tokenizer)


def encode(
    docs: DataFrame, tokenizer: str, round_trip: bool = False, text_column: str = "text"
) -> DataFrame:
    """``docs`` without the text, with ``ids`` (unsigned 32-bit numbers, little-endian, as binary).

    With ``round_trip`` also ``decoded``: the text that the ids decode to, in the same pass. A
    missing or empty text has no ids and decodes to nothing; one of white space alone likewise. Rows
    are neither dropped nor merged, so repeated ids stay repeated. A text is worked on in stretches,
    whatever its length. Other columns stay, but for those named like a new one.
    """
    ship(docs.sparkSession)
    made = ["ids", *["decoded"] * round_trip]
    kept = [c for c in docs.columns if c not in (text_column, *made)]
    last = len(kept)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = rank_encoder(tokenizer).encode
        for batch in batches:
            for first, texts in slices(batch, last):
                raw = to_ids(texts)
                columns = [batch.column(k).slice(first, len(texts)) for k in range(last)]
                columns.append(pa.array(raw, pa.binary()))
                if round_trip:
                    back = token_table(tokenizer).decode
                    decoded = (back(np.frombuffer(r, "<u4")) for r in raw)
                    columns.append(pa.array(decoded, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    schema = docs.select(kept).schema.add("ids", "binary")
    if round_trip:
        schema = schema.add("decoded", "string")
    return docs.select(*kept, text_column).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text of ``ids``; missing ids decode to an empty text."""
    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "decoded"]
    at = kept.index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = token_table(tokenizer).decode
        for batch in batches:
            for first, ids in slices(batch, at):
                texts = pa.array((back(np.frombuffer(i or b"", "<u4")) for i in ids), pa.binary())
                rest = [batch.column(k).slice(first, len(ids)) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, texts.cast(pa.string())], [*kept, "decoded"])

    schema = encoded.select(kept).schema.add("decoded", "string")
    return encoded.select(kept).mapInArrow(decoded, schema)
