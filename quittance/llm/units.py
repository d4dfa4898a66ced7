"""Encode texts with the tokenizers library, unit by unit, without changing a single id.

The tokenizers served here cut a text into pieces before they merge, and a space or line
break between two visible characters always ends one piece and starts another. A text may
therefore be cut there, each unit encoded alone, and the ids joined: the result is that of the
whole text. Units repeat, so each worker remembers the ids of short ones, which is several times
faster than encoding whole texts, and a very long text never reaches the library in one call.

A word of Latin letters is a single piece. Its merges are asked of the library's model directly,
which saves the steps before; whether that gives what the whole tokenizer gives is tried out on
sample words first.

A whole column of texts goes the same way without a Python object for each unit: Arrow makes the
units distinct and lays out the ids of each where it occurs.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Characters that no Unicode version takes for white space, a control or a combining mark.
_VISIBLE = "[!-~¡-¬®-ʯ一-鿿가-힣]"
SAFE_SPACE = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")
#: A unit that may stand after a space, or begins with the line break before it.
_CLEAN = re.compile(f"\n?{_VISIBLE}(?:[^ \n]*{_VISIBLE})?")
#: A line break or none, a word, and the marks behind it: pieces of their own, also in lower case
#: (İ would gain a mark).
_WORD = re.compile("(\n?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([,.;:!?)]*)")
_ENDS_CLEAN = re.compile(f"{_VISIBLE}$")
#: A word and its marks behind the space or line break that a column's unit begins with.
_BEHIND = "^(?P<word>[ \n][A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[,.;:!?)]*)$"
_SAMPLES = "a I the Word WORDS été Ärger naïve ŒUVRE Straße łódź encyclopaedia xyzzy Çığ ǅ".split()

#: Longer units are encoded each time they come up.
REMEMBERED_CHARS = 40
#: Units in each of the two generations a worker remembers.
REMEMBERED_UNITS = 400_000
#: Characters handed to the library in one call.
CALL_CHARS = 1 << 18


def byte_characters() -> list[str]:
    """The character that byte-level tokenizers show each byte as.

    Bytes that are visible characters in Latin-1 keep their own code point, the others take those
    from 256 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    table = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


_SHOWN = byte_characters()


def _spaced(unit: str) -> str:
    """A unit with the white space it stands behind."""
    return unit if unit[0] == "\n" else f" {unit}"


class UnitEncoder:
    """Ids of texts as unsigned 32-bit numbers; ``tokenizer`` is the text of a tokenizer's JSON.

    ``remembered`` bounds the units of a generation in place of ``REMEMBERED_UNITS``.
    """

    def __init__(self, tokenizer: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self._tokenizer = Tokenizer.from_str(tokenizer)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._remembered = remembered
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self._model = self._tokenizer.model
        self._line_break = self._encoded(["\n"])[0]
        self._direct = self._how_words_are_cut()

    def _how_words_are_cut(self) -> tuple[str, bool] | None:
        """What the model is given before a word that follows a space, and whether in lower case."""
        inner = [f" {w}" for w in _SAMPLES] + [f"\n{w}" for w in _SAMPLES]
        expected = self._encoded(inner)
        for before in (_SHOWN[0x20], ""):
            for folds in (False, True):
                self._direct = before, folds
                if expected == [self._word(u[0].strip(" "), u[1:]) for u in inner]:
                    return self._direct
        return None

    def _word(self, line: str, word: str) -> bytes:
        """The ids of a word after a line break or else a space."""
        before, folds = self._direct
        if folds:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(_SHOWN.__getitem__, word.encode()))
        try:
            pieces = self._model.tokenize(word if line else before + word)
        except Exception as e:  # the library knows no narrower class
            raise ValueError(f"the model refuses {word!r}") from e
        ids = array("I", [t.id for t in pieces]).tobytes()
        return self._line_break + ids if line else ids

    def _encoded(self, units: Iterable[str]) -> list[bytes]:
        """The ids of each unit, in calls of bounded size."""
        found: list[bytes] = []
        call: list[str] = []
        held = 0

        def flush() -> None:
            got = self._tokenizer.encode_batch_fast(call, add_special_tokens=False)
            found.extend(array("I", e.ids).tobytes() for e in got)
            call.clear()

        for u in units:
            if call and held + len(u) > CALL_CHARS:
                flush()
                held = 0
            call.append(u)
            held += len(u)
        if call:
            flush()
        return found

    def _learn_words(self, new: Iterable[str]) -> list[str]:
        """Learn the units that are words, with marks or without; returns the others."""
        known, before, marks = self._known, self._before, self._marks
        folds = self._direct and self._direct[1]
        match, others = _WORD.fullmatch, []
        for u in new:
            ids = before.get(u)
            if ids is None:
                m = match(u) if self._direct and len(u) <= REMEMBERED_CHARS else None
                if m is None:
                    others.append(u)
                    continue
                line, word, tail = m.groups()
                plain = line + (word.lower() if folds else word)
                ids = known.get(plain) or before.get(plain)
                if ids is None:
                    known[plain] = ids = self._word(line, word)
                if tail:
                    if tail not in marks:
                        marks[tail] = self._encoded([tail])[0]
                    ids += marks[tail]
            known[u] = ids
        return others

    def _learn(self, others: list[str]) -> dict[str, bytes]:
        """Learn other units; returns the ids of those too long to remember."""
        known = self._known
        others.sort(key=len)
        ids = dict(zip(others, self._encoded(map(_spaced, others)), strict=True))
        known.update((u, i) for u, i in ids.items() if len(u) <= REMEMBERED_CHARS)
        return {u: i for u, i in ids.items() if len(u) > REMEMBERED_CHARS}

    def _parts(self, texts: list[str | None]) -> Iterable[list[bytes]]:
        """The ids of each text in parts, in order."""
        if len(self._known) > (self._remembered or REMEMBERED_UNITS):
            self._before, self._known, self._marks = self._known, {}, {}
        known = self._known
        cut = [(t or "").replace("\n", " \n").split(" ") for t in texts]
        new = set(chain.from_iterable(islice(units, 1, None) for units in cut)).difference(known)
        rest = self._learn_words(new)
        unclean = {u for u in rest if not _CLEAN.fullmatch(u)}
        new = set(rest) - unclean
        for n, units in enumerate(cut):
            if not _ENDS_CLEAN.search(units[0]) or not unclean.isdisjoint(units[1:]):
                cut[n] = units = SAFE_SPACE.split(texts[n] or "")
                new.update(u for u in units[1:] if u not in known)
        long = self._learn(list(new))
        firsts = self._encoded(units[0] for units in cut)
        for first, units in zip(firsts, cut, strict=True):
            parts = list(map(known.get, units))
            parts[0] = first
            if None in parts:
                parts = [long[u] if p is None else p for u, p in zip(units, parts, strict=True)]
            yield parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian bytes; a missing text is an empty one."""
        return [b"".join(parts) for parts in self._parts(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [sum(map(len, parts)) // 4 for parts in self._parts(texts)]


def _strings(values: pa.Array) -> list:
    """The strings or bytes of an array, made by Arrow in one go."""
    return values.to_numpy(zero_copy_only=False).tolist()


class ColumnEncoder(UnitEncoder):
    """Ids of columns of texts. A unit begins with the space or line break it stands behind.

    Only the first unit of a text has neither. A text that must not be cut at each of them is left
    to the encoder of single texts. Of units that are words only the folded word is remembered.
    """

    def __init__(self, tokenizer: str):
        super().__init__(tokenizer)
        self._units: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _look_up(self, units: list[str], make: Callable[[list[str]], list]) -> list[bytes | None]:
        """The ids of different units; ``make`` gives those of new ones, or None."""
        ids = list(map(self._units.get, units))
        new = [u for u, i in zip(units, ids, strict=True) if i is None]
        older = list(map(self._older.get, new))
        made = iter(make([u for u, i in zip(new, older, strict=True) if i is None]))
        got = [next(made) if i is None else i for i in older]
        self._units.update(
            (u, i)
            for u, i in zip(new, got, strict=True)
            if i is not None and len(u) <= REMEMBERED_CHARS
        )
        found = iter(got)
        return [next(found) if i is None else i for i in ids]

    def _new_words(self, units: list[str]) -> list[bytes]:
        return [self._word(u[0].strip(" "), u[1:]) for u in units]

    def _new_units(self, units: list[str]) -> list[bytes | None]:
        """The ids of units that are no words; None where a text must not be cut beside one."""
        clean = [
            _CLEAN.fullmatch(u.removeprefix(" ")) if u[:1] in (" ", "\n") else _ENDS_CLEAN.search(u)
            for u in units
        ]
        ids = iter(self._encoded(u for u, c in zip(units, clean, strict=True) if c))
        return [next(ids) if c else None for c in clean]

    def _ids_of_units(self, units: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The ids of different units in some order, null as in ``_new_units``; the place of each."""
        split = pc.extract_regex(units, _BEHIND)
        words = pc.and_(split.is_valid(), pc.less_equal(pc.utf8_length(units), REMEMBERED_CHARS))
        if not self._direct:
            words = pc.and_(words, False)
        split, rest = split.filter(words), units.filter(pc.invert(words))
        folded = pc.utf8_lower(split.field(0)) if self._direct and self._direct[1] else split.field(0)
        heads, tails = folded.dictionary_encode(), split.field(1).dictionary_encode()
        ids = pa.array(self._look_up(_strings(heads.dictionary), self._new_words), pa.binary())
        marks = pa.array(self._encoded(_strings(tails.dictionary)), pa.binary())
        ids = pc.binary_join_element_wise(ids.take(heads.indices), marks.take(tails.indices), b"")
        others = pa.array(self._look_up(_strings(rest), self._new_units), pa.binary())
        words = words.to_numpy(zero_copy_only=False)
        place = np.where(words, np.cumsum(words), words.sum() + np.cumsum(~words)) - 1
        return pa.concat_arrays([ids, others]), place

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in order, how many each text has); a missing text is an empty one."""
        if len(self._units) > (self._remembered or REMEMBERED_UNITS):
            self._older, self._units = self._units, {}
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        ends = np.flatnonzero((data == 0x20) | (data == 0x0A))
        first = np.searchsorted(ends, starts)
        cuts = np.append(np.insert(ends, first, starts), len(data)).astype(np.int32)
        first += np.arange(len(starts))  # where in ``cuts`` each text begins
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        units = units.dictionary_encode()
        ids, place = self._ids_of_units(units.dictionary)
        at = place[units.indices.to_numpy()]
        if ids.null_count:
            whole = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False)[at], first)
            at[np.repeat(whole, np.diff(first, append=len(at)))] = len(ids)
            at[first[whole]] = np.arange(len(ids) + 1, len(ids) + 1 + whole.sum())
            texts = self.encode(texts.filter(pa.array(whole)).to_pylist())
            ids = pa.concat_arrays([ids, pa.array([b"", *texts], pa.binary())])
        laid = ids.cast(pa.large_binary()).take(pa.array(at))
        _, offsets, data = laid.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(at) + 1] // 4
        joined = np.frombuffer(data or b"", "<u4", offsets[-1])
        return joined, np.diff(offsets[first], append=offsets[-1])


@lru_cache(maxsize=2)
def column_encoder(tokenizer: str) -> ColumnEncoder:
    """One encoder per worker process and tokenizer, kept from task to task."""
    return ColumnEncoder(tokenizer)


@lru_cache(maxsize=2)
def encoder(tokenizer: str, remembered: int | None = None) -> UnitEncoder:
    """One encoder per worker process and tokenizer, kept from task to task."""
    return UnitEncoder(tokenizer, remembered)
