"""Repairs against an exhaustive search over all edits, and the Spark job against plain loops."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from edges import CLASHING
from pyspark.sql import functions as F

from quittance.llm import conversation_repair as repair
from quittance.llm.queries import QUERIES, table

SF_DIR = "/root/testdata/sf0.001"
SOUND = re.compile("(s?(ua)+)?")


def brute(rows):
    """(cost, audit) of rows given as (initial, must go, truncated): every edit, least first."""

    @lru_cache(None)
    def best(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, ""))
        new = "a" if last == "u" else "u"
        if inserted < 3:
            cost, audit = best(i, new, inserted + 1)
            ways.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            cost, audit = best(i + 1, last, 0)
            ways.append((cost + 3, "D" + audit))
            if not must_go:
                cost, audit = best(i + 1, new, 0)
                ways.append((cost + 2 + truncated, "R" + audit))
                if initial and last + initial in ("s", "u", "su", "ua", "au"):
                    cost, audit = best(i + 1, initial, 0)
                    ways.append((cost + truncated, "K" + audit))
        return min(ways, default=(10**9, ""))

    for i in range(len(rows), 0, -1):  # from the end, so that calls do not nest deeply
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def row_of(code):
    return "sua?"[code & 3], bool(code & (repair.BLANK | repair.REPEATED)), bool(code & repair.CUT)


KINDS = [0, 1, 2, 3, repair.CUT | 0, repair.CUT | 1, repair.CUT | 2, repair.BLANK | 1]


def test_all_short_conversations():
    for size in range(4):
        for codes in itertools.product(KINDS, repeat=size):
            assert repair.search(bytes(codes)) == brute(tuple(map(row_of, codes)))


def long_ones(count, seed):
    random.seed(seed)
    for _ in range(count):
        yield bytes(random.choices([*KINDS, 1, 2, 1, 2], k=random.randint(5, 60)))


def test_longer_conversations():
    for codes in long_ones(200, 1):
        assert repair.search(codes) == brute(tuple(map(row_of, codes)))


def test_bounds_never_exceed_what_is_left():
    for codes in long_ones(20, 2):
        bounds = repair.suffix_bounds(codes, repair.END)
        for k in range(len(codes) + 1):
            least = min(repair.search(codes[k:], q)[0] for q in range(4))
            assert bounds[k] == least


def test_segments_chain_to_the_whole():
    random.seed(3)
    for codes in long_ones(200, 4):
        size = random.randint(1, 7)
        parts = [codes[k : k + size] for k in range(0, len(codes), size)]
        parts.insert(random.randint(0, len(parts)), b"")
        costs, ranks = [], []
        for k, part in enumerate(parts):
            exits = [repair.END] if k == len(parts) - 1 else range(4)
            costs.append([[repair.NEVER] * 4 for _ in range(4)])
            ranks.append([[0] * 4 for _ in range(4)])
            for q in range(4):
                ways = {x % 4: repair.cheapest(part, q, x) for x in exits}
                audits = sorted(w[1] for w in ways.values() if w)
                for x, w in ways.items():
                    if w:
                        costs[k][q][x], ranks[k][q][x] = w[0], audits.index(w[1])
        way = repair.chain(costs, ranks)
        found = [repair.cheapest(p, *w) for p, w in zip(parts, way, strict=True)]
        assert (sum(f[0] for f in found), "".join(f[1] for f in found)) == repair.search(codes)


@pytest.mark.parametrize("kinds", [[1, 2], [0], [1], [3], [0, 1, 2], KINDS])
def test_work_grows_with_the_rows(kinds):
    """Nodes visited: a bounded number per row, also where no role fits."""
    random.seed(8)
    codes = bytes(random.choices(kinds, k=4096))
    visits = 0

    class Bounds(list):
        def __getitem__(self, k):
            nonlocal visits
            visits += 1
            return super().__getitem__(k)

    bounds = repair.suffix_bounds(codes, repair.END)
    found = repair._search(codes, repair.START, repair.END, Bounds(bounds), bounds[0] + repair.SWITCH)
    assert found is not None and visits < 100 * len(codes)


def damaged(rows):
    """(conv_id, turn, role, text) after damage; the rows that went are left out."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def expected(original, rows):
    found = {conv: [] for conv, *_ in original}
    for conv, *row in rows:
        found[conv].append(row)
    out = {}
    for conv, lines in found.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2])))
        turns = {t for t, _, _ in lines if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults, codes = set(), [], []
        for _, role, text in lines:
            visible = text.strip(" \t\n\x0b\x0c\r")
            fault = (
                "blank" if not visible
                else "duplicate" if (role, text) in seen
                else "truncated" if visible[-1] not in ".!?"
                else ""
            )
            seen.add((role, text))
            faults.append(fault)
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = zip(lines, lines[1:], strict=False)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in pairs)
        cost, audit = brute(tuple(codes))
        written, last, left = [], "", iter(lines)
        for edit in audit:
            new = "a" if last == "u" else "u"
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit in "IR":
                role = "assistant" if new == "a" else "user"
            if edit != "D":
                written.append((role, text))
                last = role[:1]
        assert SOUND.fullmatch("".join(r[:1] for r, _ in written))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, digest, written)
    return out


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."),
    (1, 2, "assistant", "So."), (1, 4, "user", "cut off"), (1, 9, "tool", "42"),
    (2, None, "user", "no turn"), (2, None, "user", "no turn"), (2, None, None, "no role."),
    (2, 3, "assistant", None), (2, 3, "assistant", ""), (2, 3, "", "empty role."),
    (None, 1, "user", "no conversation."), (None, 1, "assistant", "None."), (None, None, None, None),
    (3, 5, "user", " \t\r\n\x0b\x0c "), (4, 1, "User", "Capital."), (4, 2, "ünser", "Ä!"),
    (5, -7, "assistant", "Long. " * 50_000), (5, 2, "user", "a\nb."), (6, 1, "system", "Alone."),
    *[(100 + k, k % 7, "user", f"{k}.") for k in range(60)],
    *[(7, k, ("user", "assistant", "system")[k % 11 % 3], f"{k % 23}{'.!?,'[k % 4]}") for k in range(300)],
]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    more = [c for c in CLASHING if c not in ("key", "turn")] + ["code", "seg", "audit", "_own", "copy"]
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in dict.fromkeys(more)])


@pytest.mark.parametrize("bits", [12, 2])
def test_odd_rows(spark, monkeypatch, bits):
    """Also with segments of four rows, which makes conversations span many."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = repair.damage(odd(spark))
    lines = damaged(ODD)
    wanted = expected(ODD, lines)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_digests(rows, "gone").collect()}
    assert got == {c: w[:-1] for c, w in wanted.items()}
    written = repair.repaired_rows(rows, "gone").collect()
    for conv, w in wanted.items():
        mine = sorted((r["place"], r["role"], r["text"]) for r in written if r["conv_id"] == conv)
        assert mine == [(k, *row) for k, row in enumerate(w[-1])]


def test_no_rows_and_conversations_that_lost_all(spark):
    empty = odd(spark).where("false")
    assert repair.repair_digests(repair.damage(empty), "gone").count() == 0
    assert repair.repaired_rows(repair.damage(empty), "gone").count() == 0
    lost = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair.repair_digests(repair.damage(odd(spark, lost)), "gone").collect()
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert lost and {r[0]: tuple(r[1:]) for r in got} == {c: nothing for c, *_ in lost}


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, SF_DIR)
    assert got.columns == [
        *["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
        "repaired_sha256",
    ]
    wanted = expected(rows, damaged(rows))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {c: w[:-1] for c, w in wanted.items()}
