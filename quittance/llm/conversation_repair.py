"""Repair the structure of conversations at least cost, by depth-first branch and bound.

Role initials of a sound conversation read ``(s?(ua)+)?``. Rows may be kept (0), given the role user
or assistant (2) or deleted (3), rows without text may be inserted (2); blank and repeated rows must
go, and a truncated row that stays costs 1. The edits of a conversation, written ``D``, ``I``, ``K``,
``R`` in order, are its audit; of the cheapest audits the one least in ASCII is wanted.

``search`` walks prefixes of audits with an explicit stack, in ASCII order, so of two prefixes the
one met first is the lesser. A node is (rows used, role last written). Three things cut it short:

- the bound of a suffix: the cheapest repair of the rows from there on, whatever role came before;
- the incumbent: the best (cost, audit) so far. Any role can be mended into what another would have
  done for 4, so before there is one, the cost may exceed the first bound by that much;
- dominance: a prefix that comes to a node at no less cost than an earlier one is worse in cost or
  in audit, and so is everything behind it.

Costs at a node lie within a few units of each other, so the work grows with the number of rows.

On Spark, only what the search needs of a row moves: a key of role and text, and a byte that tells
its initial and faults. Rows are dealt by ranges of (conversation, turn), so a conversation of any
size lies on many tasks; repeats are found by grouping keys. A conversation is searched in segments
of at most ``SEGMENT`` rows. Where it has more than one, each is searched from every role to every
role, the costs are chained through, and only then are the audits written. Texts move once, to be
written in order with the edits; as a digest covers a whole conversation, they stream through one
task, a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.shared import ship, stored

#: Roles that can be written last; START: none yet.
START, SYSTEM, USER, ASSISTANT = range(4)
#: As ``exit``: the conversation ends, so rows may be inserted behind the last one.
END = 4
#: What an inserted or renamed row is, by the role before it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The role written last when a row with initial s, u, a or another is kept; None if it cannot be.
KEPT = (
    (SYSTEM, USER, None, None),
    (None, USER, None, None),
    (None, None, ASSISTANT, None),
    (None, USER, None, None),
)
#: Costs.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: No role is further from what another could do.
SWITCH = 4
#: Flags beside the initial (0 to 3) in the byte that describes a row.
CUT, BLANK, REPEATED, GONE = 4, 8, 16, 32
INITIALS = "sua"
NEVER = 1 << 60

#: Rows in a segment; a power of two.
SEGMENT_BITS = 12
SEGMENT = 1 << SEGMENT_BITS
#: Results of segments of up to this many rows are remembered.
REMEMBERED_ROWS = 24

_SPACE = " \t\n\x0b\x0c\r"


def suffix_bounds(rows: bytes, exit: int) -> list[int]:
    """For each place, the least cost of repairing the rows from there, whatever came before."""
    if exit == END:  # a user without an answer, or a system row alone, needs rows behind it
        least = [0, 2 * INSERT, INSERT, 0]
    else:
        least = [0 if role == exit else NEVER for role in range(4)]
    bounds = [min(least)]
    for row in reversed(rows):
        initial, cut = row & 3, TRUNCATED if row & CUT else 0
        here = []
        for last in range(4):
            cost = DELETE + least[last]
            if not row & (BLANK | REPEATED):
                cost = min(cost, RENAME + cut + least[NEXT[last]])
                kept = KEPT[last][initial]
                if kept is not None:
                    cost = min(cost, cut + least[kept])
            here.append(cost)
        # One or two rows inserted before this one; a third would come back to the role of the first.
        least = [
            min(here[q], INSERT + here[NEXT[q]], 2 * INSERT + here[NEXT[NEXT[q]]]) for q in range(4)
        ]
        bounds.append(min(least))
    bounds.reverse()
    return bounds


def search(rows: bytes, entry: int = START, exit: int = END) -> tuple[int, str] | None:
    """The cheapest (cost, audit) that leads from role ``entry`` to ``exit``; None if nothing does.

    ``rows`` holds a byte per row. With ``exit`` END the conversation ends behind the last row, else
    the last row written has to be ``exit``, and inserted rows belong to the row behind them.
    """
    bounds = suffix_bounds(rows, exit)
    if bounds[0] >= NEVER:
        return None
    found = _search(rows, entry, exit, bounds, bounds[0] + SWITCH)
    # Where no role leads to another (nothing written, or a system row, has to come out) the first
    # limit may be too low.
    return found or (_search(rows, entry, exit, bounds, NEVER) if exit in (START, SYSTEM) else None)


def _search(
    rows: bytes, entry: int, exit: int, bounds: list[int], limit: int
) -> tuple[int, str] | None:
    n = len(rows)
    ends = (START, ASSISTANT) if exit == END else (exit,)
    # Only START leads to START, and only START and SYSTEM to SYSTEM.
    useful = (True, exit != START, exit not in (START, SYSTEM), exit not in (START, SYSTEM))
    incumbent: tuple[int, str] | None = None
    cheapest = [NEVER] * (4 * n + 4)  # the dominance table of every node
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        row, last, cost, depth, edit = stack.pop()
        del path[depth:]
        path.append(edit)
        node = 4 * row + last
        if cost + bounds[row] > limit or cheapest[node] <= cost or not useful[last]:
            continue
        cheapest[node] = cost
        depth += 1
        if row == n:
            if last in ends:
                incumbent = cost, "".join(path)
                limit = cost - 1  # what comes later at the same cost is greater in ASCII
            elif exit == END:
                stack.append((row, NEXT[last], cost + INSERT, depth, "I"))
            continue
        code = rows[row]
        if not code & (BLANK | REPEATED):
            spoilt = cost + (TRUNCATED if code & CUT else 0)
            stack.append((row + 1, NEXT[last], spoilt + RENAME, depth, "R"))
            kept = KEPT[last][code & 3]
            if kept is not None:
                stack.append((row + 1, kept, spoilt, depth, "K"))
        stack.append((row, NEXT[last], cost + INSERT, depth, "I"))
        stack.append((row + 1, last, cost + DELETE, depth, "D"))
    return incumbent


_remembered = lru_cache(maxsize=200_000)(search)


def cheapest(rows: bytes, entry: int = START, exit: int = END) -> tuple[int, str] | None:
    """``search``, remembered for short segments."""
    return (_remembered if len(rows) <= REMEMBERED_ROWS else search)(rows, entry, exit)


def chain(table: list[list[list[int]]], ranks: list[list[list[int]]]) -> list[tuple[int, int]]:
    """The (entry, exit) of every segment on the cheapest way through all of them.

    ``table[k][entry][exit]`` is the cost of segment k and ``ranks`` the place of its audit among
    those from the same entry, in ASCII order; in the last segment only exit 0 counts. No audit of a
    segment begins another from the same entry, so the first segment that differs decides.
    """
    behind = [row[0] for row in table[-1]]
    exits: list[list[int]] = []
    for costs, order in zip(reversed(table[:-1]), reversed(ranks[:-1]), strict=True):
        ways = [
            min((min(costs[q][x] + behind[x], NEVER), order[q][x], x) for x in range(4))
            for q in range(4)
        ]
        behind = [w[0] for w in ways]
        exits.append([w[2] for w in ways])
    way, at = [], START
    for choice in reversed(exits):
        way.append((at, choice[at]))
        at = choice[at]
    return [*way, (at, END)]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn``, modulo 20.

    0 marks a row as ``gone``, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats
    the row, 4 makes it the user's. A missing value counts as one space, but conv_id and turn stay
    missing in the result.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (kind == 0).alias("gone"),
        F.explode(times).alias("copy"),
    ).drop("copy")


def _described(rows: DataFrame, gone: str | None) -> DataFrame:
    """(conv_id, turn, key, code, role, text), the columns the steps below work with."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    tail = F.substring(F.rtrim(text, F.lit(_SPACE)), -1, 1)
    initial = F.substring(role, 1, 1)
    code = F.lit(3)
    for k, letter in enumerate(INITIALS):
        code = F.when(initial == letter, k).otherwise(code)
    code += F.when(tail == "", BLANK).when(tail.isin(".", "!", "?"), 0).otherwise(CUT)
    if gone:
        code += F.when(F.col(gone), GONE).otherwise(0)
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.left(whole, F.lit(32))).alias("key"),
        code.cast("int").alias("code"),
        role.alias("role"),
        text.alias("text"),
    )


_SEGMENT_FIELDS = (
    "seg bigint, n bigint, codes binary, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, head int, tail int, turns bigint, low bigint, high bigint"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _segment_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Segments of (position, code, turn) lists; a code of -1 marks the first row with its key."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    position, code = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    turn = flat.field(2).fill_null(0).to_numpy(zero_copy_only=False)
    dated = flat.field(2).is_valid().to_numpy(zero_copy_only=False)
    mark = code < 0
    first = np.zeros(len(code), bool)
    first[1:] = mark[:-1]  # a mark stands right before its row
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    starts = position[offsets[:-1]]
    here = ~mark & (code & GONE == 0)
    code, turn, dated, owner, first = (x[here] for x in (code, turn, dated, owner, first))
    blank = code & BLANK != 0
    repeated = ~blank & ~first
    code = np.where(repeated, (code | REPEATED) & ~CUT, code)
    initial = code & 3
    same = np.zeros(len(code), bool)
    same[1:] = owner[1:] == owner[:-1]
    before = np.roll(initial, 1)
    # System before user, user before assistant, assistant before user.
    sound = ((initial == 1) & (before != 1) & (before != 3)) | ((initial == 2) & (before == 1))
    new_turn = dated & ~(same & (turn == np.roll(turn, 1)) & np.roll(dated, 1))
    size = len(lists)
    n = np.bincount(owner, minlength=size)
    ends = np.cumsum(n)
    raw = code.astype(np.uint8).tobytes()

    def total(flags: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(owner, flags, size).astype(np.int64))

    some = n > 0
    head, tail = np.zeros(size, np.int32), np.zeros(size, np.int32)
    head[some], tail[some] = initial[(ends - n)[some]], initial[ends[some] - 1]
    low, high = np.full(size, NEVER), np.full(size, -NEVER)
    np.minimum.at(low, owner[dated], turn[dated])
    np.maximum.at(high, owner[dated], turn[dated])
    undated = np.bincount(owner, dated, size) == 0
    columns = [
        batch.column(0),
        pa.array(starts.astype(np.int64)),
        pa.array(n.astype(np.int64)),
        pa.array([raw[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
        total(blank),
        total(repeated),
        total(code & CUT != 0),
        total(same & ~sound),
        pa.array(head, mask=~some),
        pa.array(tail, mask=~some),
        total(new_turn),
        pa.array(low, mask=undated),
        pa.array(high, mask=undated),
    ]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", *_names(_SEGMENT_FIELDS)])


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _segments(rows: DataFrame) -> DataFrame:
    """One row per conversation and segment, with what its rows say about each other."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = stored(
        rows.select("conv_id", "turn", "key", "code")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("position", F.monotonically_increasing_id()),
        "turns",
    )
    firsts = (
        dealt.where(F.col("code").bitwiseAND(GONE) == 0)
        .groupBy("conv_id", "key")
        .agg(F.min("position").alias("position"))
    )
    marked = dealt.select("conv_id", "position", "code", "turn").unionByName(
        firsts.select(
            "conv_id", "position", F.lit(-1).alias("code"), F.lit(None).cast("long").alias("turn")
        )
    )
    listed = marked.groupBy("conv_id", F.shiftright("position", SEGMENT_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("position", "code", "turn"))).alias("rows")
    )
    return listed.select("conv_id", "rows").mapInArrow(
        lambda batches: map(_segment_batch, batches), f"conv_id {kind}, {_SEGMENT_FIELDS}"
    )


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the costs from every role to every role, and the order of their audits."""
    for batch in batches:
        costs, ranks = [], []
        for codes, last in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
            cost, rank = [NEVER] * 16, [0] * 16
            for q in range(4):
                exits = (END,) if last else range(4)
                ways = [(x, cheapest(codes, q, x)) for x in exits]
                known = sorted((w[1], x % 4, w[0]) for x, w in ways if w)  # END takes place 0
                for k, (_, x, c) in enumerate(known):
                    cost[4 * q + x], rank[4 * q + x] = c, k
            costs.append(cost)
            ranks.append(rank)
        columns = [*(batch.column(k) for k in (0, 1)), pa.array(costs), pa.array(ranks)]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seg", "costs", "ranks"])


def _chained(segments: pd.DataFrame) -> pd.DataFrame:
    segments = segments.sort_values("seg")
    tables, ranks = (
        [[list(map(int, row[4 * q : 4 * q + 4])) for q in range(4)] for row in segments[c]]
        for c in ("costs", "ranks")
    )
    way = chain(tables, ranks)
    return pd.DataFrame(
        {"seg": segments["seg"], "entry": [w[0] for w in way], "exit": [w[1] for w in way]}
    )


def repairs(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """One row per conversation: gaps, counts of faults, and cost and audit of its repair.

    ``rows`` has conv_id, turn, role and text; rows whose column ``gone`` is true only say that their
    conversation exists. A conversation's rows are taken by turn, missing turns first, and within
    one turn by a hash of role and text, which puts equal rows side by side. Missing roles and texts
    count as one space, rows without a conv_id are one conversation, other columns are never read.
    """
    return _repairs(_described(rows, gone))


def _repairs(described: DataFrame) -> DataFrame:
    ship(described.sparkSession)
    kind = described.schema["conv_id"].dataType.simpleString()
    by = Window.partitionBy("conv_id")
    so_far = by.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("tail", ignorenulls=True).over(so_far)
    # The pair across a border, and a turn that lies on both sides of it.
    sound = ((F.col("head") == 1) & before.isin(0, 2)) | ((F.col("head") == 2) & (before == 1))
    across = F.when(before.isNotNull() & F.col("head").isNotNull() & ~sound, 1).otherwise(0)
    held = F.when(F.col("low") == F.last("high", ignorenulls=True).over(so_far), 1).otherwise(0)
    segments = stored(
        _segments(described).select(
            *["conv_id", "seg", "codes", "low", "high", "blank", "duplicate", "truncated"],
            (F.col("illegal") + across).alias("illegal"),
            (F.col("turns") - held).alias("turns"),
            (F.count(F.lit(1)).over(by) == 1).alias("whole"),
            (F.col("seg") == F.max("seg").over(by)).alias("last"),
        ),
        "segments",
    )
    parts = segments.where(~F.col("whole"))
    ways = (
        parts.select("conv_id", "seg", "codes", "last")
        .mapInArrow(_tabled, f"conv_id {kind}, seg bigint, costs array<bigint>, ranks array<bigint>")
        .groupBy("conv_id")
        .applyInPandas(_chained, "seg bigint, entry bigint, exit bigint")
    )
    role = {"entry": F.lit(START).cast("long"), "exit": F.lit(END).cast("long")}
    planned = segments.where("whole").withColumns(role).unionByName(parts.join(ways, "seg"))
    kept = ["conv_id", "seg", "low", "high", "turns", *_COUNTS]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*(batch.column(len(kept) + k).to_pylist() for k in range(3)), strict=True)
            found = [cheapest(*a) for a in asked]
            columns = [batch.column(k) for k in range(len(kept))]
            columns += [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "cost", "audit"])

    schema = planned.select(kept).schema.add("cost", "long").add("audit", "string")
    audits = F.sort_array(F.collect_list(F.struct("seg", "audit")))
    gaps = F.max("high") - F.min("low") + 1 - F.sum("turns")
    return (
        planned.select(*kept, "codes", "entry", "exit")
        .mapInArrow(solved, schema)
        .groupBy("conv_id")
        .agg(
            F.coalesce(gaps, F.lit(0)).alias("gaps"),
            *[F.sum(c).alias(c) for c in (*_COUNTS, "cost")],
            F.array_join(F.transform(audits, lambda s: s["audit"]), "").alias("audit"),
        )
    )


class _Writer:
    """Applies an audit to rows that come one by one."""

    def __init__(self, audit: str):
        self._edits = iter(audit)
        self._last = START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        """Rows inserted here; ends behind the first other edit, which it leaves in ``edit``."""
        for self.edit in self._edits:
            if self.edit != "I":
                return
            self._last = NEXT[self._last]
            yield ROLES[self._last], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        if self.edit == "K":
            self._last = KEPT[self._last][INITIALS.index(role[0])]
            yield role, text
        elif self.edit == "R":
            self._last = NEXT[self._last]
            yield ROLES[self._last], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _in_order(described: DataFrame, found: DataFrame) -> DataFrame:
    """All rows of each conversation, its row of ``found`` before them, in one task each."""
    lines = described.where(F.col("code").bitwiseAND(GONE) == 0).drop("code")
    together = found.withColumn("_own", F.lit(0)).unionByName(
        lines.withColumn("_own", F.lit(1)), allowMissingColumns=True
    )
    nulls_first = [F.col(c).asc_nulls_first() for c in ("conv_id", "_own", "turn")]
    return together.repartition("conv_id").sortWithinPartitions(*nulls_first, "key")


def repaired_rows(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text), ``place`` counting from 0.

    Conversations of which nothing is left have no rows.
    """
    described = _described(rows, gone)
    ordered = _in_order(described, _repairs(described).select("conv_id", "audit"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, conv, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def add(lines: Iterator[tuple[str, str]]) -> None:
                nonlocal place
                for role, text in lines:
                    out.append((conv, place, role, text))
                    place += 1

            for own, key, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == 0:
                    if writer:
                        add(writer.end())
                    writer, conv, place = _Writer(audit), key, 0
                else:
                    add(writer.row(role, text))
            yield _batch(out, batch.schema.field(1).type)
        if writer:
            out = []
            add(writer.end())
            yield _batch(out, batch.schema.field(1).type)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [kind, pa.int64(), pa.string(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "role", "text"])

    schema = f"conv_id {kind}, place bigint, role string, text string"
    return ordered.select("_own", "conv_id", "audit", "role", "text").mapInArrow(written, schema)


def repair_digests(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """``repairs`` with ``repaired_sha256``, of the repaired ``role:text`` lines joined by newlines."""
    described = _described(rows, gone)
    found = _repairs(described)
    ordered = _in_order(described, found)
    kept = found.columns
    names = [*kept, "repaired_sha256"]
    schema = found.schema.add("repaired_sha256", "string")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, digest, between, pending = None, None, b"", None

        def add(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal between
            for role, text in lines:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"

        def finished() -> list[pa.Array]:
            add(writer.end())
            return [*pending, pa.array([digest.hexdigest()])]

        for batch in batches:
            done = []
            own, audits, roles, texts = (batch.column(k).to_pylist() for k in range(4))
            for k, (kind, audit, role, text) in enumerate(zip(own, audits, roles, texts, strict=True)):
                if kind == 0:
                    if writer:
                        done.append(finished())
                    pending = [c.slice(k, 1) for c in batch.columns[4:]]
                    writer, digest, between = _Writer(audit), hashlib.sha256(), b""
                else:
                    add(writer.row(role, text))
            if done:
                arrays = [pa.concat_arrays(c) for c in zip(*done, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)
        if writer:
            yield pa.RecordBatch.from_arrays(finished(), names)

    columns = ["_own", F.col("audit").alias("_audit"), "role", "text", *kept]
    return ordered.select(*columns).mapInArrow(digested, schema)
