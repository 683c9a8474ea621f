"""Repair of conversations by the cheapest edits, found by iterative-deepening A*.

The role initials of a repaired conversation read ``(s?(ua)+)?``. Every row is kept
(0), given the role that is due (3) or deleted (4); a row with an empty text may be
inserted before any row and at the end (3). Blank and repeated rows must be deleted,
a truncated row that stays adds 3. Depth-first search tries Delete, Insert, Keep,
Rerole in this, the ASCII, order of their initials below a cost bound that grows to
the least cost that exceeded it, so the first accepting path is the cheapest and of
those the ASCII-least. A table holds what a failed state (row, role due) was shown
to cost at least, and cuts every later visit that cannot stay below the bound.

A conversation may hold most of the rows. Rows are range-partitioned and cut into
blocks of neighbours; a block that is a whole conversation is searched from start
to acceptance, any other from each role due at its start to each at its end. A fold
over those costs, 80 bytes a block, picks each block's path. Ids of one conversation
meet in one task only to read the rows once, in order and as a stream.

NULLs in any column count as one space, a NULL conversation is a conversation. Rows
go by turn, NULLs first, then role and text, so repeated and tied rows have one
order. A conversation without rows has costs 0 and an empty audit. Other columns are
not looked at. An audit is one cell, so a conversation is bound to 2**31 edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.functions.storage import materialize
from panelweave.llm.workers import bounded, ship

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Roles due: at the start (a system or user row), then after a system, user, assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
BLOCK = 128
FAR = 1 << 30
BLANK = r"^[\x20\x09-\x0D]*$"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"

#: The role an edit gives at each role due, and the state it leads to.
_DUE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_KEEP = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}


class Block:
    """Neighbouring rows of one conversation: role initials and faults, a letter per row.

    Faults: ``b`` blank, ``d`` duplicate, ``t`` truncated, ``.`` none.
    """

    def __init__(self, roles: str, faults: str):
        self.roles, self.faults = roles, faults
        floor = [0]
        for role, fault in zip(reversed(roles), reversed(faults)):
            floor.append(floor[-1] + self.least(role, fault))
        #: What the rows from each place on cost at least, whatever role is due.
        self.floor = floor[::-1]

    @staticmethod
    def least(role: str, fault: str) -> int:
        if fault in "bd":
            return DELETE
        kept = (TRUNCATED if fault == "t" else 0) + (0 if role in "sua" else REROLE)
        return min(DELETE, kept)

    def steps(self, row: int, due: int, last: bool) -> Iterator[tuple[str, int, int, int]]:
        """``(edit, cost, next row, role due)`` in ASCII order of the edits."""
        if row == len(self.roles):
            if last:
                yield "I", INSERT, row, _DUE[due][1]
            return
        role, fault = self.roles[row], self.faults[row]
        yield "D", DELETE, row + 1, due
        yield "I", INSERT, row, _DUE[due][1]
        if fault not in "bd":
            extra = TRUNCATED if fault == "t" else 0
            if (due, role) in _KEEP:
                yield "K", extra, row + 1, _KEEP[due, role]
            yield "R", REROLE + extra, row + 1, _DUE[due][1]

    def search(self, due: int, ends: tuple[int, ...], last: bool) -> tuple[int, str] | None:
        """Cost and edits of the cheapest, then ASCII-least path to one of ``ends``.

        Edits after the last row are tried only in the ``last`` block, so an
        insertion belongs to the block of the row that it precedes.
        """
        n = len(self.roles)
        early = all(end in (START, SYSTEM) for end in ends)

        def least_left(row: int, state: int) -> int:
            # To end before any user row, all rows but at most a system one must go.
            if not early:
                return self.floor[row]
            if state in (USER, ASSISTANT) or (state == SYSTEM and START in ends):
                return FAR
            return DELETE * max(0, n - row - (state == START and SYSTEM in ends))

        shown: dict[tuple[int, int], int] = {}
        bound = least_left(0, due)
        most = DELETE * n + INSERT * (n + 4) + (REROLE + TRUNCATED) * n
        while bound <= most:
            # One frame per edit on the path: state, cost so far, its steps, least cost seen beyond.
            path: list[str] = []
            frames = [(0, due, 0, self.steps(0, due, last), [FAR])]
            if n == 0 and due in ends:
                return 0, ""
            while frames:
                row, state, cost, steps, beyond = frames[-1]
                for edit, price, next_row, next_state in steps:
                    spent = cost + price
                    left = shown.get((next_row, next_state)) or least_left(next_row, next_state)
                    if spent + left > bound:
                        beyond[0] = min(beyond[0], price + left)
                        continue
                    path.append(edit)
                    if next_row == n and next_state in ends:
                        return spent, "".join(path)
                    frames.append((next_row, next_state, spent, self.steps(next_row, next_state, last), [FAR]))
                    break
                else:
                    frames.pop()
                    at = (row, state)
                    shown[at] = max(shown.get(at, 0), beyond[0])
                    if frames:
                        path.pop()
                        above = frames[-1]
                        above[4][0] = min(above[4][0], cost - above[2] + beyond[0])
            bound = max(bound + 1, shown[0, due])
        return None


ACCEPTING = (START, ASSISTANT)


def search_block(roles: str, faults: str, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Costs, ASCII ranks and edits from each role due to each, 4 x 4, ``FAR`` where none leads.

    A first block is entered at the start only; a last block is left in any accepting
    state, which is noted as the state at its start.
    """
    block = Block(roles, faults)
    costs, ranks = np.full(16, FAR, np.int32), np.zeros(16, np.int8)
    edits = [""] * 16
    for due in (START,) if first else range(4):
        for end in (START,) if last else range(4):
            found = block.search(due, ACCEPTING if last else (end,), last)
            if found is not None:
                costs[4 * due + end], edits[4 * due + end] = found
        own = slice(4 * due, 4 * due + 4)
        ranks[own] = np.argsort(np.argsort(edits[own], kind="stable"), kind="stable")
    return costs, ranks, edits


def fold(costs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The cell (start, end) of the 4 x 4 that each block of a conversation takes, in order."""
    blocks = len(costs)
    togo = np.full((blocks + 1, 4), FAR, np.int64)
    togo[blocks, START] = 0
    for number in range(blocks - 1, -1, -1):
        togo[number] = (costs[number].reshape(4, 4) + togo[number + 1]).min(axis=1)
    chosen, due = np.zeros(blocks, np.int32), START
    for number in range(blocks):
        total = costs[number].reshape(4, 4)[due] + togo[number + 1]
        best = np.flatnonzero(total == total.min())
        end = int(min(best, key=lambda one: ranks[number][4 * due + one]))
        chosen[number], due = 4 * due + end, end
    return chosen


def prepared(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turn, role, text)``; a NULL role or text is one space."""
    space = F.lit(" ")
    return conversations.select(
        named(conv).alias("conv"),
        named(turn).alias("turn"),
        F.coalesce(named(role).cast("string"), space).alias("role"),
        F.coalesce(named(text).cast("string"), space).alias("text"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of :func:`prepared` with faults drawn by a checksum of conversation and turn.

    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes
    its role user.
    """
    place = F.concat_ws(
        ":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv", "turn")]
    )
    dice = F.crc32(place.cast("binary")) % 20
    return (
        rows.withColumn("dice", dice)
        .where("dice <> 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("dice") == 3, 2).otherwise(1))))
        .select(
            "conv",
            "turn",
            F.when(F.col("dice") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("dice") == 1, "")
            .when(F.col("dice") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
        )
    )


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order under ``(part, row)``, written once so that places stay as they are."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(
        ordered.withColumns({"part": F.spark_partition_id(), "row": in_part}), "turns"
    )


def initial(role: Column) -> Column:
    return F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")


def blocks_of(rows: DataFrame) -> DataFrame:
    """``(conv, part, start, roles, faults, is_first, is_last)`` of :func:`placed` rows.

    ``(part, start)`` is the place of a block's first row. A row is a duplicate unless
    it is the first with its role and text: those firsts are found by a group-by that
    combines map-side and joined by place, a unique key.
    """
    words = F.struct("role", F.unhex(F.sha2("text", 256)))
    firsts = (
        rows.groupBy("conv", words.alias("words"))
        .agg(F.min(F.struct("part", "row")).alias("at"))
        .select("at.part", "at.row", F.lit(True).alias("is_new"))
    )
    marked = rows.select(
        "conv",
        "part",
        "row",
        initial(F.col("role")).alias("role"),
        F.when(F.col("text").rlike(BLANK), "b").alias("blank"),
        F.when(F.col("text").rlike(CUT), "t").otherwise(".").alias("cut"),
    ).join(firsts, ["part", "row"], "left")
    fault = F.coalesce("blank", F.when(F.col("is_new").isNull(), "d"), F.col("cut"))
    letters = F.sort_array(F.collect_list(F.struct("row", "role", fault.alias("fault"))))
    found = (
        marked.groupBy("conv", "part", F.floor(F.col("row") / BLOCK).alias("block"))
        .agg(F.min("row").alias("start"), letters.alias("letters"))
        .select(
            "conv",
            "part",
            "start",
            F.array_join("letters.role", "").alias("roles"),
            F.array_join("letters.fault", "").alias("faults"),
        )
    )
    at = F.struct("part", "start")
    bounds = found.groupBy(F.col("conv").alias("of")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return found.join(bounds, F.col("conv").eqNullSafe(F.col("of"))).select(
        *found.columns, (at == F.col("first")).alias("is_first"), (at == F.col("last")).alias("is_last")
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"costs": pa.binary(), "ranks": pa.binary(), "edits": pa.list_(pa.string())}
    for batch in batches:
        out: dict[str, list] = {name: [] for name in kinds}
        for roles, faults, first, last in zip(
            *[batch.column(name).to_pylist() for name in ("roles", "faults", "is_first", "is_last")]
        ):
            costs, ranks, edits = search_block(roles, faults, first, last)
            out["costs"].append(costs.tobytes())
            out["ranks"].append(ranks.tobytes())
            out["edits"].append(edits)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(out[name], kind) for name, kind in kinds.items()]],
            [*batch.schema.names, *kinds],
        )


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "start"])
    costs = np.frombuffer(b"".join(rows["costs"]), np.int32).reshape(-1, 16)
    ranks = np.frombuffer(b"".join(rows["ranks"]), np.int8).reshape(-1, 16)
    return rows[["part", "start"]].assign(cell=fold(costs, ranks))


def audits_of(blocks: DataFrame) -> DataFrame:
    """``(conv, part, start, faults, due, edits)``: the path that each block takes."""
    kind = blocks.schema["conv"].dataType.simpleString()
    searched = materialize(
        blocks.mapInArrow(
            _search,
            f"conv {kind}, part int, start long, roles string, faults string, is_first boolean, "
            "is_last boolean, costs binary, ranks binary, edits array<string>",
        ),
        "searched",
    )
    whole = F.col("is_first") & F.col("is_last")
    cells = (
        searched.where(~whole)
        .groupBy("conv")
        .applyInPandas(_fold, "part int, start long, cell int")
        .withColumnsRenamed({"part": "of_part", "start": "of_start"})
    )
    same = (F.col("part") == F.col("of_part")) & (F.col("start") == F.col("of_start"))
    return searched.join(cells, same, "left").select(
        "conv",
        "part",
        "start",
        "faults",
        F.floor(F.coalesce("cell", F.lit(0)) / 4).cast("int").alias("due"),
        F.col("edits")[F.coalesce("cell", F.lit(0))].alias("edits"),
    )


class Walk:
    """One conversation read in order: what its edits give, and its counts."""

    def __init__(self, conv, gaps: int):
        self.conv, self.gaps = conv, gaps
        self.faults = {"b": 0, "d": 0, "t": 0, ".": 0}
        self.illegal = self.cost = self.written = 0
        self.audit: list[str] = []
        self.before: str | None = None
        self.due, self.edits, self.block_faults, self.at, self.row = START, "", "", 0, 0
        self.digest = hashlib.sha256()

    def enter(self, faults: str, due: int, edits: str) -> None:
        self.due, self.edits, self.block_faults, self.at, self.row = due, edits, faults, 0, 0
        self.audit.append(edits)
        for fault in faults:
            self.faults[fault] += 1

    def write(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written += 1
        return self.conv, self.written - 1, edit, role, text

    def insertions(self) -> Iterator[tuple]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            role, self.due = _DUE[self.due]
            self.cost, self.at = self.cost + INSERT, self.at + 1
            yield self.write("I", role, "")

    def read(self, role: str, text: str) -> Iterator[tuple]:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        yield from self.insertions()
        edit, fault = self.edits[self.at], self.block_faults[self.row]
        self.at, self.row = self.at + 1, self.row + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED if fault == "t" else 0
        if edit == "R":
            role, self.due = _DUE[self.due]
            self.cost += REROLE
        else:
            self.due = _KEEP[self.due, role[:1]]
        yield self.write(edit, role, text)

    def summary(self) -> tuple:
        return (
            self.conv, self.gaps, self.faults["b"], self.faults["d"], self.faults["t"],
            self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest(),
        )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, tuple | None]]:
    """``(repaired row, None)`` for each, ``(None, summary)`` after each conversation."""
    now: Walk | None = None
    for batch in bounded(batches, "text"):
        for conv, kind, role, text, due, edits, faults, gaps in zip(
            *[batch.column(name).to_pylist() for name in _STREAM]
        ):
            if kind == 2:
                yield from ((row, None) for row in now.read(role, text))
            elif kind == 1:
                now.enter(faults, due, edits)
            else:
                if now is not None:
                    yield from ((row, None) for row in now.insertions())
                    yield None, now.summary()
                now = Walk(conv, gaps)
    if now is not None:
        yield from ((row, None) for row in now.insertions())
        yield None, now.summary()


_STREAM = ("conv", "kind", "role", "text", "due", "edits", "faults", "gaps")


def _batched(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += 64 + sum(len(cell) for cell in row if isinstance(cell, str))
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), schema.types)), schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), schema.types)), schema=schema)


@dataclass
class Repaired:
    """Conversations and their edits as one table, read in order by each result."""

    steps: DataFrame
    conv: str

    def _stream(self) -> tuple[DataFrame, str, pa.DataType]:
        order = ["conv", "part", "row", "kind"]
        ordered = self.steps.repartition("conv").sortWithinPartitions(*order).select(*_STREAM)
        field = self.steps.schema["conv"]
        number = field.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
        return ordered, field.dataType.simpleString(), pa.int64() if number else pa.string()

    def rows(self) -> DataFrame:
        """``(conv, place, edit, role, text)`` of the repaired conversations."""
        ordered, kind, arrow = self._stream()
        schema = pa.schema(
            [("conv", arrow), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        )

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batched((row for row, _ in _walk(batches) if row is not None), schema)

        out = ordered.mapInArrow(give, f"conv {kind}, place long, edit string, role string, text string")
        return out.withColumnRenamed("conv", self.conv)

    def summaries(self) -> DataFrame:
        """One row per conversation: gaps, faults, cost, audit, and the digest of its repaired rows."""
        ordered, kind, arrow = self._stream()
        longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        texts = ["audit", "repaired_sha256"]
        schema = pa.schema(
            [("conv", arrow), *[(name, pa.int64()) for name in longs], *[(name, pa.string()) for name in texts]]
        )

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batched((end for _, end in _walk(batches) if end is not None), schema)

        columns = [f"conv {kind}", *[f"{name} long" for name in longs], *[f"{name} string" for name in texts]]
        return ordered.mapInArrow(give, ", ".join(columns)).withColumnRenamed("conv", self.conv)


def repair(rows: DataFrame, every: DataFrame | None = None, conv: str = "conv_id") -> Repaired:
    """Repair the conversations in ``rows`` of :func:`prepared`.

    ``every`` may bring conversations (a column ``conv``) that have no rows left.
    """
    ship(rows.sparkSession)
    at = placed(rows)
    audits = audits_of(blocks_of(at))
    turn = F.col("turn").cast("long")
    ids = at.select("conv", turn.alias("turn"))
    if every is not None:
        ids = ids.unionByName(every.select("conv", F.lit(None).cast("long").alias("turn")))
    gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    heads = ids.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    steps = (
        at.select("conv", "part", "row", F.lit(2).alias("kind"), "role", "text")
        .unionByName(
            audits.select("conv", "part", F.col("start").alias("row"), F.lit(1).alias("kind"), "due", "edits", "faults"),
            allowMissingColumns=True,
        )
        .unionByName(
            heads.select("conv", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("row"), F.lit(0).alias("kind"), "gaps"),
            allowMissingColumns=True,
        )
    )
    return Repaired(steps, conv)
