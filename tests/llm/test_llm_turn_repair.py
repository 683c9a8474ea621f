"""Repaired conversations against all edit sequences, and against a plain table of best prefixes."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from panelweave.llm import turn_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
PRICE = {"D": 4, "I": 3, "K": 0, "R": 3}


def every_repair(roles, faults, most):
    """Least (cost, edits) over all sequences of edits up to ``most``, straight from the grammar."""
    best = None
    rows = len(roles)
    for inserted in itertools.product(range(3), repeat=rows + 1):
        for edits in itertools.product("DKR", repeat=rows):
            for given in itertools.product("ua", repeat=sum(inserted) + edits.count("R")):
                spare, audit, out, cost = iter(given), "", "", 0
                for at in range(rows + 1):
                    for _ in range(inserted[at]):
                        audit, out, cost = audit + "I", out + next(spare), cost + 3
                    if at == rows:
                        break
                    edit, fault = edits[at], faults[at]
                    if edit != "D" and fault in "bd":
                        cost = most + 1
                    audit, cost = audit + edit, cost + PRICE[edit]
                    if edit != "D":
                        out += next(spare) if edit == "R" else roles[at]
                        cost += 3 if fault == "t" else 0
                if cost <= most and GRAMMAR.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def best_prefixes(roles, faults):
    """The same by a table of the least (cost, edits) for each role due."""
    due = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": ""}, "": {}}
    due = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    table = {0: (0, "")}

    def insert(table):
        for _ in range(4):
            for state, (cost, audit) in list(table.items()):
                for given, after in due[state].items():
                    if given != "s":
                        table[after] = min(table.get(after, (999999, "")), (cost + 3, audit + "I"))

    for role, fault in zip(roles, faults):
        insert(table)
        step = {}
        for state, (cost, audit) in table.items():
            options = [(state, 4, "D")]
            if fault not in "bd":
                extra = 3 if fault == "t" else 0
                if role in due[state]:
                    options.append((due[state][role], extra, "K"))
                options += [(after, 3 + extra, "R") for given, after in due[state].items() if given != "s"]
            for after, price, edit in options:
                step[after] = min(step.get(after, (999999, "")), (cost + price, audit + edit))
        table = step
    insert(table)
    return min(table[state] for state in (0, 3) if state in table)


def test_search_against_every_sequence():
    draw = random.Random(5)
    cases = [("", ""), ("s", "."), ("a", "t"), ("x", "."), ("u", "b")]
    cases += [
        ("".join(draw.choice("suax") for _ in range(3)), "".join(draw.choice("..tbd") for _ in range(3)))
        for _ in range(6)
    ]
    for roles, faults in cases:
        found = turn_repair.Block(roles, faults).search(turn_repair.START, turn_repair.ACCEPTING, True)
        assert found == every_repair(roles, faults, 4 * len(roles)) == best_prefixes(roles, faults)


@pytest.mark.parametrize("n", [4, 9, 40, 130, 300])
def test_blocks_compose_to_the_whole(n):
    draw = random.Random(n)
    for _ in range(12):
        roles = "".join(draw.choice("uaxs") if draw.random() < 0.3 else "ua"[i % 2] for i in range(n))
        faults = "".join(draw.choice("bdt" + 9 * ".") for _ in range(n))
        wanted = best_prefixes(roles, faults)
        found = turn_repair.Block(roles, faults).search(turn_repair.START, turn_repair.ACCEPTING, True)
        assert found == wanted
        cuts = [0, *sorted(draw.sample(range(1, n), min(3, n - 1))), n]
        parts = [
            turn_repair.search_block(roles[a:b], faults[a:b], a == 0, b == n) for a, b in zip(cuts, cuts[1:])
        ]
        cells = turn_repair.fold(np.array([p[0] for p in parts]), np.array([p[1] for p in parts]))
        assert "".join(p[2][cell] for p, cell in zip(parts, cells)) == wanted[1]


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if one is None else str(one) for one in (conv, turn))
        dice = zlib.crc32(name.encode()) % 20
        if dice == 0:
            continue
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        row = (conv, turn, "user" if dice == 4 else role, text)
        yield from [row, row] if dice == 3 else [row]


def summary(conv, rows):
    """The contract for one conversation's rows after damage."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    rows = sorted(rows, key=key)
    turns = {r[1] for r in rows if r[1] is not None}
    seen, faults = set(), ""
    for _, _, role, text in rows:
        real = re.findall(r"[^\x20\x09-\x0D]", text)
        faults += "b" if not real else "d" if (role, text) in seen else "." if real[-1] in ".!?" else "t"
        seen.add((role, text))
    starts = [role[:1] for _, _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
    cost, audit = best_prefixes(starts, faults)
    out, due, at = [], "u", 0
    for edit in audit:
        if edit == "I":
            out.append({"u": "user:", "a": "assistant:"}[due])
            due = "ua"[due == "u"]
            continue
        _, _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        if edit == "R":
            role = {"u": "user", "a": "assistant"}[due]
        out.append(f"{role}:{text}")
        due = "ua"[role[0] == "u"]
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest), out


def awkward():
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(40)]
    rows += [(2, None, None, None), (2, None, "user", "a!"), (2, 3, "assistant", "b"), (2, 9, "tool", "c?")]
    rows += [(None, 0, "user", "lost."), (None, None, "assistant", "found."), (None, 1, "", "x.")]
    rows += [(4, t, "assistant", "same answer.") for t in range(9)]
    rows += [(5, 0, "system", "only."), (6, 2, "user", "tie."), (6, 2, "user", "tie."), (6, 2, "assistant", "tie.")]
    rows += [(7, 0, "user", "long " * 50_000 + "."), (7, 1, "assistant", "漢. "), (7, 2, "User", "\t\x0b ")]
    rows += [(8, t, "user" if t % 3 else "system", ["", "a.", "b"][t % 3] + str(t)) for t in range(700)]
    return rows + [(i, t, ("user", "assistant")[t % 2], f"{i} {t}!") for i in range(100, 160) for t in range(5)]


@pytest.fixture(scope="module")
def repaired(spark):
    table = spark.createDataFrame(
        [(*row, "n", 1) for row in awkward()],
        "conv_id long, turn long, role string, text string, part string, `a.b` int",
    )
    rows = turn_repair.prepared(table.repartition(5), "conv_id", "turn", "role", "text")
    return turn_repair.repair(turn_repair.damage(rows), every=rows)


def wanted():
    out = {}
    for conv, *_ in awkward():
        out[conv] = []
    for row in damaged(awkward()):
        out[row[0]].append(row)
    return {conv: summary(conv, rows) for conv, rows in out.items()}


def test_awkward_conversations_as_by_hand(repaired):
    found = {r["conv_id"]: tuple(r) for r in repaired.summaries().collect()}
    hand = wanted()
    assert set(found) == set(hand)
    for conv, (row, _) in hand.items():
        assert found[conv] == row


def test_repaired_rows(repaired):
    lines = {}
    for row in repaired.rows().collect():
        lines.setdefault(row["conv_id"], []).append((row["place"], f"{row['role']}:{row['text']}"))
    for conv, (_, out) in wanted().items():
        held = sorted(lines.get(conv, []))
        assert [place for place, _ in held] == list(range(len(out)))
        assert [line for _, line in held] == out


def test_conversations_that_lost_all_rows_and_empty_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    for rows in ([(gone, 0, "user", "x.")], []):
        table = turn_repair.prepared(spark.createDataFrame(rows, kind), "conv_id", "turn", "role", "text")
        found = turn_repair.repair(turn_repair.damage(table), every=table).summaries().collect()
        empty = hashlib.sha256(b"").hexdigest()
        assert [tuple(r) for r in found] == [(r[0], 0, 0, 0, 0, 0, 0, "", empty) for r in rows]


def test_a_conversation_over_many_parts(spark):
    """One conversation holds nearly all rows; its blocks lie in several partitions."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t % 997}.") for t in range(6000)]
    rows += [(i, 0, "user", "x.") for i in range(2, 30)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    prepared = turn_repair.prepared(table.repartition(6), "conv_id", "turn", "role", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = turn_repair.placed(turn_repair.damage(prepared))
        assert at.where("conv = 1").select("part").distinct().count() > 1
        repaired = turn_repair.repair(turn_repair.damage(prepared), every=prepared)
        found = {r["conv_id"]: tuple(r) for r in repaired.summaries().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[1] == summary(1, [r for r in damaged(rows) if r[0] == 1])[0]
