"""Interval parsing against enumeration of edits, and whole conversations against a plain pass."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from fieldspark.llm import conversations as cv

SPACE = " \t\n\v\f\r"
SHAPE = "conv_id long, turn long, role string, text string, audit string"


def _enumerated(symbols):
    """Cheapest (cost, audit) of all edits with up to two insertions a gap."""
    gaps = [(0, "", ""), (2, "I", "u"), (2, "I", "a"), (4, "II", "ua"), (4, "II", "au")]
    found = []
    rows = []
    for s in symbols:
        options = [(3, "D", "")]
        if s != "x":
            extra = s.isupper()
            options += [(extra, "K", s.lower()), (2 + extra, "R", "u"), (2 + extra, "R", "a")]
        rows += [options, gaps]
    for parts in itertools.product(gaps, *rows):
        if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in parts)):
            found.append((sum(p[0] for p in parts), "".join(p[1] for p in parts)))
    return min(found)


def test_cells_equal_enumeration():
    rng = random.Random(6)
    texts = ["".join(x) for n in (1, 2) for x in itertools.product("xsuaoSUAO", repeat=n)] + ["".join(rng.choice("xsuaoSUA") for _ in range(3)) for _ in range(12)]
    for symbols in texts:
        assert cv.best(cv.cell(symbols)) == _enumerated(symbols), symbols


def test_every_split_gives_the_same_cell():
    rng = random.Random(7)
    for _ in range(60):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(2, 25)))
        rows = [cv.row_cell(s) for s in symbols]
        chart = {(i, i + 1): row for i, row in enumerate(rows)}
        for length in range(2, len(rows) + 1):  # the whole chart, all splits
            for i in range(len(rows) - length + 1):
                cell = {}
                for k in range(i + 1, i + length):
                    for key, made in cv.joined(chart[i, k], chart[k, i + length]).items():
                        cell[key] = min(cell.get(key, made), made)
                chart[i, i + length] = cell
        assert cv.cell(symbols) == chart[0, len(rows)]


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def _plain(rows, damage=True):
    out = []
    damaged = _damage(rows) if damage else rows
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append("x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        # row by row over the states of the pattern
        states = {0: (0, "")}
        for s in symbols:
            after = {}
            for p, (cost, audit) in states.items():
                for (a, b), (c, x) in cv.row_cell(s).items():
                    if a == p:
                        made = (cost + c, audit + x)
                        after[b] = min(after.get(b, made), made)
            states = after
        cost, audit = min(v for q, v in states.items() if q in (0, 3))
        lines, rest, was = [], iter(own), ""
        for e in audit:
            _, _, role, text = (0, 0, "", "") if e == "I" else next(rest)
            if e != "D":
                role = role if e == "K" else "assistant" if was == "u" else "user"
                lines.append(f"{role}:{text}")
                was = role[:1]
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def _found(spark, rows):
    return sorted(map(tuple, cv.repair(cv.damaged(spark.createDataFrame([(*r, "x") for r in rows], SHAPE))).collect()), key=repr)


def test_conversations_equal_plain_pass(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice([*range(30), None]), rng.choice([*range(12), None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", " ", "", None, "Why?\n", "\u0085", "done! ", "a. b"]))
        for _ in range(400)
    ]
    assert _found(spark, rows) == _plain(rows)


def test_a_long_conversation_in_many_pieces(spark):
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), f"{rng.choice(['Yes', 'No', 'Maybe', i])}{rng.choice('. ')}") for i in range(3000)] + [(8, i, "user", "Same.") for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _found(spark, rows) == _plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_rows_gone_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert _found(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SHAPE)
    assert cv.repair(cv.damaged(empty)).collect() == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "user", "Hi.", 1), (1, 2, "bot", "Yes.", 1), (2, 0, "assistant", "So.", 1)], "conv_id long, turn long, role string, text string, n long")
    got = sorted(map(tuple, cv.repaired(rows).collect()))
    assert got == [(1, 0, "K", 0, "user", "Hi."), (1, 1, "R", 2, "assistant", "Yes."), (2, 0, "I", None, "user", ""), (2, 1, "K", 0, "assistant", "So.")]
