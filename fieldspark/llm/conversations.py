"""Conversation structure repair by weighted interval parsing.

A conversation's roles shall read ``(s?(ua)+)?``.  The repair grammar is in
Chomsky normal form: a symbol X(p, q) stands for the rows of an interval and
what is inserted between them, read from state p of that pattern to state q.
Its rules are X(p, r) -> X(p, q) X(q, r), and one for each edit of a row.  A
cell holds, for each symbol, the minimum (cost, audit) over the interval;
insertions are closed over in the cells of single rows.

Cells are combined bottom-up by interval length.  The rules are associative,
so every split of an interval yields the same cell and one is enough: 1, 2, 4
and more rows at a time, which takes time in proportion to the rows.  Minimum
audits may be joined, because no audit of equal cost over the same rows is a
prefix of another: it would have the same letter for each row and more I, each
of which costs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = range(4)
#: From a state by a role's initial: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPTED = (0, 3)
RULES = [(p, q, r) for p in STATES for q in STATES for r in STATES]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows whose cells are remembered by their symbols.
REMEMBERED = 8

_BLANK = r"\A[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FACTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")
_PIECE = "conv_id {kind}, first struct<turn:{turn},role:string,digest:string>, last_turn {turn}, least {turn}, most {turn}, first_initial string, last_initial string, " + ", ".join(f"{c} long" for c in _FACTS) + ", costs array<int>, audits array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """Test damage: ``conv_id, turn, role, text, n`` after the fault that crc32 of ``conv_id:turn`` modulo 20 deals.

    Nulls count as one space.  0 drops a row (n is 0), 1 empties its text, 2
    removes ``.!?``, 3 repeats it (n is 2), 4 makes its role user.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(name.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _inserted(p: int, q: int) -> int | None:
    """How many insertions lead from p to q, at least."""
    steps = 0
    while p != q:
        p, steps = (3 if p == 2 else 2), steps + 1
        if steps > 2:
            return None
    return steps


_CLOSURE = {(p, q): n for p in STATES for q in STATES if (n := _inserted(p, q)) is not None}


@lru_cache(maxsize=None)
def row_cell(symbol: str) -> dict:
    """The cell of one row.  A symbol is x (to be deleted), s, u, a or o (any other role), in capitals if truncated."""
    edits = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for (p, role), q in NEXT.items():
            options = [(KEEP + extra, "K")] if role == symbol.lower() else []
            if role != "s":
                options.append((REROLE + extra, "R"))
            for option in options:
                edits[p, q] = min(edits.get((p, q), option), option)
    out: dict = {}
    for (p, a), before in _CLOSURE.items():
        for (b, r), after in _CLOSURE.items():
            if (a, b) in edits:
                cost, letter = edits[a, b]
                made = (cost + INSERT * (before + after), "I" * before + letter + "I" * after)
                out[p, r] = min(out.get((p, r), made), made)
    return out


def joined(left: dict, right: dict) -> dict:
    """The cell of two neighbouring intervals."""
    out: dict = {}
    for p, q, r in RULES:
        if (p, q) in left and (q, r) in right:
            (c, x), (d, y) = left[p, q], right[q, r]
            made = (c + d, x + y)
            if (p, r) not in out or made < out[p, r]:
                out[p, r] = made
    return out


@lru_cache(maxsize=50_000)
def _short(symbols: str) -> dict:
    half = len(symbols) // 2
    return joined(_short(symbols[:half]), _short(symbols[half:])) if half else row_cell(symbols)


def combined(cells: list[dict]) -> dict:
    """The cell of consecutive intervals, neighbours first."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cell(symbols: str) -> dict:
    """The cell of all rows, given by their symbols."""
    return combined([_short(symbols[i : i + REMEMBERED]) for i in range(0, len(symbols), REMEMBERED)])


def best(found: dict) -> tuple[int, str]:
    return min(found[0, q] for q in ACCEPTED if (0, q) in found)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Piece:
    """What is known of consecutive rows of one conversation."""

    def __init__(self, key, first):
        self.key, self.first = key, first
        self.symbols: list[str] = []
        self.facts = dict.fromkeys(_FACTS, 0)
        self.least = self.most = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn, role, n, fresh, blank, truncated):
        if not n:  # dropped, yet the conversation is there
            return
        facts, initial = self.facts, role[:1]
        if turn is not None:
            facts["turns"] += self.last_turn is None or turn != self.last_turn
            self.least, self.most = (turn if self.least is None else self.least), turn
        facts["n_rows"] += n
        facts["illegal"] += (n - 1) * (not _legal(initial, initial)) + (self.last_initial is not None and not _legal(self.last_initial, initial))
        if self.first_initial is None:
            self.first_initial = initial
        self.last_turn, self.last_initial = turn, initial
        if blank:
            facts["blank"] += n
            self.symbols.append("x" * n)
            return
        facts["duplicate"] += n - fresh
        facts["truncated"] += fresh and truncated
        if fresh:
            symbol = initial if initial in ("s", "u", "a") else "o"
            self.symbols.append(symbol.upper() if truncated else symbol)
        self.symbols.append("x" * (n - fresh))

    def row(self) -> tuple:
        symbols = "".join(self.symbols)
        found = cell(symbols) if symbols else {}
        cells = [found.get((p, q)) for p in STATES for q in STATES]
        return (
            self.key, self.first, self.last_turn, self.least, self.most, self.first_initial, self.last_initial, *(int(self.facts[c]) for c in _FACTS),
            [c and c[0] for c in cells], [c and c[1] for c in cells],
        )


def _pieces(names: list[str], kinds: pa.Schema):
    """Sorted rows to pieces: one for each conversation of a task."""

    def run(batches):
        piece, out = None, []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds.field(i).type) for i in range(len(kinds))], names)
            out.clear()
            return made

        for rows in batches:
            for conv, turn, role, digest, n, fresh, blank, truncated in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if piece is None or piece.key != conv:
                    if piece is not None:
                        out.append(piece.row())
                        if len(out) >= 1_000:
                            yield batch()
                    piece = _Piece(conv, {"turn": turn, "role": role, "digest": digest})
                piece.add(turn, role, n, fresh, blank, truncated)
        if piece is not None:
            out.append(piece.row())
        yield batch()

    return run


def _conversation(pieces: list[dict]) -> dict:
    """One conversation from its pieces, in order."""
    pieces = [p for p in pieces if p["n_rows"]] or pieces[:1]
    out = {c: sum(p[c] for p in pieces) for c in _FACTS}
    for a, b in zip(pieces, pieces[1:], strict=False):
        out["illegal"] += not _legal(a["last_initial"], b["first_initial"])
        out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["least"]
    turns = [t for p in pieces for t in (p["least"], p["most"]) if t is not None]
    out["gaps"] = int(max(turns) - min(turns) + 1 - out["turns"]) if turns else 0
    cost, audit = 0, ""
    if out["n_rows"]:
        cells = [{(i // 4, i % 4): (c, x) for i, (c, x) in enumerate(zip(p["costs"], p["audits"], strict=True)) if c is not None} for p in pieces]
        cost, audit = best(combined(cells))
    return {"conv_id": pieces[0]["conv_id"], **{c: out[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


def _merge(kinds: pa.Schema):
    """Pieces, sorted by conversation and place, to conversations."""

    def run(batches):
        held: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for piece in batch.to_pylist():
                if held and held[0]["conv_id"] != piece["conv_id"]:
                    out.append(_conversation(held))
                    held = []
                held.append(piece)
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
        if held:
            yield pa.RecordBatch.from_pylist([_conversation(held)], kinds)

    return run


def edits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of ``conv_id, turn, role, text, n`` (n: copies of a row, 0 if it is gone).

    Texts themselves stay where they are; rows are told by digests.  Equal rows
    are counted before they are dealt out, so a row that fills a conversation
    is one row, and a conversation is cut into ranges of its turns, of which
    each task yields one piece.
    """
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    digest = F.sha2("text", 256).alias("digest")
    light = rows.select("conv_id", "turn", "role", digest, "n", F.col("text").rlike(_BLANK).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("truncated"))
    same = ["conv_id", "turn", "role", "digest"]
    counted = light.groupBy(*same).agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    # the earliest turn of a role and text; a null is the least
    fresh = light.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("turn")).select(*same, F.lit(0).cast("long").alias("n"), F.lit(1).alias("fresh"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"))
    told = counted.select(*same, "n", F.lit(0).alias("fresh"), "blank", "truncated").unionByName(fresh)
    told = told.groupBy(*same).agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    ordered = told.repartitionByRange(*same).sortWithinPartitions(*same)
    schema = _PIECE.format(kind=kind, turn=turn)
    pieces = ordered.mapInArrow(_pieces(*_arrow(rows, schema)), schema)
    out = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(_merge(_arrow(rows, out)[1]), out)


def _arrow(rows: DataFrame, schema: str) -> tuple[list[str], pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))
    return made.names, made


class _Repair:
    """Takes a conversation's rows one by one, whatever their number, and yields the repaired ones."""

    def __init__(self, found: dict):
        self.found, self.audit, self.at, self.place, self.assistant = found, found["audit"], 0, 0, False

    def _line(self, edit: str, turn, role: str, text: str) -> dict:
        made = {**self.found, "place": self.place, "edit": edit, "turn": turn, "role": role, "text": text}
        self.place, self.assistant = self.place + 1, role[:1] == "u"
        return made

    def _due(self) -> str:
        return "assistant" if self.assistant else "user"

    def insertions(self):
        while self.audit[self.at : self.at + 1] == "I":
            yield self._line("I", None, self._due(), "")
            self.at += 1

    def row(self, turn, role: str, text: str):
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._line(edit, turn, role if edit == "K" else self._due(), text)


def _apply(kinds: pa.Schema):
    """Sorted rows, each conversation's audit before them, to one row of facts (place -1) and its repaired rows."""

    def run(batches):
        now = None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if now is not None:
                        out += now.insertions()
                    now = _Repair({c: row[c] for c in ("conv_id", "audit")})
                    out.append(row | {"place": -1})
                else:
                    for _ in range(row["n"]):
                        out += now.row(row["turn"], row["role"], row["text"])
            for at in range(0, len(out), 5_000):
                yield pa.RecordBatch.from_pylist([r if r["place"] < 0 else r | {"audit": None} for r in out[at : at + 5_000]], kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([r | {"audit": None} for r in now.insertions()], kinds)

    return run


def _applied(rows: DataFrame) -> DataFrame:
    """The facts of each conversation, followed by its repaired rows, in order within their task."""
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("n").cast("long").alias("n"))
    nothing = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    none = F.lit("")
    head = edits(rows).select("conv_id", F.lit(None).cast(turn).alias("turn"), none.alias("role"), none.alias("digest"), none.alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("order"), *_COUNTS, "audit")
    body = rows.where("n > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "text", "n", F.lit(1).alias("order"), *nothing, F.lit(None).cast("string").alias("audit"))
    dealt = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "order", "turn", "role", "digest")
    out = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + f", audit string, place long, edit string, turn {turn}, role string, text string"
    return dealt.mapInArrow(_apply(_arrow(rows, out)[1]), out)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text``: the rows of each repaired conversation, from place 0; see :func:`repair`."""
    return _applied(rows).where("place >= 0").select("conv_id", "place", "edit", "turn", "role", "text")


def _digests(kinds: pa.Schema):
    """What :func:`_applied` returns to one row a conversation, with the digest of its repaired lines."""

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["place"] < 0:
                    if now is not None:
                        out.append(now | {"repaired_sha256": digest.hexdigest()})
                    now, digest = {c: row[c] for c in kinds.names[:-1]}, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if row['place'] else ''}{row['role']}:{row['text']}".encode())
            yield pa.RecordBatch.from_pylist(out, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now | {"repaired_sha256": digest.hexdigest()}], kinds)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and repaired digest of each conversation of ``conv_id, turn, role, text, n`` (n: copies of a row, 0 if it is gone).

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``, one row per conv_id, null being one too.  Rows are taken
    by turn, nulls first; rows that share a turn by role, then by the sha256 of
    their texts.  A null role or text is one space.  A conversation with all
    rows gone has zeros, an empty audit and the digest of nothing; an empty
    table has no rows.  Roles are told by their first character; others than
    s, u and a can't be kept.  Other columns are ignored.

    One digest runs over a conversation's repaired text, so its rows stream
    through one task in order; that step keeps only the audit, and sorting spills.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _applied(rows).mapInArrow(_digests(_arrow(rows, out)[1]), out)
