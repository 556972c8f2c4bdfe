"""Fuzzy line dedup by MinHash over character shingles.

A line, in ASCII lower case and with white space collapsed, is the set of its distinct
shingles of ``WIDTH`` characters.  Equal lines are joined first.  Bands of MinHash
values bring similar lines together, exact Jaccard on the full sets confirms
them, and connected components are found by a distributed union-find.  Of each
component one line stays: its first in order of document and line number.

Lines that share a band are dealt in blocks.  A block's lines are compared with
leads, one after another, until each line is a lead or similar to one; links to
leads are exact and cost linear work where the lines are alike.  What pairs may
then still link two components is told by the triangle inequality of the
Jaccard distance, and compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._shingles import U, mix, texts_of
from fieldspark.llm._spark import binary, checkpointed, components, likely, maybe, pieces, skew_join, unused

WIDTH = 8
#: Of lines alike by chance, a share of similarity**DEPTH meets in a band: three values were too few for many lines.
BANDS, DEPTH = 12, 4
#: Lines of one band that are compared in one task's step.
BLOCK = 1024

_SEEDS = np.random.default_rng(1234567891).integers(1, 2**31, (2, BANDS * DEPTH)).astype(np.uint32)
_MUL, _ADD = _SEEDS[0] * np.uint32(2) + np.uint32(1), _SEEDS[1]
#: Characters whose band keys are made at a time.
_PIECE = 1 << 19
#: Bytes of lines that are compared at a time, about.
_COMPARED = 1 << 17
#: A group's lines are told by whole hashes; they are sorted by so many bits beside a place, and the rest is compared.
_LEAST_BITS = 40
#: White space but line ends becomes a space, A-Z lower case.
_PLAIN = bytes(32 if x in b"\t\r\x0b\x0c" else x + 32 if 65 <= x <= 90 else x for x in range(256))


def _shingled(lines: list[bytes], wide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (of 64 or 32 bits) of all lines' shingles, one line after another, and how many each has.

    Lines are UTF-8; a shingle is WIDTH code points, and a shorter line is one
    shingle.  One pass over the joined lines; windows that cross an end are left out.
    """
    kind, factor = (U, U(0x9E3779B97F4A7C15)) if wide else (np.uint32, np.uint32(0x9E3779B1))
    points = [x.decode() for x in lines]
    sizes = np.array([len(x) for x in points])
    stops = np.cumsum(sizes)
    raw = np.frombuffer(("".join(points) + "\0" * WIDTH).encode("utf-32-le"), "<u4").astype(kind, copy=False)
    acc = np.full(stops[-1], kind(WIDTH))
    for i in range(WIDTH):
        np.add(acc, raw[i : i + len(acc)], out=acc)
        np.multiply(acc, factor, out=acc)
    inside = np.ones(len(acc), bool)
    for back in range(1, WIDTH):
        inside[stops[sizes >= back] - back] = False
    for i in np.flatnonzero(sizes < WIDTH):  # its first place stands for the whole line
        at, code = stops[i] - sizes[i], int(sizes[i])
        for x in raw[at : stops[i]].tolist():
            code = (code + x) * int(factor)
        acc[at] = code & int(np.iinfo(kind).max)
        inside[at] = True
    acc = acc[inside]
    if wide:
        return mix(acc), np.maximum(1, sizes - WIDTH + 1)
    acc = (acc ^ (acc >> np.uint32(16))) * np.uint32(0x7FEB352D)
    acc = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x846CA68B)
    return acc ^ (acc >> np.uint32(16)), np.maximum(1, sizes - WIDTH + 1)


def _band_keys(lines: list[bytes]) -> np.ndarray:
    """One key per band for each line."""
    low = np.full((BANDS * DEPTH, len(lines)), np.iinfo(np.uint32).max, np.uint32)

    def fold(parts, owners):
        joined, sizes = _shingled(parts, wide=False)
        starts = np.cumsum(sizes) - sizes
        room = np.empty_like(joined)
        owners = np.array(owners)
        for j in range(BANDS * DEPTH):
            np.multiply(joined, _MUL[j], out=room)
            np.add(room, _ADD[j], out=room)
            low[j, owners] = np.minimum(low[j, owners], np.minimum.reduceat(room, starts))

    parts, owners, size = [], [], 0
    for i, line in enumerate(lines):
        for part in [line] if len(line) <= _PIECE else _cut_up(line):
            if size + len(part) > _PIECE and parts:  # so no line has two parts in one pass
                fold(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(i)
            size += len(part)
    if parts:
        fold(parts, owners)
    wide = low.T.astype(U).reshape(len(lines), BANDS, DEPTH)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(lines), BANDS))
    for j in range(DEPTH):
        keys = mix(keys * U(0x9E3779B97F4A7C15) ^ wide[:, :, j])
    return keys


def _cut_up(line: bytes):
    """A long line in parts that have its shingles between them."""
    text = line.decode()
    for at in range(0, len(text) - WIDTH + 1, _PIECE):  # over _PIECE bytes with the next, so that two don't fit in a pass
        yield text[at : at + _PIECE + WIDTH - 1].encode()


def _normal_lines(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text, number and normal form of the texts' lines with a word: ASCII lower case, white space collapsed."""
    joined = b"\n".join(texts).translate(_PLAIN)
    while b"  " in joined:
        joined = joined.replace(b"  ", b" ")
    lines = joined.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n") if texts else []
    counts = np.array([int(np.count_nonzero(x == 10)) + 1 for x in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = np.fromiter(map(bool, lines), bool, len(lines))
    return text[words], number[words], [x for x in lines if x]


def _lines(kind: str):
    """Rows of (doc, line) and the line's digest (a, b), with its band keys or its normal form."""

    def made(docs, texts):
        owner, number, plain = _normal_lines(texts)
        columns = [pa.array(np.array(docs, np.int64)[owner]), pa.array(number.astype(np.int32))]
        names = ["doc", "line"]
        digest = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in plain]), np.int64).reshape(-1, 2)
        columns += [pa.array(digest[:, 0]), pa.array(digest[:, 1])]
        names += ["a", "b"]
        if kind == "keys":
            once = {x: i for i, x in enumerate(dict.fromkeys(plain))}  # equal lines are hashed once
            keys = _band_keys(list(once)).view(np.int64)[np.fromiter(map(once.__getitem__, plain), np.int64, len(plain))]
            columns += [pa.array(np.ascontiguousarray(keys[:, i])) for i in range(BANDS)]
            names += _KEYS
        if kind == "text":
            columns.append(binary(plain))
            names.append("data")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in pieces(batches, 1):
            yield made(batch.column(0).to_pylist(), list(texts_of(batch.column(1))))

    return run


_KEYS = [f"k{i}" for i in range(BANDS)]
_PLACE = "doc long, line int"
_SHAPE = f"{_PLACE}, a long, b long"


class _Rows:
    """Lines of whole groups, whose sets are compared with one line's set at a time."""

    def __init__(self, group: np.ndarray, lines: list[bytes]):
        hashes, sizes = _shingled(lines)
        row = np.repeat(np.arange(len(lines)), sizes)
        # a code for each shingle of a group: one sort by part of the hash, with the place in the lower bits
        full = hashes ^ mix(group[row].astype(U) * U(0x9E3779B97F4A7C15))
        low = len(full).bit_length()
        order = np.sort(full >> U(low) << U(low) | np.arange(len(full), dtype=U))
        place = (order & U((1 << low) - 1)).astype(np.int64)
        new = np.append(True, (order >> U(low))[1:] != (order >> U(low))[:-1])
        at, its = hashes[place], group[row[place]]
        other = np.append(True, (at[1:] != at[:-1]) | (its[1:] != its[:-1]))
        if 64 - low < _LEAST_BITS or (other & ~new).any():  # parts of hashes are alike: by all bits
            place = np.lexsort((hashes, group[row]))
            at, its = hashes[place], group[row[place]]
            other = np.append(True, (at[1:] != at[:-1]) | (its[1:] != its[:-1]))
        code = np.empty(len(full), np.int64)
        code[place] = np.cumsum(other) - 1
        # places of a shingle are in order, so a line's repeats are neighbours
        mine = row[place]
        once = np.empty(len(full), bool)
        once[place] = other | np.append(True, mine[1:] != mine[:-1])
        self.code = code[once]
        self.mark = np.zeros(int(other.sum()), np.int32)
        self.size = np.bincount(row[once], minlength=len(lines))
        self.start = np.cumsum(self.size) - self.size

    def distances(self, rows: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared shingles and Jaccard distance of each of rows to its group's lead (``leads``: of each row)."""
        at = [self.code[self.start[i] : self.start[i] + self.size[i]] for i in np.unique(leads)]
        at = np.concatenate(at)
        self.mark[at] = 1
        size = self.size[rows]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(self.start[rows] - (ends - size), size)
        same = np.add.reduceat(self.mark[self.code[place]], ends - size, dtype=np.int64)
        self.mark[at] = 0
        return same, 1 - same / (size + self.size[leads] - same)


def _links(group: np.ndarray, component: np.ndarray, lines: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that join all components of each group which similar lines connect.

    ``group`` numbers the rows' groups from 0, in order; rows that share a
    component are linked already.
    """
    rows = _Rows(group, lines)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    parent: dict[int, int] = {}
    least = 1 - percent / 100
    edges: list[tuple[int, int]] = []

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def join(u, v):
        x, y = root(int(component[u])), root(int(component[v]))
        if x != y:
            parent[x] = y
            edges.append((int(u), int(v)))

    lead = np.full(len(group), -1)
    seen: dict[int, list] = {}  # of groups with more than one lead: (lead, distances) by round
    open_ = np.arange(first.size)
    last = np.append(first[1:], len(group))
    rounds = 0
    while open_.size:
        # the next lead of each group is its first line that has none
        free = np.array([f + int(np.argmax(lead[f:e] < 0)) for f, e in zip(first[open_], last[open_], strict=True)])
        sizes = last[open_] - first[open_]
        all_rows = np.arange(sizes.sum()) + np.repeat(first[open_] - (np.cumsum(sizes) - sizes), sizes)
        leads = np.repeat(free, sizes)
        same, distance = rows.distances(all_rows, leads)
        near = 100 * same >= percent * (rows.size[all_rows] + rows.size[leads] - same)
        for u, v in zip(all_rows[near], leads[near], strict=True):
            join(u, v)
        new = all_rows[near & (lead[all_rows] < 0)]
        lead[new] = leads[near & (lead[all_rows] < 0)]
        lead[free] = free
        ends = np.cumsum(sizes)
        rest = np.array([bool((lead[f:e] < 0).any()) for f, e in zip(first[open_], last[open_], strict=True)])
        for i, g in enumerate(open_):
            if rounds or rest[i]:
                seen.setdefault(int(g), []).append((free[i], distance[ends[i] - sizes[i] : ends[i]]))
        open_ = open_[rest]
        rounds += 1

    # each pair of lines that aren't leads: x is within `least` of its lead, so y is within d(x) + least of it
    for g, found in seen.items():
        own = np.arange(first[g], last[g])
        label = np.array([root(int(component[i])) for i in own])
        if (label == label[0]).all():
            continue
        table = np.stack([x for _, x in found])
        follower = np.array([lead[i] != i for i in own])
        for at, (head, distance) in enumerate(found):
            mine = np.flatnonzero((lead[own] == head) & follower)
            others = np.flatnonzero(follower & (label != root(int(component[head]))) & (distance <= 2 * least + 1e-9))
            if not len(mine) or not len(others):
                continue
            for x in mine:
                some = others[distance[others] <= distance[x] + least + 1e-9]
                some = some[(np.abs(table[:, some] - table[:, [x]]) <= least + 1e-9).all(axis=0)]
                some = some[[root(int(component[own[y]])) != root(int(component[own[x]])) for y in some]] if len(some) else some
                if len(some):
                    same, _ = rows.distances(own[some], np.full(len(some), own[x]))
                    for y in some[100 * same >= percent * (rows.size[own[some]] + rows.size[own[x]] - same)]:
                        join(own[x], own[y])
    return edges


def _linked(percent: int):
    """(u, v) links of the groups of rows (x, y, z, id, component, data), sorted by x, y, z."""

    def done(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([np.asarray(table.column(i)) for i in range(3)])
        # lines that are dealt twice to a group count once
        order = np.lexsort((np.asarray(table.column(3)), *key[::-1]))
        ids = np.asarray(table.column(3))[order]
        key = key[:, order]
        change = np.ones(len(ids), bool)
        change[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        once = change.copy()
        once[1:] |= ids[1:] != ids[:-1]
        group = (np.cumsum(change) - 1)[once]
        order, ids = order[once], ids[once]
        lines = table.column(5).take(pa.array(order)).to_pylist()
        found = _links(group, np.asarray(table.column(4))[order], lines, percent)
        return pa.RecordBatch.from_arrays([pa.array([ids[u] for u, _ in found], pa.int64()), pa.array([ids[v] for _, v in found], pa.int64())], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # from the last group's start on
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            before = np.array([[c[-1].as_py()] for c in held[-1].columns[:3]]) if held else key[:, :1] ^ 1
            starts = np.flatnonzero((key != np.concatenate([before, key[:, :-1]], axis=1)).any(axis=0))
            bytes_ = np.append(0, np.cumsum(np.asarray(pc.binary_length(batch.column(5)), np.int64)))
            at = 0
            for start in starts.tolist():
                if size + bytes_[start] - bytes_[at] > _COMPARED and (held or start > at):
                    yield done(pa.Table.from_batches([*held, batch.slice(at, start - at)]))
                    held, size, at = [], 0, start
            held.append(batch.slice(at))
            size += int(bytes_[-1] - bytes_[at])
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _verified(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups (x, y, z) of ``dealt(x, y, z, id, component)``."""
    rows = dealt.join(texts.hint("merge"), "id").select("x", "y", "z", "id", "component", "data")
    return rows.repartition("x", "y", "z").sortWithinPartitions("x", "y", "z").mapInArrow(_linked(percent), "u long, v long")


def duplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, line``: the lines of ``doc_id, text`` that another line stands for.

    ``line`` counts from 0 over the ``\\n``-separated lines.  Blank lines are
    never listed; all others take part, however short or long.  Rows with a
    null id or text take no part.  Of rows that repeat an id each has its own
    lines; equal lines of the same number under one id are one place, and stay
    or go together.  ``doc_id`` must be an integer or its text (other texts
    raise an error).  An empty table gives an empty result.

    Two lines of similarity 0.8 share a band with probability 0.998, and more
    above that; equal lines are always found.
    """
    return _duplicates(docs, percent).select("doc_id", "line")


def _duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, line, a``; ``a`` is half of the line's digest and tells rows of one id apart."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_lines("keys"), f"{_SHAPE}, {', '.join(f'{k} long' for k in _KEYS)}")
    # a line's place as one number, which a hash aggregate can take the least of
    place = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    lines = found.withColumn("place", place.cast("decimal(38,0)")).groupBy("a", "b").agg(F.min("place").alias("place"), F.count("*").alias("n"), *(F.max(k).alias(k) for k in _KEYS))
    line = F.pmod("place", F.lit(1 << 31).cast("decimal(10,0)"))
    doc = ((F.col("place") - line) / F.lit(1 << 31).cast("decimal(10,0)")).cast("long")
    lines = checkpointed(lines.select("a", "b", "n", doc.alias("doc"), line.cast("int").alias("line"), F.array(*_KEYS).alias("keys"))).withColumn("id", F.monotonically_increasing_id())

    keys = lines.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lead")).where("size > 1")
    # keys with the same members do the same work: one of them stays
    shared = checkpointed(shared.groupBy("size", "x", "lead").agg(F.min("key").alias("key")).select("key", "size", "lead"))
    members = skew_join(checkpointed(likely(keys, shared, "key")), shared.drop("lead"), ["key"], "size")
    members = checkpointed(members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")))

    wanted = checkpointed(lines.join(members.select("id").distinct().hint("merge"), "id").select("id", F.col("doc").alias("doc"), "line", "a", "b", F.xxhash64("doc", "line", "a").alias("at")))
    texts = likely(rows, wanted.select(F.col("doc").alias("doc_id")), "doc_id").mapInArrow(_lines("text"), f"{_SHAPE}, data binary").withColumn("at", F.xxhash64("doc", "line", "a"))
    texts = likely(texts, wanted, "at").join(wanted.drop("at").hint("merge"), ["doc", "line", "a", "b"])
    texts = checkpointed(texts.dropDuplicates(["id"]).select("id", "data"))  # rows of one id may repeat a line

    # inside blocks; a large key's lead is in each of its blocks
    leads = shared.where(f"size > {BLOCK}").select("key", F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("block"))
    dealt = members.select("key", "id", "block").unionByName(leads).select(F.col("key").alias("x"), F.col("block").alias("y"), F.lit(0).alias("z"), "id", F.col("id").alias("component"))
    linked = checkpointed(_verified(dealt, texts, percent).distinct())
    merged = components(linked)

    # of large keys that aren't one component yet, whatever isn't in the largest one meets all blocks
    large = members.where("blocks > 1")
    if not large.isEmpty():
        merged = checkpointed(merged)
        placed = checkpointed(large.join(merged.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
        most = parts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("parts"), F.sum("m").alias("all")).where("parts > 1")
        most = checkpointed(most.select("key", "all", F.col("most.component").alias("main"), F.ceil((F.col("all") - F.col("most.m")) / BLOCK).cast("int").alias("sides")))
        mixed = checkpointed(skew_join(placed, most, ["key"], "all"))
        side = F.pmod(F.xxhash64("id", F.lit(11)), F.col("sides")).cast("int")
        base = mixed.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), "id", "component")
        others = mixed.where("component <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), side.alias("side"), "id", "component")
        across = base.unionByName(others).select(F.col("key").alias("x"), F.col("block").alias("y"), F.col("side").alias("z"), "id", "component")
        second = checkpointed(_verified(across, texts, percent).distinct())
        if not second.isEmpty():
            merged = components(linked.unionByName(second))
    merged = checkpointed(merged)

    # each line's component and that component's first place
    named = lines.select("a", "b", "n", "id", "doc", "line").join(merged.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    alone = named.where("component is null and n > 1").select("a", "b", "n", F.col("doc").alias("keep_doc"), F.col("line").alias("keep_line"))
    grouped = checkpointed(named.where("component is not null").select("a", "b", "n", "component", "doc", "line"))
    best = checkpointed(grouped.groupBy("component").agg(F.min(F.struct("doc", "line")).alias("keep"), F.count("*").alias("m")))
    grouped = skew_join(grouped, best, ["component"], "m").select("a", "b", "n", F.col("keep.doc").alias("keep_doc"), F.col("keep.line").alias("keep_line"))
    fate = checkpointed(alone.unionByName(grouped))
    places = checkpointed(likely(rows.mapInArrow(_lines(""), _SHAPE), fate, "a"))  # the join reads them twice
    out = skew_join(places, fate, ["a", "b"], "n").where("doc <> keep_doc or line <> keep_line")
    return out.select(F.col("doc").alias("doc_id"), "line", "a")


def _digest(line: str) -> int:
    """The first half of a line's digest: other rows of the id have other lines of that number."""
    plain = b" ".join(line.encode().lower().split())
    return int.from_bytes(hashlib.blake2b(plain, digest_size=16).digest()[:8], "little", signed=True)


def _cut(batches, drop_emptied: bool = False):
    """Rows less the lines that the last column numbers; with ``drop_emptied``, less the rows that it leaves without a word."""
    for batch in pieces(batches, "text"):
        last = batch.num_columns - 1
        at = batch.schema.get_field_index("text")
        texts = []
        for text, numbers in zip(batch.column(at).cast(pa.string()).to_pylist(), batch.column(last).to_pylist(), strict=True):
            drop = {(x["line"], x["a"]) for x in numbers or ()}
            places = {i for i, _ in drop}
            texts.append(text if not drop else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in places or (i, _digest(x)) not in drop))
        columns = [pa.array(texts, x.type) if i == at else x for i, x in enumerate(batch.columns)]
        if "n_chars" in batch.schema.names[:last]:
            n = batch.schema.get_field_index("n_chars")
            listed = batch.column(last).is_valid()
            columns[n] = pc.if_else(listed, pa.array([None if x is None else len(x) for x in texts], batch.column(n).type), batch.column(n))
        made = pa.RecordBatch.from_arrays(columns[:last], batch.schema.names[:last])
        if drop_emptied:
            listed = batch.column(last).is_valid().to_pylist()
            made = made.filter(pa.array([not cut or text is None or bool(text.encode().strip()) for cut, text in zip(listed, texts, strict=True)], pa.bool_()))
        yield made


def without_duplicate_lines(docs: DataFrame, percent: int = 80, drop_emptied: bool = False) -> DataFrame:
    """docs, all columns and rows, with the duplicate lines cut from ``text``.

    A document that loses every line with a word stays with what blank lines it
    has, or goes with ``drop_emptied``: other documents have all that it said.
    ``n_chars``, where there is one, is counted anew for cut rows.  Rows with a
    null id or text, and documents without duplicate lines, are passed on
    unchanged and unshuffled.  No column name is reserved.
    """
    key, many = unused(docs.columns, "id", "gone")
    gone = _duplicates(docs, percent).groupBy("doc_id").agg(F.collect_set(F.struct("line", "a")).alias(many)).withColumnRenamed("doc_id", key)
    gone = checkpointed(gone)
    marked, flag = maybe(docs.withColumn(key, F.col("doc_id").cast("long")), gone, key)
    # few rows are built into a table, so the texts aren't sorted
    touched = marked.where(F.col(flag) & F.col("text").isNotNull()).join(gone.hint("shuffle_hash"), key, "left")
    cut = touched.select(*docs.columns, many).mapInArrow(lambda batches: _cut(batches, drop_emptied), docs.schema)
    return cut.unionByName(marked.where(~F.col(flag) | F.col("text").isNull()).select(*docs.columns))
