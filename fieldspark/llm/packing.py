"""Conflict-constrained best-fit packing of documents into fixed-length bins.

Pieces of documents are dealt evenly to packing units of bounded size.  In a unit, items
go in order of falling length.  Open bins are kept in order of residual room;
from the tightest that fits, successors are tried until one is compatible.  A
bin carries a bitmap of source lanes (so many items of one source at most) and
one of duplicate clusters (one item of each).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._spark import SPACES, checkpointed, ranked

#: Words in a bin; a longer document is cut into pieces of this length.
CAPACITY = 2048
#: Items of one source in a bin, at most.
PER_SOURCE = 4
#: Items that are packed together, about.
UNIT = 4000


def best_fit(items: list[tuple[int, int, int]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), given by falling length.

    Sources and clusters are small integers, which the bitmaps are indexed by.
    """
    bins: list[list[int]] = []  # residual, source lanes, clusters
    rooms: list[int] = []  # residuals that some bin has, in order
    by_room: dict[int, list[int]] = {}
    lanes = (1 << per_source) - 1
    out = []
    for length, source, cluster in items:
        shift, mark, chosen = source * per_source, 1 << cluster, -1
        for at in range(bisect_left(rooms, length), len(rooms)):
            for number in by_room[rooms[at]]:
                if not bins[number][2] & mark and (bins[number][1] >> shift) & lanes != lanes:
                    chosen = number
                    break
            if chosen >= 0:
                break
        if chosen < 0:
            chosen = len(bins)
            bins.append([capacity, 0, 0])
        else:
            room = bins[chosen][0]
            by_room[room].remove(chosen)
            if not by_room[room]:
                del by_room[room]
                del rooms[bisect_left(rooms, room)]
        own = bins[chosen]
        out.append((chosen, capacity - own[0]))
        used = (own[1] >> shift) & lanes
        own[0] -= length
        own[1] |= ((used << 1 | 1) & lanes) << shift
        own[2] |= mark
        if own[0]:
            if own[0] not in by_room:
                by_room[own[0]] = []
                insort(rooms, own[0])
            by_room[own[0]].append(chosen)
    return out


def _pack(capacity: int, per_source: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        sources = pd.factorize(pdf["source"], use_na_sentinel=False)[0].tolist()
        clusters = pd.factorize(pdf["cluster"], use_na_sentinel=False)[0].tolist()
        placed = best_fit(list(zip(pdf["length"].tolist(), sources, clusters, strict=True)), capacity, per_source)
        unit = int(pdf["unit"].iloc[0])
        return pdf.assign(bin_id=[unit << 24 | b for b, _ in placed], bin_offset=[o for _, o in placed])[["doc_id", "source", "cluster", "piece", "start", "length", "bin_id", "bin_offset"]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, unit: int = UNIT) -> DataFrame:
    """Where each piece of ``doc_id, text, source`` goes.

    Returns ``doc_id, source, cluster, piece, start, length, bin_id,
    bin_offset`` in words: piece ``piece`` holds ``length`` words from word
    ``start`` on, and lies at ``bin_offset`` of its bin.  Lengths in a bin sum
    to ``capacity`` at most.  No bin has two pieces of one duplicate cluster
    (texts that are equal in lower case, white space aside; the pieces of one
    document among them) or more than ``per_source`` of one source; a null
    source is a source of its own.  A document without words has one row of
    length 0 with a null bin.  Null ids and repeated rows are packed like
    others.  Other columns are ignored.  An empty table gives an empty result.

    Texts are read once; lengths, sources and digests are ranked by cluster,
    id, source and length, and piece i of rank r goes to unit (r + i) modulo
    their number.  So copies and the pieces of a long document are dealt
    apart, units are even whatever source or cluster is hot, and bins don't
    depend on how rows lie in files.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        "doc_id",
        source.alias("source"),
        F.md5(F.lower(F.regexp_replace(text, SPACES + "+", "")).cast("binary")).alias("cluster"),
        F.size(F.array_remove(F.split(text, SPACES + "+"), "")).cast("long").alias("n"),
    )
    rows, _ = ranked(checkpointed(rows), ["cluster", "doc_id", "source", "n"])
    last = F.expr(f"greatest(n - 1, 0) div {capacity}")
    units = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // unit))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", F.pmod(F.col("rank") + F.col("piece"), F.lit(units)).alias("unit"), "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, source string, cluster string, piece long, start long, length long, bin_id long, bin_offset long"
    placed = pieces.where("length > 0").groupBy("unit").applyInPandas(_pack(capacity, per_source), shape)
    none = F.lit(None).cast("long")
    return placed.unionByName(pieces.where("length = 0").select("doc_id", "source", "cluster", "piece", "start", "length", none.alias("bin_id"), none.alias("bin_offset")))
