"""Exact duplicates by composable polynomial fingerprints.

A text, without ``[\\x20\\x09-\\x0D]``, is a number in base B modulo two primes.
Chunks are hashed on their own and joined by ``H(ab) = H(a) * B**len(b) + H(b)``,
so a huge document is never hashed in one piece.  Rows of equal fingerprints
and lengths are then compared chunk by chunk: a group stands only if each of
its chunks has one content.  Groups that differ are told apart by content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._shingles import texts_of
from fieldspark.llm._spark import binary, checkpointed, likely, skew_join

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 715136305)
PIECE = 4096
#: Bytes of text that one comparison row holds.
CHUNK = 1 << 16
_STRIP = b" \t\n\x0b\x0c\r"


def _powers(base: int, prime: int) -> np.ndarray:
    out = [1]
    for _ in range(PIECE - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.int64)


_POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def combine(left: tuple[int, int], right: tuple[int, int], base: int, prime: int) -> tuple[int, int]:
    """Join two (hash, length) pairs of neighbouring texts."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: bytes) -> tuple[int, int]:
    """Hashes of a text under either prime."""
    raw = np.frombuffer(data, np.uint8)
    out = []
    for powers, base, prime in zip(_POWERS, BASES, PRIMES, strict=True):
        whole = len(raw) // PIECE
        state = (0, 0)
        if whole:
            step = pow(base, PIECE, prime)
            h = 0
            for at in range(0, whole, 256):  # 1 MB at a time
                block = raw[at * PIECE : min(at + 256, whole) * PIECE].reshape(-1, PIECE).astype(np.int64)
                for x in (block @ powers % prime).tolist():
                    h = (h * step + x) % prime
            state = (h, whole * PIECE)
        rest = raw[whole * PIECE :].astype(np.int64)
        state = combine(state, (int(rest @ powers[PIECE - len(rest) :]) % prime if len(rest) else 0, len(rest)), base, prime)
        out.append(state[0])
    return out[0], out[1]


def stripped(text) -> bytes:
    return bytes(text).translate(None, _STRIP)


def _fingerprints(bits: int):
    def run(batches):
        for batch in batches:
            marks, lengths, digests = [], [], []
            for text in texts_of(batch.column(1)):
                data = stripped(text)
                marks.append(_mark(data, bits))
                lengths.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests)], ["doc_id", "points", "mark", "bytes", "text_sha256"])

    return run


def _mark(data: bytes, bits: int) -> int:
    a, b = fingerprint(data)
    return (a << 31 | b) & ((1 << bits) - 1)


def _chunks(bits: int):
    def run(batches):
        for batch in batches:
            out: list = [[], [], [], []]
            size = 0
            for text in texts_of(batch.column(0)):
                data = stripped(text)
                mark = _mark(data, bits)
                for n, at in enumerate(range(0, max(1, len(data)), CHUNK)):
                    for column, value in zip(out, (mark, len(data), n, data[at : at + CHUNK]), strict=True):
                        column.append(value)
                    size += min(CHUNK, len(data))
                    if size > 1 << 24:
                        yield _chunk_batch(out)
                        out, size = [[], [], [], []], 0
            yield _chunk_batch(out)

    return run


def _chunk_batch(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), binary(out[3])], ["mark", "bytes", "chunk", "data"])


def exact_duplicates(docs: DataFrame, bits: int = 62) -> DataFrame:
    """Groups of rows whose texts are equal but for white space.

    Takes ``doc_id, text`` (other columns are ignored) and returns one row per
    input row: ``doc_id, keep_id, group_size, kept, text_sha256``.  The row with
    the most code points in its original text stays, then the smallest doc_id
    (a null id after all others).  Null counts as empty, and all empty texts
    are one group.  Rows that repeat an id and text are one group, all but one
    of them dropped unless they are alike in every way, when each has ``kept``.
    An empty table gives an empty result.  ``bits`` shortens fingerprints, so
    that tests meet collisions.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = rows.select("doc_id", "text", F.length("text").cast("long").alias("points"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    seen = checkpointed(marked.mapInArrow(_fingerprints(bits), f"doc_id {id_type}, points long, mark long, bytes long, text_sha256 string"))

    sizes = checkpointed(seen.groupBy("mark", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    # only the rows of such groups are read again, and compared chunk by chunk
    ids = checkpointed(skew_join(seen.select(F.xxhash64("doc_id").alias("k"), "mark", "bytes"), sizes, ["mark", "bytes"], "n").select("k").distinct())
    texts = likely(rows.withColumn("k", F.xxhash64("doc_id")), ids, "k").select("text")
    pieces = texts.mapInArrow(_chunks(bits), "mark long, bytes long, chunk long, data binary")
    differing = pieces.groupBy("mark", "bytes", "chunk", "data").agg(F.lit(1).alias("one")).groupBy("mark", "bytes", "chunk").agg(F.count("*").alias("contents")).where("contents > 1")
    collided = checkpointed(differing.select("mark", "bytes").distinct())

    # almost always empty: members of such groups are also told apart by their digest
    told = seen.join(collided.withColumn("collided", F.lit(True)), ["mark", "bytes"], "left").withColumn("apart", F.when(F.col("collided"), F.col("text_sha256")).otherwise(F.lit("")))
    told = checkpointed(told.select("doc_id", "points", "mark", "bytes", "apart", "text_sha256"))
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    groups = told.groupBy("mark", "bytes", "apart").agg(F.count("*").alias("group_size"), first.alias("f"))
    groups = checkpointed(groups.select("mark", "bytes", "apart", "group_size", F.col("f.d").alias("keep_id"), (-F.col("f.p")).alias("most")))
    joined = skew_join(told, groups, ["mark", "bytes", "apart"], "group_size")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"), "text_sha256")
