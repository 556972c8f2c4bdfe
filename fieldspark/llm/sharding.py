"""Shards along a Hilbert curve over quantised metadata.

Source, language and size are quantised to a few bits each, in their order;
the curve visits neighbouring cells one after another, so a run of it covers a
small box in all dimensions and readers can skip files by their bounds.  Rows are ranked along
the curve and cut into runs whose counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._spark import checkpointed, ranked, skew_join

SHARDS = 16
BITS = 5
#: Distinct values of an axis up to which their codes are broadcast.
FEW = 10_000


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, one a row.

    The transform of J. Skilling, "Programming the Hilbert curve" (2004).
    Coordinates are brought into the curve's own frame from the high bit down
    (exchange or invert the low bits as each bit of an axis tells), Gray-coded
    across axes, and their bits interleaved.
    """
    axes = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            flip = (axes[i] & high) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(flip, low, swap)
            axes[i] ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    carry = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    out = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            out = out << 1 | ((axis ^ carry) >> level & 1)
    return out


def _curve(bits: int, dims: int):
    def run(batches):
        for batch in batches:
            points = np.stack([np.asarray(batch.column(i)) for i in range(dims)], axis=1) if batch.num_rows else np.zeros((0, dims), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_index(points, bits)), *batch.columns[dims:]], ["curve", *batch.schema.names[dims:]])

    return run


def coded(rows: DataFrame, column: str, code: str) -> DataFrame:
    """rows with ``code``: the place of the column's value among its distinct values, in BITS bits."""
    values = checkpointed(rows.groupBy(column).agg(F.count("*").alias("n_rows")))
    places, distinct = ranked(values, [column])
    places = checkpointed(places.select(column, "n_rows", F.expr(f"rank * {1 << BITS} div {max(distinct, 1 << BITS)}").cast("long").alias(code)))
    if distinct <= FEW:
        return rows.join(F.broadcast(places.drop("n_rows")), column)
    return skew_join(rows, places, [column], "n_rows").drop("n_rows")


def shards(docs: DataFrame, n: int = SHARDS, columns: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` per row, then ``columns``.

    Takes ``doc_id, text`` and, if there, ``source, lang`` (else their axis is
    flat; null counts as the empty string); a null text is empty, null ids come
    first in their cell.  The law is ``rows``: counts of shards 0 to n-1
    differ by one at most, and slots count from 0 in each.  Rows are ranked by
    curve position, checksum, size, then doc_id; rows alike in all of them are
    interchangeable.  A table of fewer than n rows leaves shards empty, an
    empty one gives an empty result.  ``columns`` names columns of docs to
    carry along, other than these.

    Codes keep the order of values: an axis is cut into runs of its sorted
    distinct values, so a shard's bounds tell what it may hold.  Only metadata
    is shuffled, by ranges of the full sort key, so a hot cell is spread; a
    count per partition makes ranks global.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    top = (1 << BITS) - 1
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"v{i}") if c in docs.columns else F.lit("").alias(f"v{i}") for i, c in enumerate(("source", "lang"))),
        F.least(F.lit(top), F.floor(F.log2(size.cast("double")) * 1.5)).cast("long").alias("a2"),
        "doc_id",
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(*columns).alias("with") if columns else F.lit(None).cast("int").alias("with"),
    )
    rows = checkpointed(rows)  # the texts are read once
    rows = coded(coded(rows, "v0", "a0"), "v1", "a1").select("a0", "a1", "a2", "doc_id", "size", "text_crc32", "with")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    placed = rows.mapInArrow(_curve(BITS, 3), f"curve long, {shape}")
    placed, total = ranked(placed, ["curve", "text_crc32", "size", "doc_id"])
    base, extra = divmod(total, n)
    cut = extra * (base + 1)
    shard = F.when(F.col("rank") < cut, F.expr(f"rank div {base + 1}")).otherwise(extra + F.expr(f"(rank - {cut}) div {max(base, 1)}")).cast("int")
    first = F.col("shard") * base + F.least(F.col("shard"), F.lit(extra))
    placed = placed.withColumn("shard", shard)
    out = placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "with")
    return out.select("*", "with.*").drop("with") if columns else out.drop("with")


def write_shards(placed: DataFrame, path: str, n: int = SHARDS) -> None:
    """Write rows of :func:`shards` as one folder per shard, each in order of its slots."""
    placed.repartitionByRange(n, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
