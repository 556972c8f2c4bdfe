"""Helpers that the operators share: cut lineage, skew-proof joins, components."""

from __future__ import annotations

import ctypes
import tempfile
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs outside these six characters.
SPACES = "[\\x20\\x09-\\x0D]"
#: A key with more than a thousandth of all rows is hot, so there are under a thousand hot keys.
HOT_KEYS = 1000
#: Edges that one task contracts on its own; the number of tasks grows with the edges.
TASK_EDGES = 250_000
#: Bytes of long columns that a task works on at a time.
PIECE = 1 << 21


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, with no lineage.

    The folder is what ``spark.checkpoint.dir`` names.  Only a local session
    without that setting gets a temporary folder; a cluster must name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Join rows to groups (one row per key, with ``size`` rows each), hot keys apart.

    Keys with over a thousandth of the rows number under a thousand; those
    groups are broadcast, so their rows stay where they are.  Every other key
    has at most a thousandth of the rows and goes through a shuffle join, by a
    hint: sizes that Spark would decide by are compressed, and the driver would
    hold many times as much.
    ``groups`` must be cheap to read twice (a checkpoint), and its columns
    other than the keys must have a bounded size.
    """
    total = groups.agg(F.sum(size).alias("t")).first()["t"]
    bound = max(1000.0, (total or 0) / HOT_KEYS)
    columns = [*rows.columns, *(c for c in groups.columns if c not in keys)]
    hot = groups.where(F.col(size) > bound).withColumn("_hot", F.lit(True))
    flagged = rows.join(F.broadcast(hot), keys, "left")
    cold = flagged.where(F.col("_hot").isNull()).select(*rows.columns).join(groups.where(F.col(size) <= bound).hint("merge"), keys)
    return flagged.where("_hot").select(*columns).unionByName(cold.select(*columns))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def maybe(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, str]:
    """rows with a boolean column, and its name: false where the key surely isn't in ids.

    ids is a checkpointed table.  A bitmap of its hashes is broadcast: at most
    2**24 bits in 2**18 rows, however many ids there are; when it is full it
    only stops helping.
    """
    place, slot, word, flag = unused(rows.columns, "place", "slot", "word", "maybe")
    bits = 1 << max(10, min(24, (64 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(bits))
    words = ids.select(at.alias(place)).groupBy(F.shiftright(place, 6).alias(slot)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} & 63 as int))")).alias(word))
    marked = rows.withColumn(place, at).withColumn(slot, F.shiftright(place, 6)).join(F.broadcast(words), slot, "left")
    return marked.select(*rows.columns, F.expr(f"(shiftright(coalesce({word}, 0L), cast({place} & 63 as int)) & 1) = 1").alias(flag)), flag


def likely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be in ids: all that are, and few others.  Nothing is shuffled."""
    marked, flag = maybe(rows, ids, key)
    return marked.where(F.col(flag)).select(*rows.columns)


def ranked(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """rows with their place ``rank`` in the order of keys, from 0, and the number of rows.

    Rows are sorted in ranges of the keys; one count per range makes places
    global.  Rows alike in all keys are interchangeable.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the checkpoint fixes partitions and their order
    ordered = checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    part, at, start = unused(rows.columns, "part", "at", "start")
    numbered = ordered.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r[0]: r[1] for r in numbered.groupBy(part).agg(F.count("*")).collect()}  # one row per partition
    starts, total = [], 0
    for number in sorted(sizes):
        starts.append((number, total))
        total += sizes[number]
    # from Arrow, as rows of Python objects would be read by Python workers of their own beside the others
    offsets = spark.createDataFrame(pa.table({part: pa.array([x for x, _ in starts], pa.int64()), start: pa.array([x for _, x in starts], pa.int64())}))
    return numbered.join(F.broadcast(offsets), part).select(*rows.columns, (F.col(start) + F.col(at)).alias("rank")), total


def _contract(batches):
    """Union-find over one task's edges; yields a star for each local component."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush():
        nodes = [(x, root(x)) for x in parent]
        nodes = [(x, r) for x, r in nodes if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in nodes], pa.int64()), pa.array([r for _, r in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 1_000_000:  # bounded memory: what is left is joined in later rounds
            yield flush()
    yield flush()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node of the u side has one edge, to a node that has none of its own."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges(u, v)`` of longs, in any order, repeats allowed.  Returns
    ``(node, component)``, the smallest reachable id, for every node of an
    edge.  Each task first contracts up to TASK_EDGES edges with a union-find,
    which is all there is to do for few edges.  Edges and minima are checkpointed, so both sides of each join have an exchange
    of their own and adaptive execution can split hub nodes.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    nodes = "u long, v long"
    edges = checkpointed(edges.distinct())
    now = checkpointed(edges.coalesce(edges.count() // TASK_EDGES + 1).mapInArrow(_contract, nodes))
    for _ in range(rounds):
        if _is_star(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = checkpointed(large.distinct())
        least = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct().mapInArrow(_contract, nodes))
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pieces(batches, *columns):
    """The batches' rows in order, cut so that the given columns (places or names) have few bytes a piece.

    Spark hands over batches of a number of rows; what a task makes of each,
    and what it sends back at once, then depends on PIECE and the longest row
    and not on that number.  At the end, freed memory goes back to the system:
    an idle worker stays beside its executor.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for x in columns:
            data = batch.column(x)
            data = data if pa.types.is_binary(data.type) or pa.types.is_large_binary(data.type) else data.cast(pa.large_string())
            size += as_numpy(pc.fill_null(pc.binary_length(data), 0), np.int64)
        starts = np.flatnonzero(np.diff(np.cumsum(size) // PIECE, prepend=-1))
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(at), int(end - at))
        del batch, data
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where there is glibc
        ctypes.CDLL(None).malloc_trim(0)


def binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


def as_numpy(column, kind) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=kind)
