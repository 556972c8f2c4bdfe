"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document is the set of its distinct k-word shingles.  Documents with equal
sets form one class.  A signature holds ``CHUNKS * WIDTH`` MinHash values of
16 bits, cut into chunks of ``WIDTH`` values.  By the pigeonhole principle two
signatures that differ in at most ``2 * CHUNKS - 1`` values have a chunk with
at most one difference; enumerating that error (each value of the chunk left
out in turn) gives index keys of which such a pair shares at least one.

Candidates that share a key are never expanded into all pairs.  Each key's
members are dealt in blocks; a bitmap of a set bounds every intersection from
above exactly, and a block emits a spanning forest of the pairs that the bound
admits.  These are confirmed on the full sets.  Where a key's members then
still fall into several components, what pairs remain across components and
pass the exact bound are confirmed as well, so no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._shingles import U, mix, shingles, word_batches
from fieldspark.llm._spark import as_numpy, binary, checkpointed, components, likely, maybe, pieces, skew_join, unused

CHUNKS, WIDTH = 10, 4
BLOCK = 1024
_SEEDS = np.random.default_rng(88172645463325252).integers(1, 2**63, (2, CHUNKS * WIDTH), dtype=np.int64).astype(U)
_MUL, _ADD = _SEEDS[0] * U(2) + U(1), _SEEDS[1]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a non-empty set, 16 bits each."""
    low = np.full(CHUNKS * WIDTH, np.iinfo(U).max, U)
    for at in range(0, len(hashes), 8192):
        low = np.minimum(low, (_MUL[:, None] * hashes[None, at : at + 8192] + _ADD[:, None]).min(axis=1))
    return (mix(low) >> U(48)).astype(np.uint16)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each hash, in a power of two of at least eight bits a hash."""
    bits = max(6, int(8 * len(hashes) - 1).bit_length())
    out = np.zeros(1 << (bits - 3), np.uint8)
    at = hashes >> U(64 - bits)
    np.bitwise_or.at(out, (at >> U(3)).astype(np.int64), (1 << (at & U(7)).astype(np.int64)).astype(np.uint8))
    return out


def halved(maps: np.ndarray) -> np.ndarray:
    """Bitmaps (as bytes, one a row) of half the size: neighbouring bits are joined."""
    pairs = np.unpackbits(maps, axis=1, bitorder="little").reshape(len(maps), -1, 2)
    return np.packbits(pairs.any(axis=2), axis=1, bitorder="little")


def _sets(k: int):
    def run(batches):
        for batch in pieces(batches, 1):
            sizes, keys, marks, nodes = [], [], [], []
            for words in word_batches(batch.column(1)):
                found = shingles(words, k)
                sizes.append(len(found))
                keys.append(_set_key(found) if len(found) else None)
                nodes.append(_node(keys[-1]) if len(found) else None)
                marks.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), binary(keys), binary(marks), pa.array(nodes, pa.int64())], ["doc_id", "n_shingles", "set_key", "sig", "node"])

    return run


def _keys(batches):
    """Each signature's index keys: for every chunk, each value left out in turn."""
    slots = [(c * WIDTH, w) for c in range(CHUNKS) for w in range(WIDTH)]
    tags = mix(np.arange(1, len(slots) + 1, dtype=U))
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(U)
        out = np.empty((batch.num_rows, len(slots)), U)
        for j, (at, left) in enumerate(slots):
            a, b, c = (sig[:, at + i] for i in range(WIDTH) if i != left)
            out[:, j] = mix((a | b << U(16) | c << U(32)) ^ tags[j])
        doc = np.repeat(as_numpy(batch.column(0), np.int64), len(slots))
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(doc)], ["key", "doc"])


def _node(key: bytes) -> int:
    """A set's number: an id may stand for several texts, and so for several sets."""
    return int.from_bytes(key[:8], "little", signed=True)


def _set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _shingled(k: int, kind: str):
    """(number of a text's set, its size, the set as bytes or its bitmap), for texts with shingles."""

    def run(batches):
        for batch in pieces(batches, 1):
            found = [x for words in word_batches(batch.column(1)) if len(x := shingles(words, k))]
            yield pa.RecordBatch.from_arrays([pa.array([_node(_set_key(x)) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), binary([(bitmap(x) if kind == "bitmap" else x).tobytes() for x in found])], ["doc", "n", "data"])

    return run


def admitted(sizes: np.ndarray, maps: list[np.ndarray], group: np.ndarray, percent: int, left: np.ndarray | None = None):
    """Pairs (i, j, bound) of different groups whose similarity the bitmaps don't rule out.

    ``|A & B| <= |A| - |bits of A that B lacks|`` holds exactly, and so does
    its mirror.  Maps of neighbouring sizes are compared at the smaller one.
    ``left``: if given, only pairs of a row with it and one without.
    """
    width = np.array([len(m) for m in maps])
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        wide = np.flatnonzero(width == 2 * w)
        rows = np.concatenate([mine, wide])
        stack = np.stack([maps[i] for i in mine])
        if len(wide):
            stack = np.concatenate([stack, halved(np.stack([maps[i] for i in wide]))])
        stack = stack.view(np.uint64) if w % 8 == 0 else stack
        n = sizes[rows]
        for i in range(len(mine)):
            rest = np.arange(i + 1, len(rows))
            rest = rest[(group[rows[rest]] != group[rows[i]]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            if left is not None:
                rest = rest[left[rows[rest]] != left[rows[i]]]
            for at in range(0, len(rest), 256):
                part = rest[at : at + 256]
                both = np.bitwise_count(stack[i][None] & stack[part]).sum(axis=1, dtype=np.int64)
                own = int(np.bitwise_count(stack[i]).sum(dtype=np.int64))
                other = np.bitwise_count(stack[part]).sum(axis=1, dtype=np.int64)
                most = np.minimum(n[i] - (own - both), n[part] - (other - both))
                good = 100 * most >= percent * (n[i] + n[part] - most)
                for j, m in zip(part[good], most[good], strict=True):
                    yield int(rows[i]), int(rows[j]), m / (n[i] + n[j] - m)


def _forest(percent: int):
    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("doc").reset_index(drop=True)
        maps = [np.frombuffer(x, np.uint8) for x in pdf["data"]]
        found = sorted(admitted(pdf["n"].to_numpy(), maps, np.arange(len(pdf)), percent), key=lambda x: -x[2])
        parent, edges, doc = list(range(len(pdf))), [], pdf["doc"].tolist()

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j, _ in found:
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                edges.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    return run


def _across(percent: int):
    def run(key, pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("doc").reset_index(drop=True)
        maps = [np.frombuffer(x, np.uint8) for x in pdf["data"]]
        left = (pdf["block"] == key[1]).to_numpy() if key[1] != key[2] else None
        doc = pdf["doc"].tolist()
        found = admitted(pdf["n"].to_numpy(), maps, pdf["component"].to_numpy(), percent, left)
        return pd.DataFrame([(min(doc[i], doc[j]), max(doc[i], doc[j])) for i, j, _ in found], columns=["u", "v"], dtype="int64")

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in pieces(batches, 2, 3):
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for i in range(len(u)):
                x, y = np.frombuffer(a[i], U), np.frombuffer(b[i], U)
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], ["u", "v"])

    return run



def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Both joins have plain exchanges on either side, so a document in very many
    pairs is split by adaptive execution.
    """
    wanted = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes.select("node", F.col("rep").alias("doc_id")).hint("merge"), "node"))
    sets = likely(docs, wanted, "doc_id").mapInArrow(_shingled(k, "set"), "doc long, n long, data binary")
    sets = checkpointed(likely(sets, wanted.select(F.col("node").alias("doc")), "doc").dropDuplicates(["doc"]))
    one = sets.select(F.col("doc").alias("u"), F.col("data").alias("a"))
    two = sets.select(F.col("doc").alias("v"), F.col("data").alias("b"))
    full = pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v").select("u", "v", "a", "b")
    return full.mapInArrow(_confirm(percent), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose k-word shingle sets have Jaccard ``>= percent`` / 100.

    Takes ``doc_id, text`` (further columns are ignored) and returns one row
    per input row: ``doc_id, n_shingles, component_id, kept``.
    ``component_id`` is the smallest linked doc_id, itself included; ``kept``
    says that it is the row's own.  Null or wordless texts have no shingles
    and link with nothing; a row with a null id links with nothing, has a null
    component and is kept.  Rows of the same id are linked, whatever their
    texts, and links of any of them count.  ``doc_id`` must be an integer or its
    text (other texts raise an error).  An empty table gives an empty result.

    Shuffled: set keys, index keys of class representatives, and bitmaps of
    those that share a key with another.  Texts move only for confirmation.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = checkpointed(docs.mapInArrow(_sets(k), "doc_id long, n_shingles long, set_key binary, sig binary, node long"))
    classes = checkpointed(seen.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("node").alias("node"), F.count("*").alias("copies"), F.max("sig").alias("sig")))

    keys = classes.select("node", "sig").mapInArrow(_keys, "key long, doc long")
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"), F.min("doc").alias("lead")).where("size > 1")
    # keys with the same members do the same work: one of them stays
    shared = checkpointed(shared.groupBy("size", "x", "y", "lead").agg(F.min("key").alias("key")).select("key", "size", "lead"))
    members = checkpointed(skew_join(likely(keys, shared, "key"), shared, ["key"], "size").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("blocks")).cast("int")))

    ids = checkpointed(members.select(F.col("doc").alias("node")).distinct().join(classes.select("node", F.col("rep").alias("doc_id")).hint("merge"), "node"))
    maps = checkpointed(likely(docs, ids, "doc_id").mapInArrow(_shingled(k, "bitmap"), "doc long, n long, data binary").dropDuplicates(["doc"]))

    leads = shared.where(f"size > {BLOCK}").select("key", F.col("lead").alias("doc"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("block"))
    dealt = members.select("key", "doc", "block").unionByName(leads)
    forest = dealt.join(maps.hint("merge"), "doc").groupBy("key", "block").applyInPandas(_forest(percent), "u long, v long").distinct()
    first = checkpointed(_verified(checkpointed(forest), docs, classes, k, percent))
    merged = checkpointed(components(first))

    placed = members.join(merged.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    mixed = checkpointed(mixed.select("key", F.col("size").alias("n_members")))
    open_ = skew_join(placed.drop("size"), mixed, ["key"], "n_members")
    spread = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", "doc", "component", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    rest = spread.join(maps.hint("merge"), "doc").groupBy("key", "p", "q").applyInPandas(_across(percent), "u long, v long").distinct()
    second = _verified(checkpointed(rest), docs, classes, k, percent)
    # texts of one id are linked, whatever they say
    span = seen.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("doc_id", "v")
    span = checkpointed(span)
    twin = likely(seen.select("doc_id", F.col("node").alias("u")), span, "doc_id").join(span.hint("merge"), "doc_id").select("u", "v")
    linked = components(first.unionByName(second).unionByName(twin))

    found = checkpointed(classes.join(linked.hint("merge"), "node", "left").select("set_key", "copies", "rep", F.coalesce("component", "node").alias("component")))
    least = checkpointed(found.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")))
    found = checkpointed(skew_join(found, least, ["component"], "m").select("set_key", "copies", "component_id"))
    grouped = seen.where("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", "set_key")
    grouped = skew_join(grouped, found, ["set_key"], "copies").select("doc_id", "n_shingles", "component_id")
    alone = seen.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, less the near copies: the smallest doc_id of a component stays.

    Of rows that repeat an id, the one whose text has the least hash stays, if
    the id does; rows with a null id all stay.
    """
    found = near_duplicates(docs, k, percent)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    ids = checkpointed(ids.where("not kept or rows > 1").select(F.col("doc_id").alias("_id"), "kept"))
    number, keep = unused(docs.columns, "number", "stays")
    marked, flag = maybe(docs.withColumn(number, F.col("doc_id").cast("long")), ids.select(F.col("_id").alias(number)), number)
    told = marked.where(flag).join(ids.select(F.col("_id").alias(number), F.col("kept").alias(keep)).hint("merge"), number, "left")
    plain = told.where(F.col(keep).isNull()).select(*docs.columns)
    # one row of each repeated id, taken by map-side minima
    whole = F.struct(*docs.columns)
    one = told.where(keep).groupBy(number).agg(F.min_by(whole, F.struct(F.xxhash64("text"), "text")).alias("_row")).select("_row.*")
    return marked.where(~F.col(flag)).select(*docs.columns).unionByName(plain).unionByName(one)
