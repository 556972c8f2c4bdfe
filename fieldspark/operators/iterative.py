"""Iterative operators (Q): components, suppression, splits and sampling."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Edges that one task contracts on its own; the number of tasks grows with the edges.
TASK_EDGES, TASK_NODES = 250_000, 1_000_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that ``spark.checkpoint.dir`` names; only local sessions may lack it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _united(batches):
    """Union-find over one task's edges; yields each node but the roots with its root."""
    import pandas as pd

    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush():
        links = [(x, root(x)) for x in parent]
        parent.clear()
        return pd.DataFrame([(x, r) for x, r in links if x != r], columns=["u", "v"])

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
        if len(parent) > TASK_NODES:  # what is left is joined in rounds
            yield flush()
    yield flush()


def min_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q2: ``(id, component)``, the smallest id reachable; ids are whole numbers.

    Tasks first contract up to TASK_EDGES edges each with a union-find, which
    settles chains and all small graphs.  What is left takes rounds of minima
    over neighbours and pointer jumping; labels only fall, so rounds end.
    """
    whole = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct()
    whole = cut_lineage(whole)
    parts = int(whole.count() // TASK_EDGES) + 1
    star = cut_lineage(whole.coalesce(parts).mapInPandas(_united, "u long, v long"))
    kind = nodes.schema["id"].dataType
    labels = nodes.select(F.col("id").cast("long").alias("id")).distinct()
    if parts == 1:  # one task has seen all edges
        return labels.join(star.select(F.col("u").alias("id"), "v"), "id", "left").select(F.col("id").cast(kind).alias("id"), F.coalesce("v", "id").cast(kind).alias("component"))
    both = cut_lineage(star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(labels.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("far"))
        made = cut_lineage(hooked.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("far", "component")).alias("component")))
        settled = made.where("was <> component").isEmpty()
        labels = made.select("id", "component")
        if settled:
            return labels.select(*(F.col(x).cast(kind).alias(x) for x in ("id", "component")))


def pixel_edges(mask: DataFrame) -> DataFrame:
    """Edges between set pixels that touch by a side; ids number the pixels of all tiles."""
    row, col = Window.partitionBy("tile_id", "r").orderBy("c"), Window.partitionBy("tile_id", "c").orderBy("r")
    right = mask.select(F.col("id").alias("u"), F.when(F.lead("c").over(row) == F.col("c") + 1, F.lead("id").over(row)).alias("v"))
    down = mask.select(F.col("id").alias("u"), F.when(F.lead("r").over(col) == F.col("r") + 1, F.lead("id").over(col)).alias("v"))
    return right.unionByName(down).where("v is not null")


def by_component(rows: DataFrame, decide, schema: str) -> DataFrame:
    """Run ``decide`` over whole components: it gets many at a time, as one pandas frame.

    Rows are dealt and sorted by ``component``; a task holds one batch of rows
    and the component that reaches over its end.
    """

    def run(batches):
        import pandas as pd

        held: list = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["component"].iloc[-1]
            done = batch[batch["component"] != last]
            if len(done):
                yield decide(pd.concat([*held, done]))
                held = []
            elif held and held[-1]["component"].iloc[-1] != last:
                yield decide(pd.concat(held))
                held = []
            held.append(batch[batch["component"] == last])
        if held:
            yield decide(pd.concat(held))

    return rows.repartition("component").sortWithinPartitions("component").mapInPandas(run, schema)


def split_by_size(rows: DataFrame, labels: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """rows with their ``component``, those of components of up to ``most`` rows and the others."""
    placed = cut_lineage(rows.join(labels.withColumnRenamed("id", key), key))
    large = cut_lineage(placed.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("component"))
    if large.isEmpty():
        return placed, placed.where("false")
    return placed.join(large, "component", "left_anti"), placed.join(large, "component", "left_semi")


def _greedy(rows):
    """States of the items of some components: best first, an item is kept unless a better neighbour is."""
    import pandas as pd

    links = rows[rows["v"].notna()]
    yields: dict = {}
    for u, v in zip(links["id"].tolist(), links["v"].tolist(), strict=True):
        yields.setdefault(u, []).append(v)
    items = rows[rows["v"].isna()].sort_values(["score", "id"], ascending=[False, True])
    kept: set = set()
    for i in items["id"].tolist():
        if not any(v in kept for v in yields.get(i, ())):
            kept.add(i)
    return pd.DataFrame({"id": items["id"], "state": ["kept" if i in kept else "dropped" for i in items["id"]]})


def suppress(items: DataFrame, conflicts: DataFrame, least: float = 0.25) -> DataFrame:
    """Q3: by falling score, keep what conflicts with nothing kept; equal to the greedy order.

    ``items(id, score)``, ``conflicts(u, v)``.  Components of up to TASK_EDGES
    rows are decided in one pass each, however long their chains.  In larger
    ones a round keeps every undecided item without a better undecided
    neighbour and drops that item's neighbours; the best undecided item is
    always kept, so rounds end.
    """
    rank = F.struct(F.col("score"), -F.col("id"))
    live = items.where(F.col("score") >= least).select("id", "score")
    both = conflicts.select("u", "v").unionByName(conflicts.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    better = both.join(live.select(F.col("id").alias("u"), rank.alias("ru")), "u").join(live.select(F.col("id").alias("v"), rank.alias("rv")), "v").where("rv > ru").select("u", "v")
    better = cut_lineage(better)  # u yields to v
    labels = min_labels(live.select("id"), better)
    kind = live.schema["id"].dataType.simpleString()
    rows = live.select("id", F.col("score").cast("double").alias("score"), F.lit(None).cast(kind).alias("v")).unionByName(better.select(F.col("u").alias("id"), F.lit(None).cast("double").alias("score"), "v"))
    small, large = split_by_size(rows, labels, "id", TASK_EDGES)
    state = cut_lineage(by_component(small, _greedy, f"id {kind}, state string"))
    if not large.isEmpty():
        large = cut_lineage(large)
        state = state.unionByName(_in_rounds(large.where("v is null").select("id"), large.where("v is not null").select(F.col("id").alias("u"), "v")))
    return items.join(state, "id", "left").withColumn("state", F.coalesce("state", F.lit("low_score")))


def _in_rounds(live: DataFrame, better: DataFrame) -> DataFrame:
    """``id, state`` by rounds over all at once."""
    state = cut_lineage(live.select("id", F.lit("open").alias("state")))
    while True:
        opened = state.where("state = 'open'")
        held = better.join(opened.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id")).distinct()
        kept = opened.join(held, "id", "left_anti").select("id", F.lit(True).alias("keep"))
        gone = better.join(kept.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id")).distinct().withColumn("drop", F.lit(True))
        after = state.join(kept, "id", "left").join(gone, "id", "left")
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("keep"), "kept").when(F.col("drop"), "dropped").otherwise("open")
        state = cut_lineage(after.select("id", new.alias("state")))
        if state.where("state = 'open'").isEmpty():
            return state


def group_split(tiles: DataFrame, group: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Q7: train, val or test for whole groups, in hash order up to each share of the tiles."""
    from fieldspark.operators.ranks import cumulated

    sizes = tiles.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", F.md5(F.col(group).cast("string")))
    placed = cumulated(sizes, [], ["h", group], "n", "before").crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total"))))  # one row
    part = F.when(F.col("before") < train * F.col("total"), "train").when(F.col("before") < (train + val) * F.col("total"), "val").otherwise("test")
    return placed.select(group, "n", part.alias("part"))


def downsample(rows: DataFrame, key: str, positive: str, hard: str, ratio: float = 2.0) -> DataFrame:
    """Q8: positives and hard negatives stay; easy negatives by hash share, to about ratio times the positives."""
    counts = rows.agg(F.count_if(positive).alias("p"), F.count_if((~F.col(positive)) & ~F.col(hard)).alias("e"))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("p") * ratio, F.col("e")), F.lit(1.0)))
    point = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.crossJoin(F.broadcast(counts)).where(F.col(positive) | F.col(hard) | (point < share)).drop("p", "e")
