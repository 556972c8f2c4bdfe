"""Quality rules as a short-circuit cascade of Spark expressions.

Every rule is a boolean column over the base features and the text.  A small
sample is timed to learn each rule's cost and the share that it rejects, and
the rules are put in order of rejections per second.  One ``CASE`` expression
then evaluates them: a row that one rule rejects isn't shown to the next.
The order changes what is computed, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._spark import SPACES, checkpointed

WORD = SPACES.replace("[", "[^", 1)
#: Rows that the cascade's order is learned from, about; they change its speed only.
SAMPLE_ROWS = 400
#: Evaluations by which a rule is timed.
EVALUATIONS = 20_000


def bound(value: Column, use) -> Column:
    """``use(x)`` with x bound to value, which is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pair(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _window_hashes(hashes: Column, width: int) -> Column:
    """Hashes of the width-long windows of an array of hashes, by doubling."""
    if width == 1:
        return hashes
    if width % 2 == 0:
        part, step = _window_hashes(hashes, width // 2), width // 2
        return bound(part, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - step), F.slice(p, F.lit(step + 1), F.size(p) - step), _pair))
    part = _window_hashes(hashes, width - 1)
    return bound(part, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(hashes, F.lit(width), F.size(p) - 1), _pair))


def _covered(words: Column, width: int = 5) -> Column:
    """Words inside windows that are found twice or more; windows compare as texts."""
    starts = F.sequence(F.lit(0), F.size(words) - width)

    def window(i):  # slice() would copy the whole array for each window
        return [F.get(words, i + j) for j in range(width)]

    def exact(_):
        named = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))
        twice = bound(
            named,
            lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"])).alias("d"))), lambda x: x["d"]), lambda x: x["i"])),
        )
        return bound(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    hashes = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _window_hashes(h, width))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h))))


def features(docs: DataFrame) -> DataFrame:
    """``_doc_id, _text`` and the base features; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_doc_id"), text.alias("_text"))
    words = F.array_remove(F.split("_text", SPACES + "+"), "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    made = F.struct(
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _covered(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    # inline() keeps the optimiser from computing the features again for each use
    flat = rows.select("_doc_id", "_text", F.inline(F.array(made)))
    return flat.select("_doc_id", "_text", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def _count(pattern: str) -> Column:
    return F.length(F.regexp_replace("_text", pattern, ""))


#: name: rows for which it holds are rejected.
RULES: dict[str, Column | object] = {
    "symbols": lambda: F.col("n_symbols") * 20 > F.col("word_chars"),
    "duplicate_lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20),
    "capitals": lambda: _count("[^\\p{Lu}]+") * 2 > _count("[^\\p{L}]+"),
    "no_letters": lambda: _count("[^\\p{L}]+") * 2 < F.col("word_chars"),
    "shouting": lambda: _count("[^!]+") * 5 > F.col("n_words"),
}

BASE_FAILED = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"


def learn_order(docs: DataFrame, rules: dict | None = None, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second, measured on a sample of about ``rows`` rows.

    The sample is drawn at random, and stays in the cluster.  A rule's cost is
    the time of EVALUATIONS evaluations in one job, less that of a job that
    evaluates nothing; the least of two runs counts, as the first compiles.
    The rule with the most rejections per cost goes first, the next is judged
    by what the chosen ones let pass, and so on.  A table without rows, or
    without one that passes the base, leaves the rules as they stand.
    """
    rules = rules or RULES
    total = docs.count()
    if not total:
        return list(rules)
    drawn = docs.select("doc_id", "text").sample(fraction=min(1.0, rows / total), seed=11)
    sample = checkpointed(features(drawn).where(f"not {BASE_FAILED}"))
    verdicts = [F.coalesce(rule(), F.lit(False)).cast("int") * (1 << i) for i, rule in enumerate(rules.values())]
    seen = {r["v"]: r["n"] for r in sample.select(sum(verdicts[1:], verdicts[0]).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return list(rules)
    copies = -(-EVALUATIONS // sum(seen.values()))
    many = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def seconds(rule):
        spent = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(rule)).first()
            spent.append(time.perf_counter() - began)
        return min(spent)

    floor = seconds(F.col("_copy") > 0)
    cost = {name: max(seconds(rule()) - floor, 1e-4) for name, rule in rules.items()}
    bit = {name: 1 << i for i, name in enumerate(rules)}
    order: list[str] = []
    while len(order) < len(rules):
        rejected = {name: sum(n for v, n in seen.items() if v & bit[name]) for name in rules if name not in order}
        # where nothing is rejected any more, the cheap go first
        order.append(max(rejected, key=lambda name: (rejected[name] / cost[name], -cost[name])))
        seen = {v: n for v, n in seen.items() if not v & bit[order[-1]]}
    return order


def quality_rules(docs: DataFrame, rules: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """Features, ``base_failed`` and the cascade's verdict ``kept`` for each row.

    Takes ``doc_id, text``; other columns are ignored, whatever their names.
    Returns one row per input row.  A null or empty text has no words, fails
    the base and isn't kept.  Null ids and repeated rows pass through.
    ``rejected_by`` names the first rule that rejects the row (``base`` before
    all others; which other rule comes first depends on the learned order).
    Needs no shuffle: a row's features come from its own text.
    """
    rules = rules or RULES
    order = order or learn_order(docs, rules)
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        reason = reason.when(rules[name](), F.lit(name))
    rows = features(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rejected_by", reason)
    return rows.select(F.col("_doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
