"""Language identification by known words, backing off to character n-grams.

A word that the model knows is scored by its log frequency in each language.
An unseen word falls back to its four-letter sequences, then to shorter ones,
until some are known.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._spark import checkpointed, pieces

#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 8_000
LONGEST = 4
UNKNOWN = "und"
#: Documents below this mean word posterior are rejected by :func:`known_language`.
LEAST_SCORE = 0.15

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def words_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text) if w.isalpha() or any(c.isalpha() for c in w)]


def grams_of(word: str, n: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1) if edged[i : i + n] != " "]


def _counted(expand):
    """(lang, n, gram, count), partly summed in each task."""

    def run(batches):
        counts: dict = {}

        def flush():
            rows = [(lang, n, gram, c) for (lang, n), found in counts.items() for gram, c in found.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "n", "gram", "c"])

        for batch in batches:
            size = 0
            for lang, text, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for n, gram, c in expand(text):
                    found = counts.setdefault((lang, n), {})
                    found[gram] = found.get(gram, 0) + c * times
                size += 1
                if size % 500 == 0 and sum(map(len, counts.values())) > 300_000:
                    yield flush()
        yield flush()

    return run


def _words(text):
    return [(0, word, c) for word, c in Counter(words_of(text.lower())).items()]


def _grams(word):
    return [(n, gram, 1) for n in range(1, LONGEST + 1) for gram in grams_of(word, n)]


class Model:
    """Log frequencies: row ``index[n][gram]`` of ``tables[n]`` has a value per language; row 0 is zero."""

    def __init__(self, langs: list[str], index: list[dict[str, int]], tables: list[np.ndarray]):
        self.langs, self.index, self.tables = langs, index, tables

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log posteriors of the languages for each word, and whether no sequence of it is known."""
        out = np.zeros((len(words), len(self.langs)))
        at = np.fromiter((self.index[0].get(w, 0) for w in words), np.int64, len(words))
        out[at > 0] = self.tables[0][at[at > 0]]
        left = np.flatnonzero(at == 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            get = self.index[n].get
            at = np.fromiter((get(g, 0) for found in grams for g in found), np.int64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(left)), sizes)
            known = np.bincount(owner[at > 0], minlength=len(left)) > 0
            for i in range(len(self.langs)):
                out[left, i] = np.bincount(owner, self.tables[n][at, i], minlength=len(left))
            left = left[~known]
        unknown = np.zeros(len(words), bool)
        unknown[left] = True
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True)), unknown

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Sums over each token's words: log posteriors, posteriors, their number and that of the unknown ones."""
        n = len(self.langs)
        words, owner = [], []
        for i, token in enumerate(tokens):
            for word in (token,) if token.isalpha() else words_of(token):
                words.append(word)
                owner.append(i)
        out = np.zeros((len(tokens), 2 * n + 2))
        if words:
            scores, unknown = self.words(words)
            np.add.at(out, owner, np.concatenate([scores, np.exp(scores), np.ones((len(words), 1)), unknown[:, None]], axis=1))
        return out


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on ``doc_id, text, lang``; rows without a text or lang don't count.

    At most ``rows`` documents are used, those with the smallest hash of their
    id (the only bound); all their words and sequences count.  None if there is
    nothing to learn from.
    """
    docs = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    last = docs.select("h").orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return None
    shape = "lang string, n int, gram string, c long"
    words = docs.where(F.col("h") <= last).select("lang", "text", F.lit(1)).mapInArrow(_counted(_words), shape).groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    words = checkpointed(words)
    grams = words.select("lang", F.col("gram").alias("text"), "c").mapInArrow(_counted(_grams), shape).groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counted = checkpointed(words.unionByName(grams))
    sums = {(r["lang"], r["n"]): r["total"] + 0.5 * r["kinds"] for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).collect()}
    langs = sorted({lang for lang, _ in sums})
    wide = counted.groupBy("n", "gram").agg(*(F.sum(F.when(F.col("lang") == x, F.col("c")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)))
    got = wide.toArrow()  # of the sample only
    index, tables = [], []
    for n in range(LONGEST + 1):
        part = got.filter(pc.equal(got["n"], n)).sort_by("gram")
        index.append({gram: i for i, gram in enumerate(part["gram"].to_pylist(), 1)})
        counts = np.stack([part[f"c{i}"].to_numpy() for i in range(len(langs))], axis=1)
        spread = np.array([sums.get((x, n), 1e6) for x in langs], float)
        tables.append(np.concatenate([np.zeros((1, len(langs))), np.log((counts + 0.5) / spread)]))
    return Model(langs, index, tables)


def _predict(shared, evidence: bool = False):
    """Rows of (doc_id, held_out, lang_pred, score), with evidence also the share of unknown words."""

    def run(batches):
        model = shared.value
        n = len(model.langs)
        place: dict[str, int] = {}
        table = np.empty((1024, 2 * n + 2))
        for batch in batches:
            langs, scores, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                found = Counter((text or "").lower().split())
                if len(place) + len(found) > _CACHE:
                    place.clear()
                if fresh := [t for t in found if t not in place]:
                    while len(place) + len(fresh) > len(table):
                        table = np.concatenate([table, np.empty_like(table)])
                    table[len(place) : len(place) + len(fresh)] = model.tokens(fresh)
                    for token in fresh:
                        place[token] = len(place)
                times = np.fromiter(found.values(), np.float64, len(found))
                total = times @ table[[place[w] for w in found]] if found else np.zeros(2 * n + 2)
                if total[2 * n]:
                    best = int(np.argmax(total[:n]))
                    langs.append(model.langs[best])
                    scores.append(min(1.0, float(total[n + best] / total[2 * n])))
                    unknown.append(float(total[2 * n + 1] / total[2 * n]))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    unknown.append(1.0)
            columns = {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            if evidence:
                columns["unknown"] = pa.array(unknown, pa.float64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def held_out() -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``doc_id, text, lang``.

    Without a model, one is trained on the rows that aren't held out.  A null
    text, or one without a letter, gives ``und`` and score 0, as does every
    row when there is nothing to learn from.  Otherwise the language with the
    highest sum of log posteriors over words wins (the first by name on ties)
    and the score is the mean posterior of that language over the words.
    Other columns are ignored; null ids and repeated rows pass through.
    """
    model = model or train(docs.where(~held_out()))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    predict = _predict(shared)
    return rows.mapInArrow(lambda batches: predict(pieces(batches, 1)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is known well enough.

    Rejected are texts without letters, those whose score is under ``least``,
    and those where words without a known sequence at any length dominate: over
    half of all, as in a script that the model never saw.  With nothing to
    learn from, all texts with a letter stay.  The prediction works on the row
    itself, so no join is needed.
    """
    model = train(docs.where(~held_out()))
    if model is None:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    predict = _predict(shared, evidence=True)

    def run(batches):
        for batch in pieces(batches, "text"):
            none = pa.nulls(batch.num_rows)
            view = pa.RecordBatch.from_arrays([none, batch.column("text").cast(pa.string()), none], ["doc_id", "text", "held_out"])
            for made in predict([view]):
                keep = [lang != UNKNOWN and score >= least and unknown <= 0.5 for lang, score, unknown in zip(*(made.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
