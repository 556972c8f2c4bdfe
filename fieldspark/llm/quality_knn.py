"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed byte trigrams, with a few terms for repeated
words; logarithms of the counts are weighed by rarity and projected on the
leading singular vectors of a labelled sample.  The sample's vectors are
broadcast; every document is compared with all of them in blocks of exact
cosine products, and its nearest neighbours vote with their similarities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._shingles import SLICE, distinct, texts_of, word_batches

#: Labelled rows that are learned, at most; chosen by a hash of the id.
SAMPLE_ROWS = 4_000
TERMS = 2048
RANK = 32
NEIGHBOURS = 15
#: At and above this score a document is predicted good.
GOOD = 0.7

_REPEAT_TERMS = 2


def held_out() -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(column) -> np.ndarray:
    """Term counts of each row: byte trigrams, neighbours that are equal, and words that recur."""
    out = np.zeros((len(column), TERMS + _REPEAT_TERMS), np.float32)
    for i, (text, words) in enumerate(zip(texts_of(column), word_batches(column), strict=True)):
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE + 2].astype(np.uint32)
            if len(part) > 2:
                code = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA6B) + part[2:] * np.uint32(0xC2B2AE35)
                out[i, :TERMS] += np.bincount((code >> np.uint32(13)) % np.uint32(TERMS), minlength=TERMS)
        if len(words) > 1:
            out[i, TERMS] = np.count_nonzero(words[1:] == words[:-1])
            out[i, TERMS + 1] = len(words) - len(distinct(words))
    return out


def _weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Unit rows of damped relative frequencies times rarity; a row of zeros stays."""
    total = counts[:, :TERMS].sum(axis=1, keepdims=True)
    share = np.log1p(1000 * counts / np.maximum(total, 1)) * rarity
    return share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        seen = (counts > 0).sum(axis=0)
        self.rarity = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
        rows = _weighed(counts, self.rarity)
        draw = np.random.default_rng(5).standard_normal((rows.shape[1], min(RANK + 16, *rows.shape))).astype(np.float32)
        basis = rows @ draw
        for _ in range(4):  # randomised subspace iteration
            basis, _ = np.linalg.qr(rows.T @ np.linalg.qr(basis)[0])
            basis = rows @ basis
        q, _ = np.linalg.qr(basis)
        self.axes = np.linalg.svd(q.T @ rows, full_matrices=False)[2][:RANK].T.astype(np.float32)
        self.prior = float(labels.mean())
        self.vectors = self._unit(rows @ self.axes)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours, and all that tie with the last."""
        near = self._unit(_weighed(counts, self.rarity) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= last, np.maximum(near, 0), 0).astype(np.float64)
        total = weight.sum(axis=1)
        out = np.full(len(counts), self.prior)
        some = total > 0
        out[some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def _vectors(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in terms(part.column(1))], pa.binary())], ["label", "counts"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn ``labels(doc_id, quality)`` of docs; None without a labelled document.

    At most ``rows`` documents are used, those with the smallest hash of their
    id, so what reaches the driver has a fixed bound.  Of rows that repeat an
    id the first text in order counts, and of labels the highest.
    """
    marks = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label")).where(~held_out())
    chosen = marks.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    picked = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    got = picked.mapInArrow(_vectors, "label int, counts binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["label", "counts"])  # the same model whatever order rows come in
    return Model(np.frombuffer(b"".join(got["counts"]), np.float32).reshape(len(got), -1), got["label"].to_numpy())


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = model.score(terms(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``doc_id, text``.

    The score is from 0 to 1, higher where label 1 is likelier; ``predicted``
    is 1 from GOOD on.  The NEIGHBOURS nearest labelled vectors vote, and with
    them all that are as near as the last one.  A text without a term (null, empty, under three bytes)
    gets the sample's share of label 1, and every row gets 0.5 if there is
    nothing to learn from.  Other columns are ignored; null ids and repeated
    rows pass through.  Rows aren't shuffled.
    """
    model = model or train(docs, labels)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    if model is None:
        found = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        found = rows.mapInArrow(_score(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
