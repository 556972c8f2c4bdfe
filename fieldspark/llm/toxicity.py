"""Toxicity by compression distance: two zstandard dictionaries, toxic and ordinary.

A text is cut at word starts into windows of about WINDOW bytes.  Each window
is compressed with a dictionary trained on ordinary text and with one trained
on toxic text; by how many bytes the second is shorter is the window's gain.
Gains over several calibrated thresholds are counted, and a logistic curve
fitted on the labelled sample turns the counts of a text into its score.

Both dictionaries begin with the same segments, which zstandard's own trainer
chose from ordinary windows; without that shared part, gains of a few bytes by
chance hide the rest.  The toxic one ends with segments that are frequent in
toxic and rare in ordinary documents, chosen greedily as the trainer does, each
covering the words that hold it.  The ordinary one ends with as many bytes
again from its own start, so offsets cost the same in both.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned, at most, chosen by a hash of the id; of each text at most LONGEST bytes long.
TOXIC_ROWS, ORDINARY_ROWS, LONGEST = 1_500, 3_000, 16_384
#: At and above this score a document is predicted toxic.
TOXIC = 0.5
WINDOW = 64
#: A window may start so much later than a multiple of WINDOW, to start at a word.
SNAP = 32
#: Bytes of the shared part and, at most, of segments.
SHARED, SEGMENTS = 65_536, 2_048
#: Pull of the logistic weights towards 0.
RIDGE = 1.0
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
#: Level and shortest match of the compressors: short ones find short words, long ones fewer chance matches.
SETTINGS = ((3, 5), (5, 4))
#: Bytes that are windowed at a time, a multiple of WINDOW; longer texts go in such slices.
SLICE = WINDOW << 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = bytes(_LOWER)
_LENGTHS = range(5, 13)
#: The trainer puts three offsets between its tables and the content.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def held_out() -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined lower-cased bytes of texts, and start, size and text of each window."""
    sizes = np.array([len(x) for x in texts], np.int64)
    stops = np.cumsum(sizes)
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    space = _SPACE[data]
    words = np.append(np.flatnonzero(space[:-1] & ~space[1:]) + 1, len(data))
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    plain = (stops - sizes)[text] + nth * WINDOW
    word = words[np.searchsorted(words, plain)]
    start = np.where((nth > 0) & (word < plain + SNAP) & (word < stops[text]), word, plain)
    stop = np.where(np.append(nth[1:] == 0, True), stops[text], np.append(start[1:], len(data)))
    return data, start, stop - start, text


def _compressor(content: bytes, level: int, least: int) -> zstandard.ZstdCompressor:
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
    parameters = zstandard.ZstdCompressionParameters.from_level(level, min_match=least, window_log=18, hash_log=18, chain_log=18, **bare)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _lengths(compressor, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    places = np.stack([start, size], axis=1).astype(np.uint64).tobytes()
    made = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data.tobytes(), places))
    return np.fromiter((len(x) for x in made), np.int64, len(made))


def features(gain: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts: the largest gain, the mean, and number and share of windows from each threshold on."""
    windows = np.bincount(text, minlength=n)
    top = np.full(n, -5.0)
    np.maximum.at(top, text, gain)
    out = [top, np.bincount(text, weights=gain, minlength=n) / np.maximum(windows, 1)]
    for least in THRESHOLDS:
        found = np.bincount(text, weights=gain >= least, minlength=n)
        out += [np.log1p(found), found / np.maximum(windows, 1)]
    return np.array(out).T


def _words(text: bytes) -> set[bytes]:
    return {w for w in (w.strip(b".,;:!?\"'()") for w in text.translate(_FOLD).split()) if 0 < len(w) <= 40}


def _originals(texts: list[bytes]) -> list[bytes]:
    """texts without near copies of earlier ones, told by their least shingle hashes; copies would make chance words look typical."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.translate(_FOLD).split()
        hashes = {zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
        least = sorted(hashes)[: max(1, min(8, len(hashes) // 4))]
        if not seen.intersection(least):
            seen.update(least)
            out.append(text)
    return out


def _segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Strings that toxic documents hold far more often than ordinary ones, best first."""
    nt, no = len(toxic), len(ordinary)

    def evidence(a: int, b: int) -> float:
        """Of a toxic and b ordinary documents: likelihood ratio against equal shares, 0 if toxic ones have less than four times the share."""
        if (a + 0.5) / (nt + 1) < 4 * (b + 0.5) / (no + 1):
            return 0.0
        return 2 * (a * math.log(a * (nt + no) / ((a + b) * nt)) + (b * math.log(b * (nt + no) / ((a + b) * no)) if b else 0))

    def strings(word: bytes) -> set[bytes]:
        padded = b" " + word + b" "
        return {padded[i : i + n] for n in _LENGTHS for i in range(len(padded) - n + 1)}

    held = [_words(t) for t in toxic]
    here = Counter(w for words in held for w in words)
    there = Counter(w for t in ordinary for w in _words(t))
    parts = {w: strings(w) for w, a in here.items() if evidence(a, there[w])}
    counts = Counter(s for words in held for s in set().union(*(parts.get(w, ()) for w in words)))
    bar = 2 * math.log(max(20, sum(1 for c in counts.values() if c > 1)))
    able = {s for s, c in counts.items() if evidence(c, 0) >= bar}
    common: Counter = Counter()  # over words, so rather too high
    for w, b in there.items():
        for s in strings(w) & able:
            common[s] += b
    parts = {w: kept for w, own in parts.items() if (kept := own & able)}
    live = [{w for w in words if w in parts} for words in held]
    counts = Counter(s for words in live for s in set().union(*(parts[w] for w in words)))
    chosen: list[bytes] = []
    while sum(map(len, chosen)) < SEGMENTS:
        worth = {s: e * min(1, (len(s) - 2) / 6) for s, c in counts.items() if c and (e := evidence(c, common[s])) >= bar}
        if not worth:
            break
        best = max(worth, key=lambda s: (worth[s], s))
        chosen.append(best)
        for words in live:
            gone = {w for w in words if best in parts[w]}
            if gone:
                before = set().union(*(parts[w] for w in words))
                words -= gone
                counts.subtract(before.difference(*(parts[w] for w in words)))
    return chosen


class Model:
    """Two dictionaries and the weights of the logistic curve; at most some 150 KB."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], prior: float):
        toxic, ordinary = _originals(toxic), _originals(ordinary)
        self.prior = prior
        self._made = None
        self.segments = _segments(toxic, ordinary)
        shared, extra = self._shared(ordinary), b"".join(reversed(self.segments))
        self.ordinary, self.toxic = shared + (shared * (len(extra) // max(1, len(shared)) + 1))[: len(extra)], shared + extra
        x = np.vstack([self.features(toxic), self.features(ordinary)])
        y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = np.zeros(x.shape[1] + 1)
        # copies are gone and classes are sampled apart: weights restore the share of toxic labels
        w = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
        a = self._design(x)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))
            slope = (a.T * (w * p * (1 - p))) @ a + RIDGE * np.eye(a.shape[1])
            self.weights -= np.linalg.solve(slope, a.T @ (w * (p - y)) + RIDGE * self.weights)

    @staticmethod
    def _shared(ordinary: list[bytes]) -> bytes:
        data, start, size, _ = windows(ordinary)
        samples = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True) if n >= 8]
        order = np.random.default_rng(1).permutation(len(samples))[:100_000]
        samples = [samples[i] for i in order]
        try:
            made = zstandard.train_dictionary(SHARED, samples, k=48, d=8).as_bytes()
            return made[made.index(_OFFSETS) + len(_OFFSETS) :]
        except (zstandard.ZstdError, ValueError):  # too few samples to train on: they all fit
            return b"".join(samples)[-SHARED:]

    def __getstate__(self):
        return {**self.__dict__, "_made": None}  # compressors stay in their process

    def gains(self, data, start, size) -> list[np.ndarray]:
        """Each window's gain, by each of SETTINGS."""
        if self._made is None:
            self._made = [tuple(_compressor(x, *setting) for x in (self.ordinary, self.toxic)) for setting in SETTINGS]
        return [_lengths(ordinary, data, start, size) - _lengths(toxic, data, start, size) for ordinary, toxic in self._made]

    def features(self, texts: list[bytes]) -> np.ndarray:
        if not sum(map(len, texts)):
            data = start = size = text = np.empty(0, np.int64)
            found = [data] * len(SETTINGS)
        else:
            data, start, size, text = windows(texts)
            found = self.gains(data, start, size)
        return np.concatenate([features(gain, text, len(texts)) for gain in found], axis=1)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.append((x - self.mean) / self.scale, np.ones((len(x), 1)), axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, in batches of about SLICE bytes; a longer text has the greatest score of its slices."""
        slices = [(i, t[at : at + SLICE]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), SLICE)]
        out = np.zeros(len(texts))
        at = 0
        while at < len(slices):
            end, total = at, 0
            while end < len(slices) and total < SLICE:
                total += len(slices[end][1])
                end += 1
            z = self._design(self.features([t for _, t in slices[at:end]])) @ self.weights
            found = np.where([bool(t) for _, t in slices[at:end]], 1 / (1 + np.exp(-np.clip(z, -500, 500))), self.prior)
            np.maximum.at(out, [i for i, _ in slices[at:end]], found)
            at = end
        return out


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | float:
    """Learn ``labels(doc_id, toxic)`` of docs; the share of toxic labels if only one class, or none, has a text.

    The documents of each class with the smallest hashes of their ids count, so
    what reaches the driver has a fixed bound.  Of rows that repeat an id the
    first text in order counts, and of labels the highest.
    """
    marks = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out())
    marks = marks.groupBy("doc_id").agg((F.max("label") > 0).alias("label"))
    prior = marks.agg(F.avg(F.col("label").cast("int"))).first()[0] or 0.0
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    pools = []
    for label, rows in ((True, toxic_rows), (False, ordinary_rows)):
        chosen = marks.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")
        got = texts.join(F.broadcast(chosen), "doc_id").where(F.length("text").between(1, LONGEST)).groupBy("doc_id").agg(F.min("text").alias("text"))
        pools.append(got.select(F.lit(label).alias("label"), F.xxhash64("doc_id").alias("h"), "text"))
    got = sorted(pools[0].unionByName(pools[1]).collect(), key=lambda r: (r["h"], r["text"]))
    toxic, ordinary = ([bytes(r["text"]) for r in got if r["label"] == label] for label in (True, False))
    return Model(toxic, ordinary, prior) if toxic and ordinary else float(prior)


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                found = model.score([t or b"" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | float | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``doc_id, text``.

    The score is from 0 to 1, higher where toxic is likelier; ``predicted`` is
    1 from TOXIC on.  A null or empty text gets the share of toxic labels, and
    so do all if no document, or only one class, can be learned from (0.0
    without labels).  Whole texts
    count: one of over SLICE bytes goes in slices and gets its greatest score.
    Other columns are ignored; null ids and repeated rows pass through.  Rows
    aren't shuffled.
    """
    model = train(docs, labels) if model is None else model
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), held_out().alias("held_out"))
    if isinstance(model, float):
        found = rows.select("doc_id", "held_out", F.lit(model).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        found = rows.mapInArrow(_score(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
