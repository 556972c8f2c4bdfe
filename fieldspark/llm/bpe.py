"""Byte-level BPE in DuckDB: recursive queries over token-position rows.

Each task splits its texts into pieces and remembers the pieces that it has
seen.  New ones go to DuckDB as rows (word, position, next position, token,
next token).  A recursive query joins them to the merge table and contracts
each word's leftmost pair of minimum rank, until no pair is left.  Decoding
joins ids to the vocabulary and aggregates the bytes in order.

Words over WINDOW bytes are contracted in windows that overlap by half.  Where
two windows have a token in common, the sequence may change from one window to
the other: tokens are the encoding of their bytes exactly if each two
neighbours encode to themselves, and both windows' tokens do.  Where they have
none, as in runs of one character, the next window starts at a token of the
last one.  So a word takes time in proportion to its length; windows grow only
where that fails too.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of pieces that a task remembers in each of two generations.
MEMORY = 160 << 20
#: Rows over all steps of one recursive query (a longer window goes alone).
ROWS = 2_000_000
#: Token rows that one decoding query starts with.
DECODE_ROWS = 100_000
#: Bytes up to which a word is contracted in one piece, and of the windows of longer ones.
WINDOW = 64
#: Characters of a text that are split at a time.
SEGMENT = 1 << 20

# k is (rank, position) of a row's pair; a contracted pair's right row takes the left row's place
_CONTRACT = """
with recursive step(w, p, q, t, n, k, s) as (
  select w, p, p + 1, t, n, (rank::bigint << 32) | p, 0 from work left join merges on t = l and n = r
  union all
  (with least as (select w, (min(k) & 4294967295)::int as p, arg_min(q, k) as q, (min(k) >> 32)::int as rank from step where k is not null group by w),
   moved as (select x.w, if(x.p = y.q, y.p, x.p) as p, x.q, if(x.p = y.q, y.rank, x.t) as t, if(x.q = y.p, y.rank, x.n) as n, s + 1 as s
             from step x join least y using (w) where x.p <> y.p)
   select w, p, q, t, n, (rank::bigint << 32) | p, s from moved left join merges on t = l and n = r)),
last as (select w, max(s) as s from step group by w)
select w, p, q, t from step join last using (w, s)
"""

_DECODE = "select w, unhex(string_agg(h, '' order by p)) as b from {rows} join vocabulary using (t) group by w"


class Codec:
    """Ranks in DuckDB, with the pieces that were met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pieces = regex.compile(pattern)
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.young: dict[str, tuple[str, bytes]] = {}  # pieces to ids, joined by commas, and the bytes that these decode to
        self.old: dict[str, tuple[str, bytes]] = {}
        self.size = 0
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        m = pa.table([pa.array([x[i] for x in merges], pa.int32()) for i in range(3)], ["l", "r", "rank"])
        v = pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array([t.hex() for t in ranks])], ["t", "h"])
        self.db.register("_m", m)
        self.db.register("_v", v)
        self.db.execute("create table vocabulary as from _v")
        self.db.execute("create table merges as from _m")

    def query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def contract(self, words: list[bytes]) -> pa.Table:
        """Rows (w, p, q, t): token t of word w from byte p to q."""
        sizes = np.array([len(x) for x in words])
        ends = np.cumsum(sizes)
        tokens = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.append(tokens[1:], -1).astype(np.int32)
        after[ends - 1] = -1
        work = pa.table([np.repeat(np.arange(len(words), dtype=np.int32), sizes), (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32), tokens, after], ["w", "p", "t", "n"])
        return self.query(_CONTRACT, work=work)

    def batches(self, words: list[bytes]) -> list[pa.Table]:
        """:meth:`contract` in queries of a bounded number of rows; ``w`` counts through."""
        out, at = [], 0
        while at < len(words):
            end, rows = at, 0
            while end < len(words) and (end == at or rows + len(words[end]) ** 2 // 2 <= ROWS):
                rows += len(words[end]) ** 2 // 2 + 1
                end += 1
            found = self.contract(words[at:end])
            out.append(found.set_column(0, "w", pa.array(np.asarray(found["w"]) + np.int32(at))))
            at = end
        return out

    def long(self, word: bytes) -> pa.Table:
        """Rows (p, t) of a word over WINDOW bytes.

        Windows at fixed places are contracted together, equal ones once.  From
        one to a later one the sequence changes at a token that both have.  In
        a run of equal characters they may never have one, as they cut it at
        different places; the next window then starts at one of the last
        window's tokens.  In a run such windows are alike, so few are new.
        """
        known: dict[bytes, list[tuple[int, int, int]]] = {}

        def contracted(parts) -> None:
            new = [x for x in dict.fromkeys(parts) if x not in known]
            for table in self.batches(new):
                for w, p, q, t in sorted(zip(*(table[c].to_pylist() for c in ("w", "p", "q", "t")), strict=True)):
                    known.setdefault(new[w], []).append((p, q, t))

        half = WINDOW // 2
        fixed = range(0, max(1, len(word) - half), half)
        contracted(word[i : i + WINDOW] for i in fixed)
        out: list[tuple[int, int]] = []
        least = width = WINDOW
        start = at = 0  # of the window in use, and the place from which its tokens aren't taken yet
        while True:
            contracted([word[start : start + width]])
            now = [(start + p, start + q, t) for p, q, t in known[word[start : start + width]] if start + p >= at]
            if start + width >= len(word):
                return pa.table([pa.array([p for p, _ in out] + [p for p, _, _ in now], pa.int64()), pa.array([t for _, t in out] + [t for _, _, t in now], pa.int32())], ["p", "t"])
            following = set(now)
            to = seam = None
            for i in range(start // half + 1, len(fixed)):
                if fixed[i] >= start + width:
                    break
                shared = [p + fixed[i] for p, q, t in known[word[fixed[i] : fixed[i] + WINDOW]] if (p + fixed[i], q + fixed[i], t) in following]
                if shared:
                    to, seam = fixed[i], shared[0]
                    break
            if to is None:
                for p, q, t in sorted((x for x in now if x[0] > start), key=lambda x: abs(x[0] - start - width // 2)):
                    contracted([word[p : p + least]])
                    if known[word[p : p + least]][0] == (0, q - p, t):
                        to = seam = p
                        break
            if to is None:
                width *= 2  # from the same place; what was taken ends before a token that a wider window has too, or it starts anew
                contracted([word[start : start + width]])
                if at not in {start + p for p, _, _ in known[word[start : start + width]]}:
                    out, start, at, least = [], 0, 0, width
                continue
            out += [(p, t) for p, _, t in now if p < seam]
            start, width, at = to, least, seam

    def tokens(self, words: list[bytes]) -> pa.Table:
        """(w, p, t) rows of the encoded words."""
        # a word of the vocabulary is its own token
        own = [i for i, x in enumerate(words) if x in self.ranks]
        rest = [i for i, x in enumerate(words) if 0 < len(x) <= WINDOW and x not in self.ranks]
        done = [pa.table([pa.array(own, pa.int64()), pa.array([0] * len(own), pa.int64()), pa.array([self.ranks[words[i]] for i in own], pa.int32())], ["w", "p", "t"])]
        for found in self.batches([words[i] for i in rest]):
            done.append(pa.table([pa.array(np.array(rest)[np.asarray(found["w"])]), found["p"].cast(pa.int64()), found["t"]], ["w", "p", "t"]))
        for i, word in enumerate(words):
            if len(word) > WINDOW and word not in self.ranks:
                found = self.long(word)
                done.append(pa.table([pa.array(np.full(len(found), i)), found["p"], found["t"]], ["w", "p", "t"]))
        return pa.concat_tables(done)

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode pieces, and remember them."""
        words = [x.encode() for x in pieces]
        found = self.query("select w, string_agg(t::varchar, ',' order by p) as ids, string_agg(h, '' order by p) as h from rows join vocabulary using (t) group by w", rows=self.tokens(words))
        for w, ids, h in zip(*(found[c].to_pylist() for c in ("w", "ids", "h")), strict=True):
            self.young[pieces[w]] = ids, bytes.fromhex(h)
            self.size += 350 + len(ids) + 2 * len(words[w])

    def segments(self, text: str):
        """Parts of a text whose pieces are those of the whole: cut before a blank that follows no white space."""
        at = 0
        while at < len(text):
            end = at + SEGMENT
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end

    def encode(self, texts: list[str]):
        """(row, ids joined by commas, decoded bytes) of each text's segments, in order."""
        group, size = [], 0
        for i, text in enumerate(texts):
            for part in self.segments(text):
                group.append((i, self.pieces.findall(part)))
                size += len(part)
                if size >= SEGMENT:
                    yield from self._looked_up(group)
                    group, size = [], 0
        yield from self._looked_up(group)

    def _looked_up(self, group: list[tuple[int, list[str]]]):
        if self.size > MEMORY:  # what isn't used while the next generation grows is forgotten
            self.old, self.young, self.size = self.young, {}, 0
        new = []
        for x in set().union(*(pieces for _, pieces in group)):
            if x not in self.young:
                if (found := self.old.get(x)) is None:
                    new.append(x)
                else:
                    self.young[x] = found
                    self.size += 350 + len(found[0]) + 2 * len(found[1])
        if new:
            self.learn(new)
        get = self.young.__getitem__
        for i, pieces in group:
            ids, plain = zip(*map(get, pieces), strict=True) if pieces else ((), ())
            yield i, ",".join(ids), b"".join(plain)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def _run(path: str, pattern: str, digest: bool):
    def run(batches):
        coder = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n = [0] * batch.num_rows
                ids, plain, all_ids = ([make() for _ in n] for make in (hashlib.sha256, hashlib.sha256, list))
                for i, joined, data in coder.encode([t or "" for t in batch.column(1).to_pylist()]):
                    if digest:
                        ids[i].update(("," if n[i] else "").encode() + joined.encode())
                        plain[i].update(data)
                    else:
                        all_ids[i] += map(int, joined.split(","))
                    n[i] += joined.count(",") + 1
                if digest:
                    columns = [pa.array([x.hexdigest() for x in made], pa.string()) for made in (ids, plain)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [pa.array(all_ids, pa.list_(pa.int32()))]
                    names = ["doc_id", "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *columns], names)

    return run


def _rows(docs: DataFrame):
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row of ``doc_id, text``; see :func:`round_trip`."""
    rows, kind = _rows(docs)
    return rows.mapInArrow(_run(path, pattern, False), f"doc_id {kind}, n_tokens long, ids array<int>")


def _decode(path: str, pattern: str):
    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            out: list = [b""] * batch.num_rows
            ids = batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                end, w, t, p = at, [], [], []
                while end < len(ids) and (end == at or len(t) < DECODE_ROWS):
                    own = ids[end] or []
                    w += [end] * len(own)
                    p += range(len(own))
                    t += own
                    end += 1
                coder.db.register("rows", pa.table([pa.array(w, pa.int32()), pa.array(p, pa.int32()), pa.array(t, pa.int32())], ["w", "p", "t"]))
                for i, data in coder.db.execute(_DECODE.format(rows="rows")).fetchall():
                    out[i] = bytes(data)
                coder.db.unregister("rows")
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "data"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes of each row's ``ids``; null or no ids give none."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(_decode(path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each row's ids and of the bytes they decode to.

    Takes ``doc_id, text`` and returns ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``, one row per input row.  A null text is empty: no ids, and
    the digest of nothing twice.  Texts of any length go in segments.  Other
    columns are ignored; null ids and repeated rows pass through.  Needs no
    shuffle; each Python worker holds the merges and a bounded memory of pieces.
    """
    rows, kind = _rows(docs)
    return rows.mapInArrow(_run(path, pattern, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
