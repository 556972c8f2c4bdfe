"""Brute-force comparisons and edge cases of the training-data operators."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from fieldspark.llm import bpe, exact_dedup, language_id, line_dedup, near_dedup, packing, pii, quality_knn, quality_rules, sharding
from fieldspark.llm._shingles import shingles, word_hashes

SMALL = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def rows():
    got = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


#: nulls in any column, empty and blank texts, ties, repeated rows, one long word, a clashing extra column
ODD = [
    (1, None, "en", "a", 0, "x"),
    (2, "", None, None, None, None),
    (3, " \t\n", "en", "a", 3, "x"),
    (4, "one two three four five six seven eight nine ten eleven", "en", "a", 10, "x"),
    (5, "one two three four five six seven eight nine ten eleven", "de", "b", 10, "y"),
    (5, "one two three four five six seven eight nine ten eleven", "de", "b", 10, "y"),
    (None, "one two three four five six seven eight nine ten eleven", "de", "b", 10, None),
    (6, "w" * 3000, "en", "a", 3000, "x"),
    (7, "12345 67890 !!!", "fr", "c", 1, "x"),
    (8, "word " * 3000, "en", "a", 15000, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE + ", shard string").withColumnRenamed("shard", "kept")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def test_no_crash_on_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    for op in (
        quality_rules.quality_rules, pii.find, language_id.identify, exact_dedup.exact_duplicates, near_dedup.near_duplicates, packing.pack, sharding.shards,
        lambda d: bpe.round_trip(d, *BPE), lambda d: quality_knn.score(d, labels), line_dedup.without_duplicate_lines,
    ):
        got = op(odd).collect()
        assert len(got) >= len(ODD), op
        assert op(empty).collect() == []


def test_pipeline_stages_on_odd_and_empty(spark, odd, empty):
    import corpus_pipeline

    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == start.columns
        docs.collect()


def test_quality_rule_order_keeps_verdicts(docs):
    names = list(quality_rules.RULES)
    one = quality_rules.quality_rules(docs, order=names).select("doc_id", "kept")
    two = quality_rules.quality_rules(docs, order=names[::-1]).select("doc_id", "kept")
    assert sorted(one.collect()) == sorted(two.collect())


def _pii_base(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_equals_patterns(docs, rows):
    got = {r["doc_id"]: r["base_sha256"] for r in pii.find(docs).collect()}
    assert got == {r[0]: hashlib.sha256(_pii_base(r[1]).encode()).hexdigest() for r in rows}
    cues, rng = pii.automaton(), random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("0123 1.1.+-()@@ab_%é\n25") for _ in range(rng.randint(0, 60)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in pii.spans(t, cues) if k in pii.BASE) == _pii_base(t)


def test_pii_added_spans_and_redaction():
    cues = pii.automaton()
    assert pii.redacted("iban: DE89 3704 0044 0532 0130 00.", cues) == "iban: [iban]."
    assert pii.redacted("iban: DE88 3704 0044 0532 0130 00.", cues).startswith("iban: DE88")
    assert pii.redacted("mail a.b@c.de now", cues) == "mail [email] now"
    assert pii.redacted("https://bob:pw@host.org/x", cues) == "https://[url_login]/x"
    assert pii.redacted("My account number is secret", cues) == "My account number is secret"


def test_pii_cues_and_schemes_in_any_case():
    cues = pii.automaton()
    for cue in pii.CUES:
        for form in (cue, cue.upper(), cue.title(), cue.capitalize(), cue.swapcase(), cue[:-1] + cue[-1].upper()):
            assert pii.redacted(f"İst ok. {form}: 12345678, {form} DE89 3704 0044 0532 0130 00", cues) == f"İst ok. {form}: [account], {form} [iban]"
    assert pii.redacted("Social security 123-45-6789", cues) == "Social security [account]"
    assert pii.redacted("Https://bob:pw@host.org/x HTTP://bob:pw@host.org/x", cues) == "Https://[url_login]/x HTTP://[url_login]/x"


def test_language_held_out_accuracy(docs):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_letters(odd):
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert got[7]["lang_pred"] == got[1]["lang_pred"] == "und"


def test_unlearned_scripts_are_rejected(spark, docs):
    # scripts of no character in the tables; the second and last have some words of theirs in known text
    text = docs.where("lang = 'en'").first()["text"]
    foreign = "ბევრი სიტყვა უცხო დამწერლობით " * 20
    planted = [(-1, foreign), (-2, foreign + " the"), (-3, "እንደምን አደርክ ወዳጄ"), (-4, text), (-5, text + " " + "ბევრი " * (len(text.split()) // 3))]
    mixed = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*x, None) for x in planted], "doc_id long, text string, lang string"))
    got = {r["doc_id"] for r in language_id.known_language(mixed).where("doc_id < 0").collect()}
    assert got == {-4, -5}
    assert language_id.known_language(docs).count() == docs.count()


def test_bpe_equals_library(docs, rows, odd):
    with open(BPE[0], "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, *BPE).collect()}
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(odd, *BPE)
    texts = [t or "" for _, t, *_ in ODD]
    assert sorted(bytes(r["data"]).decode() for r in bpe.decode(encoded, *BPE).collect()) == sorted(texts)


def test_bpe_odd_words():
    with open(BPE[0], "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.Codec(*BPE), random.Random(1)
    for size in [rng.randint(0, 60) for _ in range(60)] + [400]:
        text = "".join(rng.choice(["aaaa", "th", "the ", " e", "\n", "  ", "é", "日本", "😀", "1", "!!", "'s", "\t", "ab", "abab"]) for _ in range(size))
        assert ",".join(p[1] for p in coder.encode([text])) == ",".join(map(str, library.encode_ordinary(text)))
    for long in ("".join(rng.choice("abcdefgh") for _ in range(100_000)), "".join(rng.choice(["the", "tion", "ing", "é", "日本", "w"]) for _ in range(20_000)), "w" * 50_000, "ab" * 5_000, "é" * 7_001, "=" * 3_333, " " * 5_000):
        assert list(coder.encode([long]))[0][1] == ",".join(map(str, library.encode_ordinary(long)))
    runs = [x * (100_000 // len(x.encode())) for x in ("…", "哈", "😀", "é", "w", "é哈", "哈ab", "…😀", "abcdefg", "哈…")] + ["ab" * 300 + "…" * 900 + "thequick" * 100 + "哈" * 700 + "".join(rng.choice("abcdefgh") for _ in range(3000)), "…" * 3_001 + "x" + "…" * 3_002]
    began = time.time()
    for long in runs:
        found = list(coder.encode([long]))
        assert ",".join(x for _, x, _ in found) == ",".join(map(str, library.encode_ordinary(long)))
        assert b"".join(x for _, _, x in found) == long.encode()
    assert time.time() - began < 90  # linear: a quadratic way takes hours
    for size in range(1, 300):
        long = "".join(rng.choice("aehint") for _ in range(size))
        assert list(coder.encode([long]))[0][1] == ",".join(map(str, library.encode_ordinary(long)))


def test_bpe_forgets_in_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5_000)
    monkeypatch.setattr(bpe, "SEGMENT", 200)
    with open(BPE[0], "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.Codec(*BPE), random.Random(9)
    texts = [" ".join("".join(rng.choice("aeinst") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)] + [""]
    got: dict = {}
    for i, ids, data in coder.encode(texts):
        got.setdefault(i, []).append((ids, data))
    assert coder.old
    for i, text in enumerate(texts[:-1]):
        assert ",".join(x for x, _ in got[i]) == ",".join(map(str, library.encode_ordinary(text)))
        assert b"".join(x for _, x in got[i]) == text.encode()
    assert len(texts) - 1 not in got


def test_fingerprints_compose():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    for i, (base, prime) in enumerate(zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True)):
        plain = 0
        for b in data:
            plain = (plain * base + b) % prime
        assert exact_dedup.fingerprint(data)[i] == plain
        left, right = exact_dedup.fingerprint(data[:777])[i], exact_dedup.fingerprint(data[777:])[i]
        assert exact_dedup.combine((left, 777), (right, len(data) - 777), base, prime)[0] == plain


@pytest.mark.parametrize("bits", [62, 3])
def test_exact_dedup_survives_collisions(docs, rows, bits):
    groups: dict = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", "", text), []).append((-len(text), doc))
    want = {doc: (min(g)[1], len(g), doc == min(g)[1], hashlib.sha256(s.encode()).hexdigest()) for s, g in groups.items() for _, doc in g}
    got = exact_dedup.exact_duplicates(docs, bits).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want


def test_exact_dedup_of_nulls_and_repeats(odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert sorted(r["group_size"] for r in got) == [1, 1, 1, 3, 3, 3, 4, 4, 4, 4]
    assert {r["keep_id"] for r in got if r["group_size"] == 3} == {3}  # the blank text has the most code points


def _components(sets, percent):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index: dict = {}
    for d, s in sets.items():
        shared: dict = {}
        for h in s:
            for o in index.get(h, ()):
                shared[o] = shared.get(o, 0) + 1
            index.setdefault(h, []).append(d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 60)])
def test_near_dedup_loses_no_link(docs, rows, k, percent):
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    want = _components(sets, percent)
    got = near_dedup.near_duplicates(docs, k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}


def test_near_dedup_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = f"x{rng.random()}"
        texts.append(" ".join(words))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in enumerate(texts)}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _components(sets, 80)


def test_shingles_match_text():
    text = "The  quick\tBROWN fox\njumps over the quick brown fox jumps"
    assert len(shingles(word_hashes(np.frombuffer(text.encode(), np.uint8)), 4)) == 6  # two of eight windows recur


def _plain_lines(texts):
    """{(doc, line): normal form}, written apart from the operator."""
    out = {}
    for doc, text in texts:
        for number, line in enumerate((text or "").split("\n")):
            plain = re.sub("[\x20\x09-\x0d]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" ")
            if plain:
                out[doc, number] = plain
    return out


def _duplicate_places(texts):
    places = _plain_lines(texts)
    first: dict = {}
    for place in sorted(places):
        first.setdefault(places[place], place)
    sets = {place: {plain[i : i + 8] for i in range(max(1, len(plain) - 7))} for plain, place in first.items()}
    parts = _components(sets, 80)  # a root is the least of its places
    return {p for p, plain in places.items() if parts[first[plain]] != p}


def test_line_dedup_equals_brute_force(docs, rows):
    assert {tuple(r) for r in line_dedup.duplicate_lines(docs).collect()} == _duplicate_places([(r[0], r[1]) for r in rows])


def test_line_dedup_takes_short_lines(spark):
    texts = ["}\n\nErheed. Titionly.\nhttps://example.org/a/very/long/path/1\n-", "erheed.  TITIONLY.\n}\n \nhttps://example.org/a/very/long/path/2\nend", "\n\n}", "-a\nabcdefgh\nabcdefghi"]
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == _duplicate_places(enumerate(texts)) == {(1, 0), (1, 1), (1, 3), (2, 2)}


def test_line_dedup_of_characters_blocks_and_chains(spark, monkeypatch):
    """Non-ASCII lines, lines just over and under the threshold, chains, and keys of several blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéàüßñçøåžйдл日本語"
    texts = []
    for doc in range(12):
        base = [rng.choice(letters) for _ in range(rng.choice([6, 40, 200]))]
        lines = []
        for _ in range(40):
            if rng.random() < 0.7:  # drifts on, so that far ends of a chain differ
                base[rng.randrange(len(base))] = rng.choice(letters)
            lines.append("".join(base) + ("  " if rng.random() < 0.2 else "") + rng.choice(["", " X", "\t"]))
        texts.append((doc - 3, "\n".join(lines)))
    want = _duplicate_places(texts)
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got <= want  # banding may miss a link of the chain, and nothing else
    assert len(got) >= 0.97 * len(want)


def test_line_links_are_all_found():
    """Whatever shares a block is compared exactly, through leads and the triangle inequality."""
    rng = random.Random(8)
    for percent in (50, 80):
        for _ in range(40):
            base = [rng.choice("abcdef ") for _ in range(60)]
            lines = []
            for _ in range(30):
                if rng.random() < 0.15:
                    base = [rng.choice("abcdef ") for _ in range(60)]
                base[rng.randrange(60)] = rng.choice("ghijk")
                if rng.random() < 0.5:
                    base[rng.randrange(60)] = rng.choice("ghijk")
                lines.append("".join(base))
            sets = {i: {x[j : j + 8] for j in range(len(x) - 7)} for i, x in enumerate(lines)}
            component = np.arange(30)
            edges = line_dedup._links(np.zeros(30, np.int64), component, [x.encode() for x in lines], percent)
            assert _joined_by(edges, 30) == list(_components(sets, percent).values())
            # part of the links given: what is found joins the rest
            given = np.array([_components(sets, percent)[i] if i % 2 else i for i in range(30)])
            edges = line_dedup._links(np.zeros(30, np.int64), given, [x.encode() for x in lines], percent)
            edges += [(i, j) for i in range(30) for j in range(i) if given[i] == given[j]]
            assert _joined_by(edges, 30) == list(_components(sets, percent).values())


def _joined_by(edges, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_line_dedup_recall_at_the_threshold():
    """Pairs of a similarity from 0.8 to 0.85 share a band, nearly all of them."""
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 2000:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(160))
        cut = rng.randint(8, 14)
        b = a[:-cut] + "".join(rng.choice("qrstuv") for _ in range(cut))
        x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs += [a.encode(), b.encode()]
    keys = line_dedup._band_keys(pairs)
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.995


def test_repeated_ids_keep_their_own_lines_and_links(spark):
    rng = random.Random(11)

    def text(n):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    shared, own, late = text(12), text(12), text(12)
    made = spark.createDataFrame([(1, shared), (2, shared), (2, own), (3, late + "\n" + shared), (3, own + "\n" + late)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.without_duplicate_lines(made).collect()) == sorted([(1, shared), (2, ""), (2, own), (3, late), (3, "")])
    for _ in range(2):
        a, b, c = text(60), text(60), text(60)
        near = b.replace(b.split()[5], "changed")
        rows = [(1, a), (1, b), (2, near), (3, c), (3, c), (None, c)]
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
        stay = sorted(((r["doc_id"] or 0), r["text"]) for r in near_dedup.without_near_duplicates(docs).collect())
        assert [d for d, _ in stay] == [0, 1, 3] and stay[1][1] in (a, b)


def test_line_dedup_reserves_no_column(spark):
    clashing = ["_id", "id", "gone", "_gone", "maybe", "place", "slot", "word", "line", "key", "a", "b", "n"]
    made = spark.createDataFrame([(1, "same line here\nown words one", *range(13)), (2, "same line here\nother end", *range(13)), (3, "Same  line here", *range(13)), (None, "same line here", *range(13)), (4, None, *range(13))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clashing))
    got = line_dedup.without_duplicate_lines(made)
    assert got.columns == made.columns
    assert {(r["doc_id"], r["text"], r["word"]) for r in got.collect()} == {(1, "same line here\nown words one", 7), (2, "other end", 7), (3, "", 7), (None, "same line here", 7), (4, None, 7)}
    assert {r["doc_id"] for r in line_dedup.without_duplicate_lines(made, drop_emptied=True).collect()} == {1, 2, None, 4}


def test_packing_holds_its_constraints(docs, rows):
    got = packing.pack(docs, capacity=256, unit=60).collect()
    bins: dict = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for items in bins.values():
        items.sort(key=lambda r: r["bin_offset"])
        assert all(a["bin_offset"] + a["length"] == b["bin_offset"] for a, b in zip(items, items[1:], strict=False))
        assert sum(r["length"] for r in items) <= 256
        assert len({r["cluster"] for r in items}) == len(items)
        assert max(sum(r["source"] == s["source"] for r in items) for s in items) <= packing.PER_SOURCE
    total: dict = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {doc: len(re.findall("[^\x20\x09-\x0d]+", text)) for doc, text, *_ in rows}


def test_full_pieces_have_bins_of_their_own(spark):
    long = "word " * 2048 * 2 + "end"
    made = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (None, long, "a"), (None, long, "b"), (2, "w " * 2048, None)], "doc_id long, text string, source string")
    got = packing.pack(made).collect()
    full = [r["bin_id"] for r in got if r["length"] == packing.CAPACITY]
    assert len(full) == len(set(full)) == 9
    assert not set(full) & {r["bin_id"] for r in got if r["length"] < packing.CAPACITY}
    assert sum(r["length"] for r in got) == 4 * 4097 + 2048


def _naive_best_fit(items, capacity, per_source):
    """All open bins are looked at for each item; of equal rooms the one that was touched first."""
    bins, out = [], []
    for now, (length, source, cluster) in enumerate(items):
        fits = [b for b in bins if b["room"] >= length and cluster not in b["clusters"] and b["sources"].count(source) < per_source]
        if fits:
            best = min(fits, key=lambda b: (b["room"], b["at"]))
        else:
            best = {"room": capacity, "clusters": set(), "sources": [], "number": len(bins)}
            bins.append(best)
        out.append((best["number"], capacity - best["room"]))
        best["room"] -= length
        best["clusters"].add(cluster)
        best["sources"].append(source)
        best["at"] = now
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        capacity = rng.choice([10, 64, 300])
        items = sorted(((rng.randint(1, capacity), rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(rng.choice([5, 80]))) for _ in range(80)), reverse=True)
        assert packing.best_fit(items, capacity, 3) == _naive_best_fit(items, capacity, 3)


def test_packing_is_free_of_file_layout(docs):
    one = packing.pack(docs, capacity=256, unit=60).collect()
    two = packing.pack(docs.repartition(7), capacity=256, unit=60).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_best_fit_takes_the_tightest_compatible_bin():
    # bins with 4 and 3 left; the item of 3 fits the second, unless its cluster is there
    assert [b for b, _ in packing.best_fit([(7, 0, 0), (6, 1, 1), (3, 2, 2)], 10, 1)] == [0, 1, 0]
    assert [b for b, _ in packing.best_fit([(7, 0, 0), (6, 1, 1), (3, 2, 0)], 10, 1)] == [0, 1, 1]
    assert [b for b, _ in packing.best_fit([(7, 0, 0), (6, 1, 1), (3, 0, 1)], 10, 1)] == [0, 1, 2]


def test_quality_votes_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality_knn.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.8 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_votes_equal_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_knn.train(docs, labels, rows=60)
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, labels, model).collect()}
    for doc, text in docs.select("doc_id", "text").limit(80).collect():
        counts = quality_knn.terms(pa.array([text], pa.string()))[0].astype(float)
        share = np.log1p(1000 * counts / max(counts[: quality_knn.TERMS].sum(), 1)) * model.rarity
        vector = (share / np.linalg.norm(share)) @ model.axes
        vector /= np.linalg.norm(vector)
        near = sorted(((float(v @ vector), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        votes = [x for x in near if x[0] >= near[quality_knn.NEIGHBOURS - 1][0] - 1e-6]
        assert got[doc] == pytest.approx(sum(max(a, 0) * y for a, y in votes) / sum(max(a, 0) for a, _ in votes), abs=1e-3)


def test_quality_ties_all_vote():
    counts = np.zeros((40, quality_knn.TERMS + 2), np.float32)
    counts[:, 3] = 5
    counts[:5, 9] = 2
    model = quality_knn.Model(counts, np.array([1.0] * 5 + [0.0, 1.0, 1.0, 1.0, 1.0] * 7))
    assert model.score(counts[10:11])[0] == pytest.approx(0.8)  # all 35 equal rows, not some 15 of them
    assert model.score(np.zeros((1, quality_knn.TERMS + 2), np.float32))[0] == pytest.approx(model.prior)


def test_language_equals_brute_force(spark, docs):
    """Words by log frequency, then sequences from long to short, counted apart from the operator."""
    from collections import Counter
    from math import exp, log

    learned = [r for r in docs.select("doc_id", "text", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"]]
    langs = sorted({r["lang"] for r in learned})
    counts = {(lang, n): Counter() for lang in langs for n in range(5)}
    for r in learned:
        for w in re.findall(r"[^\W\d_]+", r["text"].lower()):
            counts[r["lang"], 0][w] += 1
            for n in range(1, 5):
                edged = f" {w} "
                counts[r["lang"], n].update(g for i in range(len(edged) - n + 1) if (g := edged[i : i + n]) != " ")
    spread = {k: sum(c.values()) + 0.5 * len(c) for k, c in counts.items()}

    def posterior(word):
        for n in range(5):
            edged = f" {word} "
            keys = [word] if n == 0 else [g for i in range(len(edged) - n + 1) if (g := edged[i : i + n]) != " "] if n <= len(edged) else []
            keys = [[word], *[[edged[i : i + m] for i in range(len(edged) - m + 1) if edged[i : i + m] != " "] for m in (4, 3, 2, 1)]][n]
            m = (0, 4, 3, 2, 1)[n]
            keys = [g for g in keys if any(counts[lang, m][g] for lang in langs)]
            if keys:
                raw = [sum(log((counts[lang, m][g] + 0.5) / spread[lang, m]) for g in keys) for lang in langs]
                top = max(raw)
                return [x - top - log(sum(exp(y - top) for y in raw)) for x in raw]
        return [-log(len(langs))] * len(langs)

    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for r in docs.select("doc_id", "text").limit(60).collect():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if not words:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        scores = [posterior(w) for w in words]
        sums = [sum(x[i] for x in scores) for i in range(len(langs))]
        best = max(range(len(langs)), key=lambda i: sums[i])
        assert got[r["doc_id"]]["lang_pred"] == langs[best]
        assert got[r["doc_id"]]["score"] == pytest.approx(sum(exp(x[best]) for x in scores) / len(scores), abs=1e-9)


def test_language_with_nothing_to_learn_keeps_texts(spark):
    made = spark.createDataFrame([(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language_id.known_language(made).collect()] == [1]
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(made).collect()} == {("und", 0.0)}


def test_rules_in_greedy_order(spark, docs):
    from pyspark.sql import functions as F

    # the first rejects most per cost; what the last rejects, the first does too
    rules = {
        "never": lambda: F.length("_text") < 0,
        "implied": lambda: F.length("_text") > 3000,
        "half": lambda: F.length("_text") > 1000,
    }
    order = quality_rules.learn_order(docs, rules, rows=200)
    assert sorted(order) == sorted(rules) and order[0] == "half"


def test_values_on_odd_rows(spark, odd):
    """Defined results for null, empty, tied and repeated rows."""
    twelve = "one two three four five six seven eight nine ten eleven"
    kept = {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(odd).collect()}
    assert {(1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 11, False, True), (5, 11, False, True), (None, 11, False, True), (6, 1, True, False), (8, 3000, True, False)} <= kept
    none = {r["doc_id"]: (r["n_card"], r["spans"]) for r in pii.find(odd).collect()}
    assert none[1] == none[2] == none[4] == (0, "")
    packed = packing.pack(odd).collect()
    assert sorted(r["length"] for r in packed) == sorted([0, 0, 0, 11, 11, 11, 11, 1, 3, 2048, 952])
    assert all((r["bin_id"] is None) == (r["length"] == 0) for r in packed)
    copies = [r["bin_id"] for r in packed if r["length"] == 11]
    assert len(set(copies)) == 4  # of one cluster, so each in another bin
    placed = sharding.shards(odd).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in placed) == sorted((d or 0, len((t or "").encode()) + 1) for d, t, *_ in ODD)
    assert {r["text_crc32"] for r in placed if r["doc_id"] in (4, 5, None)} == {zlib.crc32(twelve.encode())}
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality_knn.score(odd, labels).collect()}
    assert scores[1] == scores[2] and scores[4] == scores[5] == scores[None]
    cut = {(r["doc_id"], r["text"]) for r in line_dedup.without_duplicate_lines(odd).collect()}
    assert cut == {(d, t if d in (1, 2, 3, 4, None, 6, 7, 8) else "") for d, t, *_ in ODD}


def test_hilbert_curve_steps_by_one():
    import itertools

    points = np.array(list(itertools.product(range(8), repeat=3)))
    index = sharding.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    assert np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1).max() == 1


def test_shards_differ_by_one_row(docs, rows):
    got = sharding.shards(docs).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, *_ in rows}


def test_shards_equal_brute_force(docs, rows):
    axes = []
    for column in (3, 2):
        values = sorted({r[column] or "" for r in rows}, key=lambda x: x.encode())
        axes.append({v: i * 32 // max(len(values), 32) for i, v in enumerate(values)})
    sizes = [len(t.encode()) + 1 for _, t, *_ in rows]
    points = np.array([(axes[0][r[3] or ""], axes[1][r[2] or ""], min(31, int(np.log2(size) * 1.5))) for r, size in zip(rows, sizes, strict=True)])
    order = sorted(zip(sharding.hilbert_index(points, 5).tolist(), (zlib.crc32(r[1].encode()) for r in rows), sizes, (r[0] for r in rows), strict=True))
    base, extra = divmod(len(rows), 16)
    want, at = {}, 0
    for shard in range(16):
        for slot in range(base + (shard < extra)):
            want[order[at][3]] = (shard, slot, order[at][0])
            at += 1
    assert {r["doc_id"]: (r["shard"], r["slot"], r["curve"]) for r in sharding.shards(docs).collect()} == want


def test_shards_prune_by_bounds(spark, tmp_path):
    rng = random.Random(5)
    made = [(i, "x" * rng.choice([1, 30, 900, 20000]), f"lang{rng.randrange(8)}", f"source{rng.randrange(40):02}") for i in range(1600)]
    placed = sharding.shards(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), columns=("source", "lang"))
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).toPandas()
    assert len(back) == 1600
    bounds = back.groupby("shard").agg(a=("source", "min"), b=("source", "max"), c=("lang", "min"), d=("lang", "max"), e=("size", "min"), f=("size", "max"))
    hit = [((bounds.a <= f"source{i:02}") & (bounds.b >= f"source{i:02}")).sum() for i in range(40)]
    both = [((bounds.a <= f"source{i:02}") & (bounds.b >= f"source{i:02}") & (bounds.e <= 31) & (bounds.f >= 31)).sum() for i in range(40)]
    assert np.mean(hit) < 9 and np.mean(both) < 6  # of 16


def test_components_over_many_tasks(spark, monkeypatch):
    from fieldspark.llm import _spark

    monkeypatch.setattr(_spark, "TASK_EDGES", 100)
    rng = random.Random(7)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(i, i + 1) for i in range(2000, 2200)] + [(3000, x) for x in range(3001, 3100)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in _spark.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert got == {x: root(x) for x in parent}


def test_tasks_work_on_pieces_of_bounded_size(monkeypatch):
    from fieldspark.llm import _spark

    monkeypatch.setattr(_spark, "PIECE", 1 << 12)
    random.seed(11)
    texts = [None if i % 50 == 7 else "" if i % 50 == 9 else " ".join(f"w{random.randrange(500)}" for _ in range(random.choice([3, 40, 3000 if i % 100 == 3 else 5]))) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    none = batch.slice(0, 0)

    parts = list(_spark.pieces(iter([batch, none, batch]), "text"))
    assert pa.Table.from_batches(parts).to_pylist() == [*batch.to_pylist(), *batch.to_pylist()]
    assert max(sum(len(x or "") for x in p.column(1).to_pylist()) for p in parts) < (1 << 12) + max(len(x or "") for x in texts)
    assert len(parts) > 20

    for task in (near_dedup._sets(5), near_dedup._shingled(5, "set"), near_dedup._shingled(5, "bitmap"), pii._redact):
        made = list(task(iter([batch])))
        one_by_one = [r for i in range(900) for x in task(iter([batch.slice(i, 1)])) for r in x.to_pylist()]
        assert [r for x in made for r in x.to_pylist()] == one_by_one
        assert max(x.num_rows for x in made) < 900
    sets = [r["data"] for x in near_dedup._shingled(5, "set")(iter([batch])) for r in x.to_pylist()]
    pairs = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array(range(len(sets)), pa.int64()), pa.array(sets, pa.binary()), pa.array(sets, pa.binary())], ["u", "v", "a", "b"])
    made = list(near_dedup._confirm(80)(iter([pairs])))
    assert [r["u"] for x in made for r in x.to_pylist()] == list(range(len(sets))) and len(made) > 20


def test_ranks_start_no_python_workers(spark, monkeypatch):
    from pyspark import SparkContext

    from fieldspark.llm import _spark

    def refuse(*_, **__):
        raise AssertionError("rows of Python objects are read by workers of their own")

    made = spark.range(0, 500, 1, 5).selectExpr("(id * 37) % 500 as k").localCheckpoint()
    none = made.where("k < 0")
    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    rows, total = _spark.ranked(made, ["k"])
    assert total == 500 and all(r["k"] == r["rank"] for r in rows.collect())
    rows, total = _spark.ranked(none, ["k"])
    assert total == 0 and rows.collect() == []


def test_many_short_lines_are_compared_in_one_piece(monkeypatch):
    # over 2**14 lines between them, in one piece
    monkeypatch.setattr(line_dedup, "_COMPARED", 1 << 30)
    rng = random.Random(3)
    n = 20_000
    lines = []
    for i in range(0, n, 2):
        text = f"{i:06d}" + "".join(rng.choices("abcdefghij", k=14))
        lines += [text, text + "x" if i % 4 else "".join(reversed(text))]  # 13 of 14 shingles, or none
    batch = pa.RecordBatch.from_arrays([pa.array([i // 2 for i in range(n)], pa.int64()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([x.encode() for x in lines], pa.binary())], ["x", "y", "z", "id", "component", "data"])
    got = {tuple(sorted(r.values())) for x in line_dedup._linked(80)(iter([batch])) for r in x.to_pylist()}
    assert got == {(i, i + 1) for i in range(2, n, 4)}


def test_lines_with_alike_parts_of_hashes_are_told_apart(monkeypatch):
    rng = random.Random(8)
    lines = ["".join(rng.choices("abcd ", k=rng.randrange(1, 60))).encode() for _ in range(300)]
    group = np.sort(np.array([rng.randrange(40) for _ in lines]))
    group = np.unique(group, return_inverse=True)[1]
    rows = np.arange(len(lines))
    first = np.searchsorted(group, group)

    def sets(x):
        t = x.decode()
        return {t} if len(t) < 8 else {t[i : i + 8] for i in range(len(t) - 7)}

    plain = [len(sets(lines[a]) & sets(lines[b])) for a, b in zip(rows, first, strict=True)]
    for bits in (40, 65):  # by one sort, and by all bits
        monkeypatch.setattr(line_dedup, "_LEAST_BITS", bits)
        made = line_dedup._Rows(group, lines)
        assert made.size.tolist() == [len(sets(x)) for x in lines]
        assert made.distances(rows, first)[0].tolist() == plain


def test_lines_of_joined_texts_equal_those_of_each():
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", "Z "], k=rng.randrange(0, 40))) for _ in range(400)]
    plain = [(i, n, b" ".join(w)) for i, t in enumerate(texts) for n, line in enumerate(t.encode().lower().split(b"\n")) if (w := line.split())]
    for some in (texts, texts[:1], []):
        owner, number, lines = line_dedup._normal_lines([np.frombuffer(t.encode(), np.uint8) for t in some])
        assert list(zip(owner.tolist(), number.tolist(), lines, strict=True)) == [x for x in plain if x[0] < len(some)]


def test_rows_without_cut_lines_keep_their_counts():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3], pa.int64()), pa.array(["a\nb", "a", "c"]), pa.array([9, 9, 9], pa.int64()), pa.array([[{"line": 0, "a": line_dedup._digest("a")}], [{"line": 0, "a": line_dedup._digest("a")}], None], pa.list_(pa.struct([("line", pa.int32()), ("a", pa.int64())])))],
        ["doc_id", "text", "n_chars", "gone"],
    )
    assert [tuple(r.values()) for x in line_dedup._cut(iter([batch])) for r in x.to_pylist()] == [(1, "b", 1), (2, "", 0), (3, "c", 9)]
    assert [tuple(r.values()) for x in line_dedup._cut(iter([batch]), drop_emptied=True) for r in x.to_pylist()] == [(1, "b", 1), (3, "c", 9)]
