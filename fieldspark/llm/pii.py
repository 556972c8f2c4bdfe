"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues.  A deterministic parser per kind expands each
anchor to both sides, validates what it reads and reports code-point spans.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._spark import pieces

#: Kinds in their order at equal starts; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "account")
BASE = KINDS[:4]
# Cue words after which an identifier may stand.
CUES = ("iban", "ssn", "passport", "account number", "account no", "account no.", "acct", "social security")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@")
_GAP = re.compile(r"[\x20\t]*(?:number|no\.?|nr\.?)?[\x20\t]*[:#=]?[\x20\t]*", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?=[A-Z0-9-]*[0-9]{4})[A-Z0-9](?:-?[A-Z0-9]){5,17}(?![A-Za-z0-9])")


def automaton():
    """Over texts in ASCII lower case, as :func:`spans` hands them in."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _email(text: str, at: int, floor: int):
    """The address around the at-sign, or None; nothing before floor is taken."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    tail = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, tail.end()) if tail else None


def spans(text: str, cues) -> list[tuple[int, int, str]]:
    """All (start, end, kind), by start, then kind.

    For each base kind the result is what leftmost non-overlapping matching of
    its pattern gives, less the matches that fail validation.
    """
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, valid or not
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only ASCII letters change, so places hold
    for last, (what, width) in cues.iter(lowered):
        at = last - width + 1
        if what == "digit":
            # a run of digits starts a match at its first free digit only
            if at >= done["ip"] and (at == done["ip"] or not "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    out.append((at, m.end(), "ip"))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, m.end(), "card"))
        elif what == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((at, m.end(), "phone"))
        elif what == "at":
            if found := _email(text, at, done["email"]):
                done["email"] = found[1]
                out.append((*found, "email"))
        elif what == "scheme":
            if (m := _LOGIN.match(text, last + 1)) and m.start() >= done["url_login"]:
                done["url_login"] = m.end()
                out.append((m.start(), m.end() - 1, "url_login"))
        elif not text[at - 1 : at].isalnum() and not text[last + 1 : last + 2].isalnum():
            start = _GAP.match(text, last + 1).end()
            if start == last + 1 or start < max(done["iban"], done["account"]):
                continue
            if (m := _IBAN.match(text, start)) and iban_valid(m[0].replace(" ", "")):
                done["iban"] = m.end()
                out.append((start, m.end(), "iban"))
            elif m := _ACCOUNT.match(text, start):
                done["account"] = m.end()
                out.append((start, m.end(), "account"))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], rank[x[2]], x[1]))


def _joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _find(batches):
    cues = automaton()
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, all_spans = [], []
        for text in batch.column(1).to_pylist():
            found = spans(text or "", cues)
            base = [x for x in found if x[2] in BASE]
            for kind, column in zip(BASE, counts, strict=True):
                column.append(sum(x[2] == kind for x in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            all_spans.append(_joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each row of ``doc_id, text``.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: counts
    and digest of the base kinds, and every span as ``kind:start:end`` (code
    points, end exclusive) by start, then kind, joined by commas.  A null text
    is empty and has none.  Other columns are ignored; null ids and repeated
    rows pass through.  Each row is done where it lies; nothing is shuffled.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, cues) -> str:
    """The text with every span replaced by its kind; overlapping spans go as one."""
    out, at = [], 0
    end = -1
    for start, stop, kind in spans(text, cues):
        if start < end:
            end = max(end, stop)
            continue
        if end >= 0:
            at = end
        out.append(text[at:start])
        out.append(f"[{kind}]")
        at = end = stop
    return "".join(out) + text[max(at, end) :] if out else text


def _redact(batches):
    cues = automaton()
    for batch in pieces(batches, "text"):
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else redacted(t, cues) for t in batch.column(at).cast(pa.string()).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with personal data in ``text`` replaced by ``[kind]``.

    ``n_chars``, where there is one, is counted anew; null texts stay null.
    """
    made = docs.mapInArrow(_redact, docs.schema)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made
