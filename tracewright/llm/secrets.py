"""Secret scan: Aho-Corasick keywords, anchored expressions near hits, checksums.

One automaton holds all keywords. It runs over the text with A-Z lower-cased, so
a keyword tells where an expression may start and nothing else is searched: each
expression is anchored at a hit and hits inside an earlier match of its kind are
passed over, which is what a leftmost non-overlapping search of the whole text
finds. Runs of hexadecimal digits have no keyword and take one scan of their own.

Kinds. Base: ``assign``, ``access``, ``hex``. Added, after validation of what is
embedded in the token: ``github`` (gh?_ tokens: the last six characters are the
base-62 CRC-32 of the thirty before), ``npm`` (the same scheme), ``jwt`` (header
and payload decode to JSON objects and the header names an algorithm).

Defined cases: a null text is empty and has no spans; a null id is kept; rows
that repeat an id are scanned each. Offsets are code points, the end exclusive.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: order of kinds where spans start at the same place
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = KINDS[:3]
Span = tuple[str, int, int]

# The base expressions.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]+")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(text: str) -> str:
    n, out = zlib.crc32(text.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(6, "0")


def _checksum(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _decoded(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None


def _token(m: re.Match) -> bool:
    head = _decoded(m[1])
    return isinstance(head, dict) and "alg" in head and isinstance(_decoded(m[2]), dict)


#: kind: (keywords in lower case, expression, validation)
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[1]) >= 12),
    "access": (("akia",), _ACCESS, lambda m: len(m[0]) >= 18),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, _checksum),
    "npm": (("npm_",), _NPM, _checksum),
    "jwt": (("eyj",), _JWT, _token),
}
_LOWER = {c: c + 32 for c in range(65, 91)}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (words, _, _) in RULES.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automaton = a
    return _automaton


def scan(text: str) -> list[Span]:
    """All validated spans, by start, then kind as listed."""
    spans = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    for end, (kind, n) in automaton().iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    for kind, starts in hits.items():
        _, expression, valid = RULES[kind]
        free = 0
        for at in sorted(set(starts)):
            if at >= free and (m := expression.match(text, at)):
                free = m.end()
                if valid(m):
                    spans.append((kind, at, free))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end>>, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[Span], mark: str = "[{kind}]") -> str:
    """The text with each span, overlaps merged, replaced by a mark of its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join(out) + text[at:]
