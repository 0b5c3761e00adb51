"""Text functions as Column expressions: tokenisers, stems, canonical forms, templates of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on.
TOKEN_A = r"[A-Za-z0-9_./:-]{2,}"
TOKEN_B = r"[A-Za-z0-9_]{3,}"
TOKEN_C = r"(?U)\w+|[^\w\s]|\s+"
TIMESTAMP = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b[0-9a-fA-F]{16,}\b"
INT = r"\b[0-9]{7,}\b"
SUFFIXES = ("ing", "ed", "es", "s")
PREFIX = 5
MARK = "<@>"
#: one alternation, in the order in which kinds win at the same place
CANONICAL = "|".join((TIMESTAMP, UUID, HEX, INT))


def tokens_a(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_A), F.lit(0))


def tokens_b(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_B), F.lit(0))


def tokens_c(text: Column) -> Column:
    """Words, single marks and runs of white space: joined, they are the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN_C), F.lit(0))


def stem(word: Column) -> Column:
    """The word in lower case without its first fitting suffix, if three letters or more stay."""
    w = F.lower(word)
    out = F.when(F.length(w) <= 3, w)
    for s in SUFFIXES:
        out = out.when(F.endswith(w, F.lit(s)) & (F.length(w) > len(s) + 2), F.substr(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def stem_word(word: str) -> str:
    w = word.lower()
    cut = next((s for s in SUFFIXES if w.endswith(s) and len(w) > len(s) + 2), "") if len(w) > 3 else ""
    return w[: len(w) - len(cut)]


def match_terms(keyword: str, prefix: int = PREFIX) -> list[str]:
    """What a plain keyword may match as: itself, its stem, and prefixes of both."""
    k = keyword.strip().lower()
    words = [k, stem_word(k)]
    words += [w[:prefix] for w in words if prefix and len(w) >= prefix]
    return list(dict.fromkeys(w for w in words if w))


def variants(word: Column, prefix: int = PREFIX) -> Column:
    """Index entries of a word: itself, its stem, and marked prefixes of both."""
    w, s = F.lower(word), stem(word)
    pre = lambda x: F.when(F.length(x) >= prefix, F.concat(F.lit("pref:"), F.left(x, F.lit(prefix))))
    return F.array_compact(F.array_distinct(F.array(w, s, pre(w), pre(s))))


def canonical_lossy(text: Column) -> Column:
    """Timestamps, UUIDs, long hex and long integers become tags; white space is squeezed."""
    for pattern, tag in ((TIMESTAMP, "<TS>"), (UUID, "<UUID>"), (HEX, "<HEX>"), (INT, "<INT>")):
        text = F.regexp_replace(text, pattern, tag)
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def canonical_tokens(text: Column) -> Column:
    """The high-entropy tokens of a text, left to right, from one pass."""
    return F.regexp_extract_all(text, F.lit(CANONICAL), F.lit(0))


def canonical_text(text: Column) -> Column:
    """The text with each of those tokens replaced by MARK (a MARK of the text's own counts as a token)."""
    return F.regexp_replace(text, CANONICAL, MARK)


def token_kind(token: Column) -> Column:
    whole = lambda p: token.rlike("^(?:" + p.replace(r"\b", "") + ")$")
    return F.when(whole(TIMESTAMP), "ts").when(whole(UUID), "uuid").when(whole(INT) & (F.length(token) < 16), "int").when(whole(HEX), "hex").when(whole(INT), "int").otherwise("raw")


def refill(marked: Column, tokens: Column) -> Column:
    """Inverse of ``canonical_text``: the marks, left to right, replaced by the tokens."""
    parts = F.split(marked, r"\Q" + MARK + r"\E", -1)
    return F.array_join(F.zip_with(parts, F.concat(tokens, F.array(F.lit(""))), lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def keyed_template(text: Column) -> Column:
    """Keyed numbers, ``variant=`` letters and free numbers of three digits or more become ``{}``."""
    text = F.regexp_replace(text, "(LOOP=|ID=|STEP=|ROUND=|EPOCH=)[0-9]+", "$1{}")
    text = F.regexp_replace(text, "(variant=)[A-Za-z]", "$1{}")
    return F.regexp_replace(text, "[0-9]{3,}", "{}")


def number_template(text: Column) -> Column:
    """Every number and ``variant=`` letter becomes ``{}``."""
    return F.regexp_replace(F.regexp_replace(text, "(variant=)[A-Za-z]", "$1{}"), "[0-9]+", "{}")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def signed_template(text: Column) -> Column:
    return F.regexp_replace(text, "-?[0-9]+", "{}")


def signed_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("-?[0-9]+"), F.lit(0))


#: typed values, in the order in which kinds win at the same place (fixed values)
TYPED = (
    ("kv", r"[A-Za-z_][A-Za-z0-9_-]*=[A-Za-z]{1,3}(?![^\s)\]}.,;:])"),
    ("uuid", UUID),
    ("time", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?\b"),
    ("hex", r"\b0x[0-9a-fA-F]+\b"),
    ("float", r"(?<![A-Za-z0-9_])-?[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?"),
    ("int", r"(?<![A-Za-z0-9_])-?[0-9]+(?!\.[0-9])"),
)


def typed_values(text: Column) -> Column:
    """array<struct<kind, text>> of the typed values, left to right."""
    found = F.regexp_extract_all(text, F.lit("|".join(p for _, p in TYPED)), F.lit(0))

    def kind(v: Column) -> Column:
        out = F.when(v.rlike("^[A-Za-z_][A-Za-z0-9_-]*=[A-Za-z]{1,3}$"), "kv").when(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), "uuid").when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), "time")
        return out.when(F.startswith(v, F.lit("0x")), "hex").when(F.contains(v, F.lit(".")), "float").otherwise("int")

    return F.transform(found, lambda v: F.struct(kind(v).alias("kind"), v.alias("text")))


def typed_template(text: Column) -> Column:
    """The text with ``{}`` for each typed value."""
    return F.regexp_replace(text, "|".join(p for _, p in TYPED), "{}")


def typed_refill(template: Column, values: Column) -> Column:
    """Inverse of ``typed_template`` for texts without a ``{}`` of their own: the values' texts, left to right."""
    parts = F.split(template, r"\{\}", -1)
    return F.array_join(F.zip_with(parts, F.concat(F.transform(values, lambda v: v["text"]), F.array(F.lit(""))), lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def checksum(text: Column, digits: int = 10) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.2f KB", n / 1024)).when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))
