"""Search: query strings become one boolean expression; indexes prune only where that is sound.

Tokens: ``tool:x``, ``k:path`` (a leaf at path), ``v:text`` (a string leaf equal
to it), ``kv:path=text``, ``n:path=number``; anything else is a plain keyword that
matches as itself, its stem, or a five-letter prefix of either. All tokens are
trimmed and compared in lower case. AND wants every token, OR any.

Structured tokens are tested on the flattened JSON, in Python; but only on lines that an
expression over the payload as a variant lets through, which no match escapes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import trace

_SAFE = re.compile(r"[A-Za-z0-9_./:-]{2,}")


def _any_leaf(leaf: Column, test) -> Column:
    return F.coalesce(F.exists(leaf, test), F.lit(False))


def structured(token: str, tool: Column, leaf: Column) -> Column | None:
    """The predicate of a structured token, or None for a plain one."""
    kind, _, rest = token.partition(":")
    if kind == "tool":
        return F.coalesce(F.lower(tool) == rest, F.lit(False)) if rest else F.lit(False)
    if kind == "k":
        return _any_leaf(leaf, lambda x: F.lower(x["path"]) == rest)
    if kind == "v":
        return _any_leaf(leaf, lambda x: (x["kind"] == "str") & (F.lower(x["text"]) == rest))
    path, eq, value = rest.partition("=")
    if kind == "kv":
        return _any_leaf(leaf, lambda x: (F.lower(x["path"]) == path) & (F.lower(F.trim(x["text"])) == value.strip())) if eq else F.lit(False)
    if kind == "n":
        try:
            number = float(value)
        except ValueError:
            return F.lit(False)
        return _any_leaf(leaf, lambda x: (F.lower(x["path"]) == path) & (x["num"] == number))
    return None


def plain(keyword: str, line: Column) -> Column:
    out = F.lit(False)
    for t in T.match_terms(keyword):
        out = out | F.contains(F.lower(line), F.lit(t))
    return out


def search(lines: DataFrame, keywords: list[str], mode: str = "and", line: str = "line") -> DataFrame:
    """Lines that match all (or any) of the keywords. JSON is parsed only if a token asks for it, and only on lines with a payload."""
    words = list(dict.fromkeys(k.strip().lower() for k in keywords if k.strip()))
    if not words:
        return lines.limit(0)
    text = F.col(line)
    needs = any(re.match(r"(k|v|kv|n):", w) for w in words)
    tool = trace.loose_tool(text)
    if needs:  # what cannot match is dropped before JSON is flattened
        payload = trace.loose_payload(text)
        cheap = [p if (p := structured(w, tool, F.lit(None))) is not None else plain(w, text) for w in words if not re.match(r"(k|v|kv|n):", w)]
        dear = [possible(w, payload) for w in sorted(words, key=lambda w: w.startswith("k:")) if re.match(r"(k|v|kv|n):", w)]  # a key alone says least
        lines = lines.where(_all([*cheap, *dear], mode)).withColumn("__leaf", trace.leaves(payload))
    parts = [p if (p := structured(w, tool, F.col("__leaf"))) is not None else plain(w, text) for w in words]
    return lines.where(_all(parts, mode)).drop("__leaf")


def _all(tests: list[Column], mode: str) -> Column:
    test = tests[0]
    for t in tests[1:]:
        test = test & t if mode == "and" else test | t
    return test


def _readings(path: str) -> list[str]:
    """Variant paths that a flattened path may stand for: a dot or an index can be part of a key as well."""

    def keys(rest: str) -> list[str]:
        out = []
        for end in [m.start() for m in re.finditer(r"[.\[]", rest) if m.start()] + [len(rest)]:
            out += [f"['{rest[:end]}']{tail}" for tail in behind(rest[end:])]
        return out

    def behind(rest: str) -> list[str]:
        if not rest:
            return [""]
        if rest[0] == ".":
            return keys(rest[1:]) if rest[1:] else []
        m = re.match(r"\[(\d{1,9})\]", rest)
        return [m[0] + tail for tail in behind(rest[m.end() :])] if m else []

    return ["$" + p for p in (keys(path) + (behind(path) if path[0] == "[" else []))]


def possible(token: str, payload: Column) -> Column:
    """Whether a payload may match a structured token; false only where it cannot.

    The payload is looked at in lower case as a variant. Payloads that are none (a repeated key, say), hold an
    escape or characters outside ASCII pass untested.
    """
    open_ = F.contains(payload, F.lit("\\")) | (F.length(payload) != F.octet_length(payload))
    kind, _, rest = token.partition(":")
    path, _, value = rest.partition("=")
    if kind == "v":
        return payload.isNotNull() & (F.contains(F.lower(payload), F.lit(rest)) | open_)
    path = rest if kind == "k" else path
    if not path or len(path) > 200 or re.search(r"['\"\\]", path) or path.count(".") + path.count("[") > 5:
        return payload.isNotNull()
    value, number = value.strip(), None
    try:
        number = float(value) if kind in ("kv", "n") else None
    except ValueError:
        if kind == "n":
            return F.lit(False)

    def hit(json: Column) -> Column:
        out = json.isNull()
        for p in _readings(path):
            text = F.lower(F.trim(F.try_variant_get(json, p, "string"))) == value
            if number is not None:
                there = F.coalesce(F.try_variant_get(json, p, "double") == number, F.lit(False)) | F.coalesce(text, F.lit(False))
            elif kind == "kv" and value != "none":
                there = F.coalesce(text, F.lit(False))
            else:
                there = F.try_variant_get(json, p, "variant").isNotNull()
            out = out | there
        return out

    # bound to a variable, the payload is parsed once
    return payload.isNotNull() & (open_ | F.exists(F.array(F.try_parse_json(F.lower(payload))), hit))


def keywords(lines: DataFrame, terms: list[str], mode: str = "and", line: str = "line") -> DataFrame:
    """Lines that hold all (or any) of the terms as substrings, whatever their case; without a term, none."""
    tests = [F.contains(F.lower(F.col(line)), F.lit(t.lower())) for t in terms]
    return lines.where(_all(tests, mode)) if tests else lines.limit(0)


def prunable(term: str) -> bool:
    """Whether a line with the term must hold a token with it: all of its characters are the tokeniser's."""
    return bool(_SAFE.fullmatch(term))


def pruned_units(index: DataFrame, terms: list[str], mode: str, unit: list[str], token: str = "token") -> DataFrame | None:
    """Units (packets, blocks) that can hold a match, from an index of distinct (unit, token); None if all must be read.

    AND needs a token for each prunable term; OR needs a token for any, and prunes only if every term is prunable.
    """
    sound = [t.lower() for t in terms if prunable(t)]
    if not terms or not sound or (mode == "or" and len(sound) < len(terms)):
        return None
    hit = index.where(F.col(token).rlike("|".join(r"\Q" + t + r"\E" for t in sound)))
    if mode == "or":
        return hit.select(*unit).distinct()
    has = [F.max(F.contains(F.col(token), F.lit(t))).alias(f"_{i}") for i, t in enumerate(sound)]
    test = F.lit(True)
    for i in range(len(sound)):
        test = test & F.col(f"_{i}")
    return hit.groupBy(*unit).agg(*has).where(test).select(*unit)


@dataclass(frozen=True)
class Recall:
    hits: DataFrame
    units: DataFrame | None  # what pruning left; None: everything was read


def indexed(lines: DataFrame, index: DataFrame, terms: list[str], mode: str = "and", unit: list[str] | None = None, line: str = "line") -> Recall:
    """``keywords`` over the units that the index leaves: the same rows, fewer of them read."""
    unit = unit or ["packet_id"]
    units = pruned_units(index, terms, mode, unit)
    source = lines if units is None else lines.join(units, unit, "left_semi")
    return Recall(keywords(source, terms, mode, line), units)
