"""Agent-trace lines: time, tool, request id and JSON payload."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import encode as _codec

# Line patterns.
BRACKET = r"^\[([^\]]+)\] (.*)$"
BARE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(?:Z|[+-][0-9]{2}:[0-9]{2})?) (.*)$"
CALL = r"^tool_call::([^ ]+) rid=([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}) payload=(\{.*\})$"
LEAF = Y.ArrayType(Y.StructType().add("path", "string").add("kind", "string").add("text", "string").add("num", "double"))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ts, ts_style (none, bracket, bare), tool, rid, payload and raw; text forms stay beside typed ones.

    A bracket that holds no time (``[INFO] x``) is raw, not an error.
    """
    text = F.col(line)
    pick = lambda p, i: F.regexp_extract(text, "(?s)" + p, i)
    stamped = lines.withColumn("_b", F.try_to_timestamp(pick(BRACKET, 1))).withColumn("_r", F.try_to_timestamp(pick(BARE, 1)))
    style = F.when(F.col("_b").isNotNull(), "bracket").when(F.col("_r").isNotNull(), "bare").otherwise("none")
    stamped = stamped.withColumn("ts_style", style)
    body = F.when(F.col("ts_style") == "bracket", pick(BRACKET, 2)).when(F.col("ts_style") == "bare", pick(BARE, 2)).otherwise(text)
    stamped = stamped.withColumn("ts", F.coalesce("_b", "_r")).withColumn("body", body)
    call = lambda i: F.nullif(F.regexp_extract("body", "(?s)" + CALL, i), F.lit(""))
    return stamped.withColumns({"tool": call(1), "rid": call(2), "payload": call(3)}).withColumn("raw", F.when(F.col("tool").isNull(), F.col("body"))).drop("_b", "_r", "body")


#: notations of time that are kept as a number; others stay text
STAMPS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSxxx", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx", "yyyy-MM-dd'T'HH:mm:ssxxx", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSSSSS",
)


def encode(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Lines as typed columns: style, stamp (its notation), at (microseconds), tool, rid (16 bytes), payload with
    frequent keys as numbers, body (of other lines), and raw: the line itself where these would not give it back."""
    text = F.col(line)
    others = [c for c in lines.columns if c != line]
    p = parse(lines, line)
    said = F.when(F.col("ts_style") == "bracket", F.regexp_extract(text, "(?s)" + BRACKET, 1)).when(F.col("ts_style") == "bare", F.regexp_extract(text, "(?s)" + BARE, 1))
    stamp = F.lit(None).cast("int")
    for i, form in reversed(list(enumerate(STAMPS))):
        stamp = F.when(F.date_format("ts", form) == said, i).otherwise(stamp)
    p = p.withColumns({"stamp": stamp, "at": F.unix_micros("ts"), "rid": F.unhex(F.replace("rid", F.lit("-"), F.lit(""))), "payload": _codec.substitute(F.col("payload"), keys)})
    p = p.withColumnsRenamed({"ts_style": "style", "raw": "body"})
    p = p.withColumn("raw", F.when(~F.coalesce(decoded(keys) == text, F.lit(False)), text))
    fits = F.col("raw").isNull()
    return p.select(*others, *[F.when(fits, F.col(c)).alias(c) for c in ("style", "stamp", "at", "tool", "rid", "payload", "body")], "raw")


def decoded(keys: list[str]) -> Column:
    """The line out of the columns of ``encode``, null where it is kept raw."""
    at = F.timestamp_micros("at")
    stamp = F.lit(None).cast("string")
    for i, form in enumerate(STAMPS):
        stamp = F.when(F.col("stamp") == i, F.date_format(at, form)).otherwise(stamp)
    h = F.lower(F.hex("rid"))
    rid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    call = F.concat(F.lit("tool_call::"), "tool", F.lit(" rid="), rid, F.lit(" payload="), _codec.unsubstitute(F.col("payload"), keys))
    rest = F.when(F.col("tool").isNotNull(), call).otherwise(F.col("body"))
    return F.when(F.col("style") == "none", rest).when(F.col("style") == "bracket", F.concat(F.lit("["), stamp, F.lit("] "), rest)).otherwise(F.concat(stamp, F.lit(" "), rest))


def decode(coded: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """The lines again, with the other columns."""
    held = ("style", "stamp", "at", "tool", "rid", "payload", "body", "raw")
    return coded.withColumn(line, F.coalesce("raw", decoded(keys))).drop(*held)


def loose_tool(line: Column) -> Column:
    """What stands between ``tool_call::`` and the next space."""
    return F.when(F.contains(line, F.lit("tool_call::")), F.substring_index(F.substr(line, F.instr(line, "tool_call::") + 11), " ", 1))


def loose_payload(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("payload=")), F.substr(line, F.instr(line, "payload=") + 8))


def flatten(value: object, path: str = "") -> list[tuple[str, str, str, float | None]]:
    """(path, kind, text, number) of all leaves; no depth limit."""
    out, stack = [], [(path, value)]
    while stack:
        p, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{p}.{k}" if p else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{p}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is None:
            out.append((p, "null", "none", None))
        elif isinstance(v, bool):
            out.append((p, "bool", str(v).lower(), float(v)))
        elif isinstance(v, int | float):
            out.append((p, "num", str(v).lower(), float(v) if abs(v) < 1e308 and not (isinstance(v, float) and math.isnan(v)) else None))
        else:
            out.append((p, "str", v, None))
    return out


@F.pandas_udf(LEAF)
def leaves(payload: pd.Series) -> pd.Series:
    """Leaves of a JSON payload; null where it is no JSON."""

    def one(p: str | None):
        if p is None:
            return None
        try:
            return [{"path": a, "kind": k, "text": t, "num": n} for a, k, t, n in flatten(json.loads(p))]
        except (ValueError, RecursionError):
            return None

    return payload.map(one)


def payload_leaves(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row per leaf: the line's other columns, path, kind, text."""
    parsed = lines.withColumn("leaf", F.explode(leaves(loose_payload(F.col(line)))))
    return parsed.select(*[c for c in lines.columns if c != line], "leaf.path", "leaf.kind", "leaf.text")
