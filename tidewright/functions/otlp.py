"""Flattening of OTLP/JSON log requests into log records, with typed refusal of malformed ones.

A request nests resources, scopes and records; each level is exploded on the JVM. Empty groups give no rows; a missing resource has
the attributes ``{}``, a missing scope a null name. Attributes and bodies are recursive; they are not parsed with the request but kept as
JSON text. Lists of texts, numbers and truth values, which nearly all are, are rendered by one pattern on the JVM; all others, of any depth, by
one Arrow UDF, which gives the same text.
"""

from __future__ import annotations

import base64
import json
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.ids import hex_id

_KV = "array<struct<key:string,value:string,keyStrindex:int>>"
REQUEST = (
    "resourceLogs array<struct<resource:struct<attributes:string>,scopeLogs:array<struct<scope:struct<name:string,version:string>,"
    "logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:string,attributes:string,"
    "droppedAttributesCount:bigint,flags:bigint,traceId:string,spanId:string,eventName:string>>>>>>"
)

#: A JSON text in quotes; attributes whose value is a text, truth value or whole number. Longer lists are left to the UDF, as the pattern recurses.
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_SIMPLE = r'\{"key":(' + _QUOTED + r'),"value":\{"(?:stringValue":(' + _QUOTED + r')|boolValue":(true|false)|intValue":"?(-?\d+)"?)\}\}'
SIMPLE_CHARS = 8192


def parse_request(json: Column) -> Column:
    """The request's structure; null where the text is no JSON object (a malformed request is refused as a whole).

    One parse; only a text with a field that doesn't fit is parsed once more, to tell such fields, which are null, from what is no JSON.
    """
    parsed = F.from_json(json, REQUEST + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    fits = lambda p: F.ltrim(json).startswith("{") & (p["__bad"].isNull() | F.try_parse_json(json).isNotNull())
    # an array of one, so that the parsed value has a name and isn't computed for each use
    return F.transform(F.array(parsed), lambda p: F.when(fits(p), F.struct(p["resourceLogs"].alias("resourceLogs"))))[0]


def _rendered(v: object) -> str:
    """JSON text of a parsed AnyValue, as ``value_json``, to any depth (one frame a level)."""
    v = v if isinstance(v, dict) else {}
    if (x := v.get("stringValue")) is not None:
        return json.dumps(x if isinstance(x, str) else json.dumps(x), ensure_ascii=False)
    if isinstance(x := v.get("boolValue"), bool):
        return "true" if x else "false"
    if (x := v.get("intValue")) is not None:
        return str(x)
    if (x := v.get("doubleValue")) is not None:
        try:
            number = float(x)
        except ValueError:
            return "null"
        return repr(number) if math.isfinite(number) else "null"
    if (x := v.get("bytesValue")) is not None:
        try:
            return f'"{base64.b64decode(x).hex()}"'
        except ValueError:
            return "null"
    if isinstance(x := v.get("arrayValue"), dict):
        parts = []
        for item in x.get("values") or []:
            parts.append(_rendered(item))
        return "[" + ",".join(parts) + "]"
    if isinstance(x := v.get("kvlistValue"), dict):
        parts = []
        for pair in x.get("values") or []:
            if not int(pair.get("keyStrindex") or 0):
                parts.append(json.dumps(pair.get("key") or "", ensure_ascii=False) + ":" + _rendered(pair.get("value")))
        return "{" + ",".join(parts) + "}"
    return "null"


@F.pandas_udf(T.StringType())
def _render(wire: pd.Series) -> pd.Series:
    """Attributes (a JSON array) or AnyValues (a JSON object) as JSON text; null, which all but the unusual ones are, stays null."""
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        v = json.loads(text)
        return _rendered({"kvlistValue": {"values": v}} if isinstance(v, list) else v)

    # a resource's text stands in each of its records
    return wire.map(lru_cache(maxsize=64)(one)) if wire.notna().any() else wire


def value_json(value: Column) -> Column:
    """JSON text of an AnyValue given as JSON text: bytes as hex, NaN and infinities and unknown forms as null. Not for use in lambdas."""
    known = F.ltrim(value).startswith("{")
    return F.when(known, _render(F.when(known, value))).otherwise("null")


def _flat_attributes(pairs: Column) -> Column:
    """Attributes with each pair that the pattern knows rendered."""
    return F.regexp_replace(pairs, _SIMPLE, "$1:$2$3$4")


def _is_simple(pairs: Column, flat: Column) -> Column:
    """Whether the pattern knew all pairs; null for no attributes."""
    # in a quoted text a quote is escaped, so an opened object that is left is one that the pattern doesn't know
    odd = flat.rlike(r'\{[\s"}]') | pairs.rlike(r"\\[u/]|\},\s|^\[\s|\s\]$")
    return (F.length(pairs) <= SIMPLE_CHARS) & pairs.startswith("[") & ~F.when(F.length(pairs) <= SIMPLE_CHARS, odd)


def _simple_attributes(pairs: Column, flat: Column, simple: Column) -> tuple[Column, Column]:
    """Attributes as the pattern renders them, and the text of those that it leaves to the UDF; one of both is null."""
    whole = F.concat(F.lit("{"), F.substring(flat, F.lit(2), F.length(flat) - 2), F.lit("}"))
    return F.when(pairs.isNull(), "{}").when(simple, whole), F.when(pairs.isNotNull() & ~simple, pairs)


def attributes_json(pairs: Column) -> Column:
    """A JSON object of attributes given as JSON text; pairs whose key is an interning reference are left out; without pairs ``{}``. Not for use in lambdas."""
    flat = _flat_attributes(pairs)
    simple, unusual = _simple_attributes(pairs, flat, _is_simple(pairs, flat))
    return F.coalesce(simple, _render(unusual))


def ignored_references(pairs: Column) -> Column:
    """How many pairs were left out for an interning reference."""
    return F.coalesce(F.size(F.filter(pairs, lambda p: F.coalesce(p["keyStrindex"], F.lit(0)) != 0)), F.lit(0))


def body_text(body: Column) -> Column:
    """Strings as they are, other values as JSON, an absent or interned one null."""
    is_text = body.startswith('{"stringValue":')
    odd = body.isNotNull() & ~is_text
    v = _render(F.when(odd, body))
    # written with blanks, a text is rendered in quotes and read back
    spaced = odd & body.rlike(r'^\s*\{\s*"stringValue"\s*:')
    return F.when(is_text | spaced, F.get_json_object(body, "$.stringValue")).when(v != "null", v)


def event_time(nanos: Column, observed: Column) -> Column:
    """The record's time, else the observed one, in whole microseconds; never null (both absent: the epoch)."""
    t = F.coalesce(nanos.cast("decimal(20,0)"), F.lit(0))
    o = F.coalesce(observed.cast("decimal(20,0)"), F.lit(0))
    return _micros(F.when(t != 0, t).otherwise(o))


def _micros(nanos: Column) -> Column:
    whole = F.least(F.floor(nanos / 1000), F.lit(9_223_372_036_854_775_807).cast("decimal(20,0)")).cast("bigint")
    return F.timestamp_micros(whole).cast("timestamp_ntz")


def flatten_logs(requests: DataFrame, request: str = "request", keep: list[str] | None = None) -> DataFrame:
    """Log records of parsed requests, with the columns ``keep`` of the request, in the flat 14-column form.

    What a level needs of the one above is taken out before it is exploded, and the UDF sees records only: a row that kept its resource or
    scope would carry the whole request, and the UDF's buffer would hold a copy of the request for each of its records.
    """
    keep = keep or []
    a = requests.select(*keep, F.explode(f"{request}.resourceLogs").alias("r"))
    pairs = F.col("r.resource.attributes")
    flat = _flat_attributes(pairs)
    simple, unusual = _simple_attributes(pairs, flat, _is_simple(pairs, flat))
    above = [*keep, "__tw_simple", "__tw_unusual"]
    b = a.select(*keep, simple.alias("__tw_simple"), unusual.alias("__tw_unusual"), F.col("r.scopeLogs").alias("__tw_scopes")).select(*above, F.explode("__tw_scopes").alias("s"))
    scope = [F.nullif(F.col("s.scope.name"), F.lit("")).alias("scope_name"), F.nullif(F.col("s.scope.version"), F.lit("")).alias("scope_version")]
    above = [*above, "scope_name", "scope_version"]
    c = b.select(*above[:-2], *scope, F.col("s.logRecords").alias("__tw_records")).select(*above, F.explode("__tw_records").alias("l"))
    # columns of their own, as each is used several times
    c = c.select(*above, "l", _flat_attributes(F.col("l.attributes")).alias("__tw_flat"))
    c = c.select(*above, "l", "__tw_flat", _is_simple(F.col("l.attributes"), F.col("__tw_flat")).alias("__tw_known"))
    attributes, others = _simple_attributes(F.col("l.attributes"), F.col("__tw_flat"), F.col("__tw_known"))
    observed = F.coalesce(F.col("l.observedTimeUnixNano").cast("decimal(20,0)"), F.lit(0))
    return c.select(
        *keep,
        event_time(F.col("l.timeUnixNano"), F.col("l.observedTimeUnixNano")).alias("ts"),
        F.when(observed != 0, _micros(observed)).alias("observed_ts"),
        F.coalesce("l.severityNumber", F.lit(0)).alias("severity_number"),
        F.nullif(F.col("l.severityText"), F.lit("")).alias("severity_text"),
        body_text(F.col("l.body")).alias("body"),
        F.coalesce(attributes, _render(others)).alias("attrs"),
        F.coalesce("__tw_simple", _render(F.col("__tw_unusual"))).alias("resource_attrs"),
        "scope_name",
        "scope_version",
        hex_id(F.unhex("l.traceId")).alias("trace_id"),
        hex_id(F.unhex("l.spanId")).alias("span_id"),
        F.coalesce("l.flags", F.lit(0)).cast("bigint").alias("flags"),
        F.nullif(F.col("l.eventName"), F.lit("")).alias("event_name"),
        F.coalesce("l.droppedAttributesCount", F.lit(0)).cast("bigint").alias("dropped_attributes_count"),
    )
