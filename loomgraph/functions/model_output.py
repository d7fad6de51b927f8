"""Repair and decoding of what language models return."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_FENCE = re.compile(r"```[a-zA-Z]*\n?|```")


def repair_escapes(text: str) -> str:
    """Drops the backslash of escapes that JSON does not know, within strings."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\" and i + 1 < len(text):
            follower = text[i + 1]
            out.append(c + follower if follower in '"\\/bfnrtu' else follower)
            i += 2
            continue
        if c == '"':
            inside = not inside
        out.append(c)
        i += 1
    return "".join(out)


def first_json(text: str) -> str | None:
    """The first object or array in a text that decodes, repaired if it must be."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        for candidate in (text[m.start() :], repair_escapes(text[m.start() :])):
            try:
                _, end = decoder.raw_decode(candidate)
                return candidate[:end]
            except ValueError:
                continue
    return None


def clean_output(text: str | None) -> str | None:
    """Thoughts, closed or not, and code fences off, then the first JSON value; other text comes back trimmed."""
    if text is None:
        return None
    plain = _FENCE.sub("", _THINK.sub("", text)).strip()
    return first_json(plain) or plain


@F.pandas_udf(T.StringType())
def cleaned(texts: pd.Series) -> pd.Series:
    return texts.map(clean_output)


ENTITIES = "array<struct<name:string,entity_type:string,description:string>>"


def extracted_entities(c: Column) -> Column:
    """Entities of an object or a bare array; those without a name are dropped."""
    raw = cleaned(c)
    both = F.coalesce(F.from_json(raw, f"struct<extracted_entities:{ENTITIES}>")["extracted_entities"], F.from_json(raw, f"struct<entities:{ENTITIES}>")["entities"], F.from_json(raw, ENTITIES))
    return F.filter(both, lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) != "")


EDGE = T.StructType([
    T.StructField("relation_type", T.StringType()), T.StructField("source_entity_id", T.IntegerType()), T.StructField("target_entity_id", T.IntegerType()),
    T.StructField("fact", T.StringType()), T.StructField("valid_at", T.StringType()), T.StructField("invalid_at", T.StringType()),
])


def _integer(value: object) -> int:
    if value is None or value == "":
        return 0
    return int(float(value))  # type: ignore[arg-type]


def _text(value: object) -> str | None:
    if value is None or value == "":
        return None
    return value if isinstance(value, str) else json.dumps(value)


def decode_edges(text: str | None, n_entities: int | None) -> list[dict]:
    """Edges with ids and dates in whatever JSON type; those that point outside the entities are dropped."""
    try:
        value = json.loads(clean_output(text) or "null")
    except ValueError:
        return []
    rows = value if isinstance(value, list) else next((v for v in value.values() if isinstance(v, list)), []) if isinstance(value, dict) else []
    out = []
    for row in rows:
        if not isinstance(row, dict):
            continue
        try:
            source, target = _integer(row.get("source_entity_id")), _integer(row.get("target_entity_id"))
        except (TypeError, ValueError):
            continue
        if n_entities is None or (0 <= source < n_entities and 0 <= target < n_entities):
            out.append({
                "relation_type": _text(row.get("relation_type")), "source_entity_id": source, "target_entity_id": target,
                "fact": _text(row.get("fact")), "valid_at": _text(row.get("valid_at")), "invalid_at": _text(row.get("invalid_at")),
            })
    return out


@F.pandas_udf(T.ArrayType(EDGE))
def extracted_edges(texts: pd.Series, n_entities: pd.Series) -> pd.Series:
    return pd.Series([decode_edges(t, None if pd.isna(n) else int(n)) for t, n in zip(texts, n_entities, strict=True)])
