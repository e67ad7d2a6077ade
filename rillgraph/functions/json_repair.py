"""Model replies as JSON objects.

Well-formed replies are parsed by the engine; only those that aren't go through an
Arrow function that mends backslashes and missing commas and keeps what can then be
parsed.  Null and hopeless replies give null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.functions.text import clean_reply, extract_terms

MAX_COMMAS = 64
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')


def mend_backslashes(value: str) -> str:
    """Doubles each backslash within a string that doesn't begin a legal escape."""
    out, at, inside = [], 0, False
    while at < len(value):
        c = value[at]
        if inside and c == "\\":
            legal = _ESCAPE.match(value, at)
            out.append(legal[0] if legal else "\\\\")
            at = legal.end() if legal else at + 1
            continue
        inside ^= c == '"'
        out.append(c)
        at += 1
    return "".join(out)


def mend_commas(value: str, most: int = MAX_COMMAS) -> str | None:
    """Puts in commas where the parser misses one between two values; None if it misses anything else."""
    for _ in range(most + 1):
        try:
            json.loads(value)
            return value
        except json.JSONDecodeError as e:
            before = value[: e.pos].rstrip()
            if "delimiter" not in e.msg or ":" in e.msg or not before or before[-1] not in '"}]0123456789el' or value[e.pos : e.pos + 1] not in tuple('"{[-0123456789tfn'):
                return None
            value = f"{before},{value[e.pos:]}"
    return None


def parse_object(reply: str | None) -> str | None:
    """The JSON object of a reply as compact JSON; a list of objects becomes its ``items``."""
    if reply is None:
        return None
    text = re.sub(r"```[A-Za-z]*", "", re.sub(r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", "", reply)).strip()
    sliced = text[text.find("{") : text.rfind("}") + 1]
    for candidate in (text, sliced, mend_backslashes(sliced), mend_commas(mend_backslashes(sliced)) or ""):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, list) and found and all(isinstance(x, dict) for x in found):
            found = {"items": found, "repaired": True}
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(T.StringType())
def _repair(replies: pd.Series) -> pd.Series:
    return pd.Series([parse_object(r) for r in replies], dtype=object)


def reply_object(reply: Column | str) -> Column:
    """The JSON object of a reply as text; only replies that the engine can't parse go through Python."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    bare = clean_reply(reply)
    strict = F.when(bare.startswith("{") & bare.endswith("}"), F.get_json_object(bare, "$"))
    return F.coalesce(strict, _repair(F.when(strict.isNull(), reply)))


GRAPH = "struct<entities:array<string>,relations:array<array<string>>>"


def reply_graph(reply: Column, entities: int = 24, relations: int = 16, text: Column | None = None) -> Column:
    """Entities (2 to 79 characters, distinct) and relations (two members or more) of a reply; the terms of ``text`` where it has no entities."""
    bare = F.regexp_extract(clean_reply(reply), r"(?s)(\{.*\})", 1)
    g = F.from_json(bare, GRAPH)
    kept = F.filter(F.transform(F.coalesce(g["entities"], F.array().cast("array<string>")), lambda e: F.trim(e)), lambda e: e.isNotNull() & F.length(e).between(2, 79))
    pairs = F.filter(F.coalesce(g["relations"], F.array().cast("array<array<string>>")), lambda r: (F.size(r) >= 2) & (F.trim(F.get(r, F.lit(0))) != "") & (F.trim(F.get(r, F.lit(1))) != ""))
    if text is not None:
        kept = F.when(F.size(kept) > 0, kept).otherwise(extract_terms(text, entities))
    return F.struct(
        F.slice(F.array_distinct(kept), 1, entities).alias("entities"),
        F.slice(F.transform(pairs, lambda r: F.struct(F.trim(F.get(r, F.lit(0))).alias("src"), F.trim(F.get(r, F.lit(1))).alias("dst"))), 1, relations).alias("relations"),
    )


def reply_lines(reply: Column, shortest: int = 2, longest: int = 59) -> Column:
    """The lines of a reply that lists entities: without bullets, of a length that a name can have, once each."""
    bare = F.transform(F.split(clean_reply(reply), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*•·]|\d{1,3}[.)、])[ \t]*", "")))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x).between(shortest, longest)))


def reply_pairs(reply: Column) -> Column:
    """The lines of a reply that lists relations as two names with a bar between them."""
    cut = F.transform(reply_lines(reply, 3, 200), lambda x: F.transform(F.split(x, r"\|"), lambda n: F.trim(n)))
    pairs = F.filter(cut, lambda p: (F.size(p) >= 2) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != ""))
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("src"), F.get(p, F.lit(1)).alias("dst")))
