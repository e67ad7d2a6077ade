"""Hash keys of texts, made in Arrow batches by the consistent form and the content string.

Rows without an id or a text are left out: there is nothing to report them by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from struct import unpack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import forms

#: Rows whose content string is shorter are left out of comparisons of clauses.
LONG_ENOUGH = 40


def hash128(text: str) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash."""
    return unpack("<qq", blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def _mapped(df: DataFrame, schema: str, row: Callable[[int, str], tuple | None]) -> DataFrame:
    """``row`` of each (doc_id, text) with text not null; rows for which it gives None are left out."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i, t in zip(batch[0].to_pylist(), batch[1].to_pylist()) if (r := row(i, t)) is not None]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return df.mapInArrow(run, schema)


def _too_short(text: str, least: int) -> bool:
    """Whether no content string of this text can be long enough, though each of its characters may become several."""
    return len(text) * forms.transducer().longest < least


def look_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG_ENOUGH) -> DataFrame:
    """``doc_id``, the hash of its consistent form (f1, f2) and of its stored characters (r), for long-enough texts."""

    def row(i: int, text: str) -> tuple | None:
        if _too_short(text, least):
            return None
        lines = forms.transducer().lines(text)
        if len(forms.content(text, lines)) < least:
            return None
        return i, *hash128(lines.replace("\n", " ")), hash128(text)[0]

    return _mapped(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col), "doc_id bigint, f1 bigint, f2 bigint, r bigint", row)


def content_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG_ENOUGH) -> DataFrame:
    """``doc_id`` and the hash of its content string (k1, k2), for long-enough texts."""

    def row(i: int, text: str) -> tuple | None:
        found = "" if _too_short(text, least) else forms.content(text)
        return (i, *hash128(found)) if len(found) >= least else None

    return _mapped(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col), "doc_id bigint, k1 bigint, k2 bigint", row)


def contents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG_ENOUGH) -> DataFrame:
    """As :func:`content_keys`, with the content string itself."""

    def row(i: int, text: str) -> tuple | None:
        found = "" if _too_short(text, least) else forms.content(text)
        return (i, *hash128(found), found) if len(found) >= least else None

    return _mapped(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col), "doc_id bigint, k1 bigint, k2 bigint, content string", row)
