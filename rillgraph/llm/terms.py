"""Problem 4: occurrences and record frequency of every term.

Vertical layout: each partition turns its records into one compressed bitmap of
record identifiers per term and block of 65,536 identifiers (sorted 16-bit
positions, or plain bits where that is shorter), beside a counter of occurrences.
Bitmaps of the same term and block are merged by union and record frequency is
the sum of their cardinalities.  Blocks keep every bitmap under 8 KiB, so that a
term that stands in a third of all records is merged by many reducers.

Nulls aren't records; empty texts are records without terms; a record that comes
twice under one identifier counts once.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.llm import forms

RARE, COMMON_SHARE = 2, 0.1
BLOCK = 16
SCHEMA = "term string, block bigint, occurrences bigint, records int, bitmap binary"


@functools.cache
def _run() -> re.Pattern[str]:
    """A run of Latin letters and plain digits with at least one letter."""
    latin = "".join(re.escape(c) for c in map(chr, range(0x80, 0x2000)) if unicodedata.category(c)[0] == "L" and unicodedata.name(c, "").startswith("LATIN"))
    marks = "\\u0300-\\u036f"
    letter = f"a-z{latin}"
    return re.compile(f"[0-9]*[{letter}][0-9{letter}{marks}]*")


_HAN_RUN = re.compile("[一-鿿]{2,}")


def text_terms(text: str) -> list[str]:
    """Words and neighbouring pairs of Han characters of a text, in the order of kinds."""
    form = forms.consistent(text).lower()
    out = _run().findall(form)
    for run in _HAN_RUN.findall(form):
        out += map("".join, zip(run, run[1:]))
    return out


def entity_terms(entities: list[str | None] | None) -> list[str]:
    """The entities in consistent form and lower case, without null and blank ones."""
    return [t for e in entities or () if e is not None and (t := forms.consistent(e).lower())]


def pack(positions: np.ndarray) -> bytes:
    """Sorted distinct 16-bit positions as a compressed bitmap."""
    if len(positions) > (1 << BLOCK) // 16:
        bits = np.zeros(1 << BLOCK, np.uint8)
        bits[positions] = 1
        return b"b" + np.packbits(bits).tobytes()
    return b"p" + positions.astype("<u2").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    """The positions in a compressed bitmap."""
    if bitmap[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1))).astype(np.uint16)
    return np.frombuffer(bitmap, "<u2", offset=1)


def _build(terms: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(ids: list[int], lists: list[list[str]]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        code = np.fromiter((codes.setdefault(t, len(codes)) for ts in lists for t in ts), np.int64)
        if not len(code):
            return
        record = np.repeat(np.asarray(ids, np.int64), [len(ts) for ts in lists])
        order = np.lexsort((record, code))
        code, record = code[order], record[order]
        first = np.r_[True, (code[1:] != code[:-1]) | (record[1:] != record[:-1])]
        block = record >> BLOCK
        group = np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]
        starts = np.flatnonzero(group)
        sizes = np.diff(np.r_[starts, len(code)])
        at = np.flatnonzero(first)
        distinct = (record[at] & ((1 << BLOCK) - 1)).astype(np.uint16)
        bounds = np.r_[np.searchsorted(at, starts), len(at)]
        names = list(codes)
        for part in range(0, len(starts), 20_000):
            s = slice(part, part + 20_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[c] for c in code[starts[s]]], pa.string()),
                    pa.array(block[starts[s]], pa.int64()),
                    pa.array(sizes[s], pa.int64()),
                    pa.array(np.diff(bounds)[s], pa.int32()),
                    pa.array([pack(distinct[a:b]) for a, b in zip(bounds[s], bounds[1:][s])], pa.binary()),
                ],
                names=["term", "block", "occurrences", "records", "bitmap"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lists: list[list[str]] = []
        size = 0
        for batch in batches:
            for i, value in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found = terms(value)
                ids.append(i)
                lists.append([sys.intern(t) for t in found])
                size += len(found)
                if size > 4_000_000:
                    yield from flush(ids, lists)
                    ids, lists, size = [], [], 0
        yield from flush(ids, lists)

    return run


@F.pandas_udf(T.IntegerType())
def _union_size(bitmaps):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([0 if bs is None else len(np.unique(np.concatenate([unpack(b) for b in bs]))) for bs in bitmaps], dtype="int32")


def bitmaps(df: DataFrame, terms: Callable) -> DataFrame:
    """Compressed bitmaps and occurrence counters of (identifier, value) rows, by term and block and partition."""
    return df.mapInArrow(_build(terms), SCHEMA)


def frequencies(parts: DataFrame) -> DataFrame:
    """(term, occurrences, records): bitmaps merged by union, record frequency read from cardinality.

    One block of one term has at most 65,536 identifiers, each in one part but for
    repeated records: its parts come to some 256 KiB however many partitions they are from.
    """
    lone = F.count("*") == 1
    merged = parts.groupBy("term", "block").agg(
        F.sum("occurrences").alias("occurrences"),
        F.when(lone, F.sum("records")).alias("records"),
        F.when(~lone, F.collect_list("bitmap")).alias("bitmaps"),
    )
    sizes = merged.select("term", "occurrences", F.coalesce("records", _union_size("bitmaps")).alias("records"))
    return sizes.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: int) -> DataFrame:
    """Adds ``mark``: rare for at most RARE records, common for more than COMMON_SHARE of all, else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= RARE, "rare").when(F.col("records") > COMMON_SHARE * total, "common"))


def text_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(field, term, occurrences, records, mark) of a text column."""
    identity = F.coalesce(F.col(id_col).cast("bigint"), -1 - F.monotonically_increasing_id())
    rows = docs.where(F.col(text_col).isNotNull()).select(identity.alias("id"), text_col)
    return marked(frequencies(bitmaps(rows, text_terms)), rows.count()).select(F.lit("text").alias("field"), "*")


def latest_entities(graph: DataFrame) -> DataFrame:
    """(id, entities): the row of latest loaded_at of each doc_key, numbered within partitions."""
    latest = graph.groupBy("doc_key").agg(F.max_by("entities", "loaded_at").alias("entities"))
    return latest.select(F.monotonically_increasing_id().alias("id"), "entities")


def entity_frequencies(graph: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, mark) of the entities of the latest rows."""
    rows = latest_entities(graph)
    total = graph.agg(F.count_distinct("doc_key")).first()[0]
    return marked(frequencies(bitmaps(rows, entity_terms)), total).select(F.lit("entities").alias("field"), "*")


def all_frequencies(docs: DataFrame, graph: DataFrame) -> DataFrame:
    """The frequencies of both fields."""
    return text_frequencies(docs).unionByName(entity_frequencies(graph))


def found(docs: DataFrame, graph: DataFrame) -> DataFrame:
    """p4_found: field, term, mark of the terms that are too rare or too common."""
    return all_frequencies(docs, graph).where("mark is not null").select("field", "term", "mark")
