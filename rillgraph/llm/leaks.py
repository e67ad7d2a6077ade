"""Problem 6: evaluation texts that leak into training text.

Pigeonhole edit matching on content strings: items are cut into pieces so small that
every passage (any window of ``passage`` characters) holds ``budget + 1`` whole ones,
one of which is unchanged where it has at most ``budget`` errors.  Pieces are looked
up by a rolling hash of all positions of a batch of documents; each hit is extended
to its longest exact run, and where that is shorter than a passage, verified to
either side by Myers' bit-parallel distance: how much of the item is matched there
with each number of errors.  Together both sides show whether any passage through the
piece is within the budget.

Items are a stated query set: they are sent to the tasks in blocks of at most
``BLOCK_CHARS`` characters, one pass over the documents per block; where there are
several blocks, the documents' content strings are written once before.  Null and
empty texts leak nothing; items with fewer characters than a passage can't be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import forms
from rillgraph.sources.scratch import written

PASSAGE, BUDGET = 50, 1
BLOCK_CHARS = 8_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_FILTER_BITS = 22


def rolling(chars: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbouring code points, built by doubling."""
    out, have, power = None, 0, _BASE
    block, length = chars.astype(np.uint64), 1
    while True:
        if size & length:
            if out is None:
                out, have = block, length
            else:
                n = len(chars) - have - length + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                out = block[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + out[length : length + n]
                have += length
        if length * 2 > size:
            return out[: max(0, len(chars) - size + 1)]
        n = len(block) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        block = block[:n] * np.uint64(power) + block[length : length + n]
        power = power * power % (1 << 64)
        length *= 2


def myers(pattern: str, text: str) -> int:
    """The least edit distance of ``pattern`` to any part of ``text``, bit-parallel."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & last) - bool(left & last)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        best = min(best, score)
    return best


def reach(item: str, text: str, budget: int) -> list[int]:
    """The most characters at the start of ``item`` that match a start of ``text`` with 0, 1, .. ``budget`` errors.

    Myers' columns for a match that begins where the text begins: the differences down a
    column, kept as bits, give the distance of every start of the item to that start of
    the text, of which only those near the diagonal can be within the budget.
    """
    m = len(item)
    out = [min(k, m) for k in range(budget + 1)]
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << m) - 1
    up, down = full, 0
    for j, c in enumerate(text[: m + budget], 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        near = range(max(0, j - budget), min(m, j + budget) + 1)
        distance = j + (up & (1 << near.start) - 1).bit_count() - (down & (1 << near.start) - 1).bit_count()
        least = budget + 1
        for i in near:
            if distance <= budget:
                least = min(least, distance)
                for k in range(distance, budget + 1):
                    out[k] = max(out[k], i)
            distance += (up >> i & 1) - (down >> i & 1)
        if least > budget:
            break  # no start of the item is within the budget any more
    return out


def may_reach(item: str, text: str, length: int, budget: int) -> bool:
    """Whether the first ``length`` characters of ``item`` can match a start of ``text``: one of ``budget + 1`` parts of them is unchanged there."""
    size = length // (budget + 1)
    return len(item) >= length and any(item[k * size : (k + 1) * size] in text for k in range(budget + 1))


class Pieces:
    """The aligned pieces of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], passage: int, budget: int) -> None:
        self.passage, self.budget, self.size = passage, budget, (passage + 1) // (budget + 2)
        self.items = [(i, forms.content(t, records=False)) for i, t in items if t]
        self.items = [(i, c) for i, c in self.items if len(c) >= passage]
        spans = [(n, p) for n, (_, c) in enumerate(self.items) for p in range(0, len(c) - self.size + 1, self.size)]
        chars = np.frombuffer("".join(self.items[n][1][p : p + self.size] for n, p in spans).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = rolling(chars, self.size)[:: self.size] if spans else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.spans = hashes[order], [spans[i] for i in order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, contents: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(document, position, item, position) of each piece found in a document."""
        sizes = np.array([len(c) for c in contents], np.int64)
        ends = np.cumsum(sizes)
        found = rolling(np.frombuffer("".join(contents).encode("utf-32-le", "surrogatepass"), np.uint32), self.size)
        at = np.flatnonzero(self.maybe[found >> np.uint64(64 - _FILTER_BITS)])
        lo, hi = np.searchsorted(self.hashes, found[at], "left"), np.searchsorted(self.hashes, found[at], "right")
        keep = hi > lo
        at, lo, hi = at[keep], lo[keep], hi[keep]
        doc = np.searchsorted(ends, at, "right")
        inside = at + self.size <= ends[np.minimum(doc, len(ends) - 1)] if len(ends) else at < 0
        for d, a, x, y in zip(doc[inside].tolist(), at[inside].tolist(), lo[inside].tolist(), hi[inside].tolist()):
            position = a - int(ends[d] - sizes[d])
            for k in range(x, y):
                n, p = self.spans[k]
                if contents[d].startswith(self.items[n][1][p : p + self.size], position):
                    yield d, position, n, p

    def leaks(self, contents: list[str]) -> list[tuple[int, int, int, int]]:
        """(document, item_id, longest exact run, least distance of a passage) of the leaks."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        reached: dict[tuple[int, int, int], int] = {}
        for d, a, n, p in self.hits(contents):
            if reached.get((d, n, a - p), -1) >= a + self.size:
                continue  # within a run that was followed already
            text, item = contents[d], self.items[n][1]
            left, right = 0, self.size
            while a - left and p - left and text[a - left - 1] == item[p - left - 1]:
                left += 1
            while a + right < len(text) and p + right < len(item) and text[a + right] == item[p + right]:
                right += 1
            reached[d, n, a - p] = a + right
            run, distance = left + right, 0
            if run < self.passage:
                e, most = self.budget, self.passage - run
                x, y, i, j = p - left, a - left, p + right, a + right  # the ends of the run in both
                sides = (item[i : i + most], text[j : j + most + e]), (item[max(0, x - most) : x][::-1], text[max(0, y - most - e) : y][::-1])
                # one side alone has half of what is missing, all of it where there is but one error
                if not any(may_reach(*side, most if e < 2 else -(-most // 2), e) for side in sides):
                    continue
                after, before = (reach(*side, e) for side in sides)
                distance = min((x + y for x in range(e + 1) for y in range(e + 1 - x) if before[x] + after[y] >= most), default=e + 1)
                if distance > e:
                    continue
            old = best.get((d, n), (0, self.passage))
            best[d, n] = max(old[0], run), min(old[1], distance)
        return [(d, self.items[n][0], run, distance) for (d, n), (run, distance) in best.items()]


def leaks(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, exact_chars, distance): every document and item that share a passage up to ``budget`` errors."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)  # of any length: a content string may be longer than its text
    items = items.where("text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    if blocks > 1:
        rows = written(rows.mapInArrow(_stripped, "doc_id bigint, content string"), "contents")
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])  # at most about BLOCK_CHARS characters

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = Pieces(sent.value, passage, budget)
            for batch in batches if blocks > 1 else _stripped(batches):
                ids, contents = batch[0].to_pylist(), batch[1].to_pylist()
                found = [(ids[d], i, run, distance) for d, i, run, distance in index.leaks(contents)] if contents else []
                columns = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "exact_chars", "distance"])

        part = rows.mapInArrow(run, "doc_id bigint, item_id bigint, exact_chars int, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and content strings of batches of ids and texts."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch[0], pa.array([forms.content(t, records=False) for t in batch[1].to_pylist()], pa.string())], names=["doc_id", "content"])


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """p6_found: doc_id, item_id of the leaks, by the same search, that hold a passage without any error."""
    return leaks(docs, items).where(F.col("exact_chars") >= PASSAGE).select("doc_id", "item_id")
