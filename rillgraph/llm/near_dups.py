"""Problem 2: near-duplicate records with small edits.

PartEnum signatures on the distinct character triples of content strings.  Texts
are banded by the size of their sets; a text takes part in its own band and in those
of the larger sets that it could match.  Within a band the hashed feature domain is
partitioned into a grid of q x q cells, and the subsets of cells that are enumerated
are the q lines of each of several directions of the grid: two lines of different
directions share one cell, so that the differences of two texts that spoil a line
of one direction are scattered over those of the others.  A signature is a text's
projection on one line; texts as similar as the threshold share several signatures
and share none with a probability of about ``exp(-EXPECTED)`` at the threshold
itself, less above it.

Copies (equal content strings) are collapsed first.  Signatures travel packed, a
block per bucket and batch, and are matched in buckets that Spark sorts together.
A signature shared by more than ``HOT`` texts isn't paired: its texts are given
second signatures, in another grid, under the first one, and so on while that halves
the pairs left.  What stays crowded is paired in blocks of texts, where the filter
comes before a pair is made.  Candidates are filtered by a parity sketch (its Hamming
distance never exceeds that of the sets, so nothing is lost) and then verified
exactly.  Sizes, sketches and the hash seeds don't depend on the data.

Nulls and texts with too short a content string are left out; texts without three
characters have no features and no partners.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.llm.keys import LONG_ENOUGH, contents
from rillgraph.sources.scratch import written

SHINGLE, THRESHOLD = 3, 0.7
EXPECTED = 7.5
HOT, BLOCK, LEVELS = 2000, 2000, 4
SLOT_BITS, EXTRA_BITS, MOST = 20, 3, 12
BUCKET_BYTES, BATCH_CHARS, SALTS = 8_000_000, 2_000_000, 8
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct feature, ordered by text, and the number of features of each text."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(chars) < SHINGLE:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    code = (chars[:-2] << np.uint64(42)) | (chars[1:-1] << np.uint64(21)) | chars[2:]
    inside = owner[:-2] == owner[2:]
    value, owner = mixed(code[inside]), owner[:-2][inside]
    # 48 bits of the hash below the text's number, which is less than 65,536: one sort finds what is distinct
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner = (key >> np.uint64(48)).astype(np.int64)
    return owner, key << np.uint64(16), np.bincount(owner, minlength=len(texts))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


class Bands:
    """The grid of each band of sizes: lines a direction, and directions to start with.

    ``rarity`` has the information of each slot of hashed features, in eighths of a
    bit.  A line is used if its features have ``needed`` bits together, which a
    collection of this size must ask for, lest unrelated texts share it; two texts
    with the same features on a line decide alike.  Texts of common features leave out
    more lines and go through more directions, and through the lines left out if these
    aren't enough.  A line of a text's own rare features is telling, but no other text
    has it: see ``losses``.
    """

    def __init__(self, threshold: float, texts: int, rarity: np.ndarray) -> None:
        self.threshold = threshold
        self.rarity = rarity
        self.needed = 8 * (math.log2(max(2, texts)) + EXTRA_BITS)
        self.differ = 2 * (1 - threshold) / (1 + threshold)  # differing features per feature at the threshold
        self.more = 0.12 * max(0.0, math.log2(max(1, texts) / 250_000))  # longer lines for larger collections
        self.known: dict[int, tuple[int, int]] = {}

    @staticmethod
    def of(sizes: np.ndarray | float) -> np.ndarray:
        return np.floor(2 * np.log2(np.maximum(sizes, 1))).astype(np.int64)

    def grid(self, band: int) -> tuple[int, int]:
        if band not in self.known:
            size = 2 ** ((band + 0.5) / 2)
            line = min(9.0, max(3.0, 4.9 + 1.6 * math.log2(size / 116))) + self.more
            q = max(2, round(size / min(line, max(1.5, size / 3))))
            while not _is_prime(q):
                q += 1
            self.known[band] = q, max(1, math.floor(EXPECTED / (q * math.exp(-self.differ * size / q))))
        return self.known[band]

    def lacking(self, band: int, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ways to be at the threshold with a larger text of the band, or a smaller one: features that the other text lacks, and that it adds, per feature of a text."""
        low, top = 2 ** (band / 2) / sizes, 2 ** ((band + 1) / 2) / sizes
        most = np.where(low <= 1, 1 - self.threshold, np.maximum(0, 1 - self.threshold * low) / (1 + self.threshold))
        ways = [most * part for part in (0, 0.6, 1)]
        return [(u, np.maximum(0, np.minimum((1 - u) / self.threshold - 1, top - (1 - u)))) for u in ways]

    @staticmethod
    def losses(text: np.ndarray, bits: np.ndarray, sizes: np.ndarray, lacks: list[np.ndarray]) -> list[np.ndarray | None]:
        """Of each feature, None for a text that lacks nothing, -log of the chance that the other text has it, if it lacks this share of a text's features, the rarest first; equally rare ones share what is left."""
        key = text * 64 + (63 - (bits.astype(np.int64) >> 2))
        held = np.bincount(key, minlength=len(sizes) * 64).reshape(len(sizes), 64)
        before = np.cumsum(held, axis=1) - held
        gone = (np.clip((u[:, None] * sizes[:, None] - before) / np.maximum(held, 1), 0, 1) if u.any() else None for u in lacks)
        return [g if g is None else -np.log(np.maximum(1 - g, 1e-9)).ravel()[key] for g in gone]


def rarity(texts: DataFrame, rows: int) -> np.ndarray:
    """Information of each of 2**SLOT_BITS slots of hashed features, in eighths of a bit, counted over all texts.

    Partitions count in arrays of fixed size, whose segments are added up in reducers
    that stream over them; 4 MiB come to the driver whatever the size of the table.
    """
    slots, segment = 1 << SLOT_BITS, 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in _chunks(batches, "content"):
            _, value, _ = features(batch.column("content").to_pylist())
            total += np.bincount((value >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=slots)
        for k in range(slots // segment):
            part = total[k * segment : (k + 1) * segment]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "counts": [_planes(part.astype("<u8"))]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
                totals[k] = totals.get(k, 0) + _unplanes(counts, 8).view("<u8")
        for k, total in totals.items():
            bits = np.clip(np.floor(8 * np.log2(np.maximum(rows, 1) / np.maximum(total, 1))), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "bits": [bits.tobytes()]})

    out = np.full(slots, min(255, int(8 * math.log2(max(2, rows)))), np.uint8)
    parts = texts.select("content").mapInArrow(count, "segment int, counts binary")
    for r in parts.repartition(slots // segment, "segment").mapInArrow(add, "segment int, bits binary").collect():
        out[r.segment * segment : (r.segment + 1) * segment] = np.frombuffer(r.bits, np.uint8)
    return out


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that planes of zeros compress away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(planes: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T)


def signatures(texts: list[str], bands: Bands, above: np.ndarray | None = None, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each signature; ``above`` are the signatures that they refine.

    A text goes through directions until the lines that it used let it expect
    ``EXPECTED`` common signatures with a text at the threshold, whichever its
    differences are: those of its features that the other text lacks are taken to be
    its rarest ones, as telling lines hold most of these and are fewest without them.
    """
    owner, value, sizes = features(texts)
    first = Bands.of(sizes)
    last = Bands.of(np.floor(sizes / bands.threshold + 1e-9))
    starts = np.r_[0, np.cumsum(sizes)]
    numbers, found = [], []
    for band in range(int(first.min(initial=0)), int(last.max(initial=0)) + 1):
        live = np.flatnonzero((first <= band) & (band <= last) & (sizes > 0))
        q, directions = bands.grid(band)
        lacking = bands.lacking(band, np.maximum(sizes, 1))
        reached = np.zeros((len(lacking), len(texts)))
        # telling lines first; texts that haven't enough of them go on with the others
        rounds = [(r, True) for r in range(MOST)] + [(r, False) for r in range(MOST)] if above is None else []
        if not len(live):
            continue
        n = sizes[live]
        at = np.repeat(starts[live] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        v = value[at]
        bits = bands.rarity[(v >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.float64) + 1e-6  # so that no line with features has none
        lost = bands.losses(np.repeat(np.arange(len(live)), n), bits, n, [u[live] for u, _ in lacking])
        # 44 bits, of which a double holds sums exactly; other lines of equal sums are told apart when pairs are verified
        mix = (mixed(v ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.float64)
        going, grid, small = np.ones(len(live), bool), -1, np.int32 if q < 30_000 else np.int64
        for r, telling in itertools.chain(rounds, ((r, None) for r in itertools.count(MOST if rounds else 0))):
            if not going.any():
                break
            if going.sum() < 0.8 * len(live):  # go on with what is left
                on = np.repeat(going, n)
                v, bits, mix, lost = v[on], bits[on], mix[on], [x if x is None else x[on] for x in lost]
                live, n, going, grid = live[going], n[going], going[going], -1
            if r // q != grid:  # a grid has as many directions as lines; then the features are laid out anew
                grid = r // q
                place = mixed(v + np.uint64(level + LEVELS * grid)) if level or grid else v
                row, column = ((place >> np.uint64(40)) % np.uint64(q)).astype(small), ((place >> np.uint64(16)) % np.uint64(q)).astype(small)
                cell, cells = np.repeat(np.arange(len(live)) * q, n), len(live) * q
            slot = cell + (row + small(r % q) * column) % small(q)
            weight = np.bincount(slot, bits, cells)
            use = (weight > 0) if telling is None else (weight > 0) & ((weight >= bands.needed) == telling)
            keep = np.flatnonzero(use & np.repeat(going, q))
            total = np.bincount(slot, mix, cells)[keep].astype(np.uint64)
            name = np.uint64((band << 40) + (r << 24)) + (keep % q).astype(np.uint64)
            number = live[keep // q]
            signature = mixed(total + mixed(name))
            found.append(signature if above is None else mixed(signature + above[number]))
            numbers.append(number)
            # both texts have a line's features and the other text adds none
            for k, loss in enumerate(lost):
                lost_here = 0 if loss is None else np.bincount(slot, loss, cells)[keep]
                same = np.exp(-lost_here - (lacking[k][1] * sizes)[number] / q)
                reached[k] += np.bincount(number, same, len(texts)) + 1e-3  # lest rounding keeps a text for ever
            if r + 1 >= directions or not telling:
                going &= reached[:, live].min(axis=0) < EXPECTED
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(numbers), np.concatenate(found)


def sketch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of features of each text, and four longs of the parity of its hashed features."""
    owner, value, sizes = features(texts)
    bit = (value >> np.uint64(48)).astype(np.int64) % 256
    parity = (np.bincount(owner * 256 + bit, minlength=len(texts) * 256) & 1).astype(np.uint8).reshape(len(texts), 256)
    return sizes, np.packbits(parity, axis=1, bitorder="little").view(np.int64).reshape(len(texts), 4)


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds a bounded number of characters, or one text."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in batch.column(text).to_pylist()])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, "right")))
            end = min(end, at + 60_000)
            yield batch.slice(at, end - at)
            at = end


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG_ENOUGH) -> DataFrame:
    """doc_id, k1, k2, content of the long-enough rows; written once."""
    return written(contents(docs, id_col, text_col, least), "contents")


def classes(rows: DataFrame) -> DataFrame:
    """One row per content of stored rows: rid, k1, k2, first_doc_id, copies, n, s0..s3, content; written once."""
    rows = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"), F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "content"):
            n, s = sketch(batch.column("content").to_pylist())
            extra = {"n": pa.array(n, pa.int64())} | {f"s{k}": pa.array(s[:, k], pa.int64()) for k in range(4)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])

    schema = "k1 bigint, k2 bigint, first_doc_id bigint, copies bigint, content string, n bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    return written(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "classes")


def _blocks(texts: DataFrame, bands: Bands, buckets: int, level: int) -> DataFrame:
    """(bucket, base, rows): packed signatures and text numbers, one block per bucket and run of neighbouring rids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "content"):
            rids = batch.column("rid").to_numpy()
            above = batch.column("above").to_numpy().view(np.uint64) if level else None
            breaks = np.r_[0, np.flatnonzero((np.diff(rids) < 0) | (rids[1:] - np.maximum.accumulate(rids)[:-1] > 60_000)) + 1, len(rids)] if len(rids) else [0]
            for a, b in zip(breaks, breaks[1:]):
                for c in range(a, b, 60_000):
                    part = rids[c : min(b, c + 60_000)]
                    if part.max() - part.min() > 65_535:
                        pieces = [(i, i + 1) for i in range(len(part))]
                    else:
                        pieces = [(0, len(part))]
                    for x, y in pieces:
                        yield block(batch.column("content").slice(c + x, y - x).to_pylist(), part[x:y], above[c + x : c + y] if level else None)

    def block(contents_: list[str], rids: np.ndarray, above: np.ndarray | None) -> pa.RecordBatch:
        number, signature = signatures(contents_, bands, above, level)
        bucket = ((signature >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65_536 else np.int64)
        base = int(rids.min())
        offset = (rids - base).astype(np.uint16)
        rest = signature & np.uint64(0xFFFFFFFF)
        order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | rest)
        rest, near = rest.astype(np.uint32)[order], offset[number[order]]
        bucket = bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        names, ends = bucket[starts], np.r_[starts[1:], len(order)]
        # neighbouring signatures differ little: their high bytes compress away
        packed = [_planes(np.diff(rest[i:j], prepend=np.uint32(0)).astype("<u4")) + near[i:j].tobytes() for i, j in zip(starts, ends)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(names.astype(np.int32)), "base": pa.array([base] * len(names), pa.int64()), "rows": pa.array(packed, pa.binary())})

    return texts.mapInArrow(run, "bucket int, base bigint, rows binary")


def _pairs_of(signature: np.ndarray, rid: np.ndarray, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, a, b): pairs of texts with equal signatures (0), or a text and its signature where too many share it (1)."""
    # signatures first, then texts by their place among the sorted rids: one sort of 64-bit keys
    names = np.sort(rid)
    names = names[np.r_[True, names[1:] != names[:-1]]] if len(names) else names
    key = np.sort((signature.astype(np.uint64) << np.uint64(32)) | np.searchsorted(names, rid).astype(np.uint64))
    signature, rid = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.r_[True, signature[1:] != signature[:-1]]
    again = np.r_[False, (signature[1:] == signature[:-1]) & (rid[1:] == rid[:-1])]
    signature, rid, group = signature[~again], rid[~again], np.cumsum(start)[~again]
    size = np.bincount(group)
    over = np.flatnonzero(size[group] > hot)
    yield np.ones(len(over), np.int8), names[rid[over]], signature[over].astype(np.int64)
    at = np.flatnonzero((size[group] > 1) & (size[group] <= hot))
    rid, group = rid[at], group[at]
    live = np.arange(len(rid))
    step = 0
    a, b, held = [], [], 0
    while len(live):
        step += 1
        live = live[live + step < len(rid)]
        live = live[group[live] == group[live + step]]
        a.append(rid[live])
        b.append(rid[live + step])
        held += len(live)
        if held > 1_000_000 or not len(live):
            pair = np.sort((np.concatenate(a).astype(np.uint64) << np.uint64(32)) | np.concatenate(b).astype(np.uint64))
            pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
            yield np.zeros(len(pair), np.int8), names[(pair >> np.uint64(32)).astype(np.int64)], names[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            a, b, held = [], [], 0


def _matched(blocks: DataFrame, hot: int) -> DataFrame:
    """(kind, a, b) of all buckets; the texts of one signature are in one bucket, whose pairs are passed on as they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature, rid, bucket = [], [], 0
        for batch in batches:
            for bucket, base, rows in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", "rows"))):
                n = len(rows) // 6
                signature.append(np.cumsum(_unplanes(rows[: 4 * n], 4).view("<u4").ravel(), dtype=np.uint32))
                rid.append(np.frombuffer(rows, np.uint16, n, 4 * n).astype(np.int64) + base)
        for kind, a, b in _pairs_of(np.concatenate(signature), np.concatenate(rid), hot):
            b = np.where(kind == 1, b | (bucket << 32), b)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int8()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("bucket").applyInArrow(run, "kind tinyint, a bigint, b bigint")


def _with_sketches(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes and sketches of both."""
    for side in ("a", "b"):
        pairs = pairs.join(_sketches(texts, side).hint("merge"), side)
    return pairs


def _sketches(texts: DataFrame, side: str) -> DataFrame:
    return texts.select(F.col("rid").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "s0", "s1", "s2", "s3")))


def _likely(threshold: float) -> Column:
    """Whether sizes and sketches leave it open that a and b match."""
    apart = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(4)), F.lit(0))
    most = (1 - threshold) / (1 + threshold)
    return (apart <= most * (F.col("a_n") + F.col("b_n")) + 1e-9) & (F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9)


def _crowds(crowded: DataFrame) -> DataFrame:
    """(above, size) of crowded signatures, one of those that have the same texts: the others would lead to the same pairs."""
    hashes = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"h{k}") for k in range(2)]
    sets = crowded.groupBy("above").agg(F.count("*").alias("size"), *hashes)
    return written(sets.groupBy("size", "h0", "h1").agg(F.min("above").alias("above")).select("above", "size"), "crowds")


def _in_blocks(crowded: DataFrame, crowds: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of each crowded signature that sizes and sketches leave open, joined block by block of its texts."""
    blocks = crowds.select("above", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    held = crowded.join(blocks.hint("merge"), "above").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    held = written(held, "crowded")
    left = held.select("above", F.col("rid").alias("a"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j")).join(_sketches(texts, "a").hint("merge"), "a")
    right = held.select("above", F.col("rid").alias("b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i")).join(_sketches(texts, "b").hint("merge"), "b")
    pairs = left.join(right.hint("merge"), ["above", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & _likely(threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def candidates(texts: DataFrame, rows: int, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: rids of classes that share a signature; a pair comes once for each bucket in which it does."""
    bands = Bands(threshold, rows, rarity(texts, rows))
    buckets = min(1_000_000, max(24, rows * 700 // BUCKET_BYTES))
    now = texts.select("rid", "content")
    out, before = None, None
    for level in range(LEVELS):
        found = written(_matched(_blocks(now, bands, buckets, level), hot), "candidates")
        pairs = found.where("kind = 0").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
        crowded = found.where("kind = 1").select(F.col("a").alias("rid"), F.col("b").alias("above"))
        if crowded.isEmpty():
            break
        crowds = _crowds(crowded)
        left = crowds.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0]
        if level == LEVELS - 1 or before is not None and left > before / 2:
            out = out.unionByName(_in_blocks(crowded, crowds, texts, threshold))
            break
        before = left
        crowded = crowded.join(crowds.select("above").hint("merge"), "above")
        now = crowded.join(texts.select("rid", "content").hint("merge"), "rid").sortWithinPartitions("rid").select("rid", "content", "above")
    return out


def shared_features(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that the texts of each pair share, and features of either text; each text is taken apart once."""
    place: dict[str, int] = {}
    left = np.array([place.setdefault(a, len(place)) for a, _ in pairs], np.int64)
    right = np.array([place.setdefault(b, len(place)) for _, b in pairs], np.int64)
    _, value, sizes = features(list(place))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    keys = []
    for side in (left, right):
        n = sizes[side]
        at = np.repeat(starts[side] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        keys.append((np.repeat(np.arange(len(pairs)), n).astype(np.uint64) << np.uint64(48)) | (value[at] >> np.uint64(16)))
    key = np.sort(np.concatenate(keys))
    twice = key[1:][key[1:] == key[:-1]] >> np.uint64(48)
    return np.bincount(twice.astype(np.int64), minlength=len(pairs)), sizes[left], sizes[right]


@F.pandas_udf(T.BooleanType())
def _similar(a, b, threshold):  # noqa: ANN001, ANN202
    import pandas as pd

    out, held, size = [], [], 0
    least = threshold.iloc[0] if len(threshold) else 0

    def flush() -> None:
        both, x, y = shared_features(held)
        out.append((both > 0) & (both >= least * (x + y - both) - 1e-9))

    for pair in zip(a, b):
        held.append(pair)
        size += len(pair[0]) + len(pair[1])
        if size > BATCH_CHARS or len(held) > 30_000:
            flush()
            held, size = [], 0
    if held:
        flush()
    return pd.Series(np.concatenate(out) if out else [], dtype=bool)


def class_pairs(texts: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(a, b): rids of classes with different contents that are at least as similar as the threshold."""
    rows = texts.count()
    # a pair comes once for each bucket that it shares: distinct pairs are fewer before sketches are added to them
    found = _with_sketches(candidates(texts, rows, threshold, hot).distinct(), texts)
    likely = written(found.where(_likely(threshold)).select("a", "b"), "likely")
    texts_of = texts.select("rid", "content")
    both = likely.join(texts_of.select(F.col("rid").alias("a"), F.col("content").alias("ca")).hint("merge"), "a").join(texts_of.select(F.col("rid").alias("b"), F.col("content").alias("cb")).hint("merge"), "b")
    return both.where(_similar("ca", "cb", F.lit(threshold))).select("a", "b")


def found(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """p2_found: doc_id_a, doc_id_b of all rows of matching classes; large classes are salted."""
    rows = stored(docs)
    texts = classes(rows)
    pairs = written(class_pairs(texts, threshold), "class-pairs")
    touched = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    of = texts.join(touched.hint("merge"), "rid").select("rid", "k1", "k2", "first_doc_id", "copies")
    alone = of.where("copies = 1").select("rid", F.col("first_doc_id").alias("doc_id"))
    several = rows.select("doc_id", "k1", "k2").join(of.where("copies > 1").select("rid", "k1", "k2").hint("merge"), ["k1", "k2"]).select("rid", "doc_id")
    members = written(alone.unionByName(several), "members")
    left = pairs.join(members.select(F.col("rid").alias("a"), F.col("doc_id").alias("x")).hint("merge"), "a").withColumn("salt", F.pmod("x", F.lit(SALTS)))
    right = members.select(F.col("rid").alias("b"), F.col("doc_id").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return left.join(right.hint("merge"), ["b", "salt"]).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def components(pairs: DataFrame) -> DataFrame:
    """(rid, label): the smallest rid that each class is linked to, over any number of steps.

    Every round takes the smallest label among a class and its neighbours and then
    that label's own label, so that rounds grow as the logarithm of the longest chain;
    labels are written between rounds and only a count of changes comes to the driver.
    """
    both = written(pairs.union(pairs.select("b", "a")).toDF("rid", "next"), "links")
    labels = written(both.groupBy("rid").agg(F.least("rid", F.min("next")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("rid").alias("next"), F.col("label").alias("theirs")), "next").groupBy("rid").agg(F.min("theirs").alias("theirs"))
        closer = labels.join(near, "rid").select("rid", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        jumped = labels.select(F.col("rid").alias("label"), F.col("label").alias("further"))
        now = written(closer.join(jumped, "label", "left").select("rid", "before", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = now.select("rid", "label")
        if now.where("label <> before").isEmpty():
            return labels


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, group_id, links) of every long-enough row.

    ``class_id`` is the smallest doc_id with the same content, ``links`` the number of
    other contents similar to it, ``group_id`` the smallest class_id that chains of
    links lead to.
    """
    stored_rows = stored(docs)
    texts = classes(stored_rows)
    pairs = written(class_pairs(texts, threshold), "class-pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    narrow = texts.select("rid", "k1", "k2", "first_doc_id")
    labelled = components(pairs).join(narrow.select("rid", "first_doc_id"), "rid")
    leads = labelled.groupBy("label").agg(F.min("first_doc_id").alias("group_id"))
    of = narrow.join(labelled.join(leads, "label").select("rid", "group_id"), "rid", "left").join(links, "rid", "left")
    rows = of.select("k1", "k2", F.col("first_doc_id").alias("class_id"), F.coalesce("group_id", "first_doc_id").alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    keys = stored_rows.select("doc_id", "k1", "k2").withColumn("salt", F.pmod("doc_id", F.lit(SALTS)))
    return keys.join(salted, ["k1", "k2", "salt"]).select("doc_id", "class_id", "group_id", "links")
