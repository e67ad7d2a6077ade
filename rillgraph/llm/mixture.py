"""Problem 7: mixing sources to target weights.

Soft-membership mixing: a classifier fitted on labelled rows gives the probability
of each source for a document; where the label itself is known it is certain.  The
expected tokens of each source under per-document rates (how often a document is
used, 0 to its source's ``max_repeat``) are matched to the targets by projected
gradient least squares.  Documents of a known source all have the same rate, so that
one pass adds up their tokens by source; only documents without a source are gone
through at every step, which adds up one number per source, and their rates follow
from the few steps' residuals alone, so that nothing per document leaves the tasks.
Rates are rounded to whole copies by a hash of the document, with one threshold per
source chosen from a histogram so that rounding doesn't move the totals.

The total is the largest for which every target can be met within ``max_repeat``.
The classifier (softmax regression on the hashed first characters of lines and the
hashed neighbouring characters of the whole text) is fitted on about ``SAMPLE`` labelled rows, those with the smallest hashes of their id; everything
else covers all documents.  Null and empty texts have no tokens and aren't used;
sources without a target aren't used either.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.sources.scratch import written

SAMPLE, FEATURES = 4000, 1024
#: Length of the part of a feature vector that has the whole text; the part that has the beginnings of lines has length 1.
WHOLE = 0.5
STEPS, CLOSE, BINS = 60, 1e-5, 4096
_LINE_START = re.compile(r"(?:^|[\n\r])\s*(.{1,4})")
_DIGITS = re.compile(r"\d+")
# Fixed value: the word pattern that goes with the vocabulary files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks, loaded once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _unit(counts: np.ndarray) -> np.ndarray:
    """Damped counts, each row a unit vector."""
    out = np.log1p(counts)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features(texts: list[str]) -> np.ndarray:
    """The hashed first two, three and four characters of the lines of each text, and its hashed pairs of neighbouring characters, numbers made alike."""
    starts, pairs = np.zeros((2, len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        text = _DIGITS.sub("0", text).lower()
        for start in _LINE_START.findall(text):
            for k in range(2, len(start) + 1):
                starts[i, zlib.crc32(start[:k].encode("utf-8", "surrogatepass")) % FEATURES] += 1
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = signs[:-1] * np.uint64(0x9E3779B97F4A7C15) + signs[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
        pairs[i] = np.bincount((mixed % np.uint64(FEATURES)).astype(np.int64), minlength=FEATURES)
    return np.hstack([_unit(starts), WHOLE * _unit(pairs)])


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 100, rate: float = 20.0, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a softmax regression, with a constant as the last feature."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    onehot = np.eye(classes, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], classes), np.float32)
    v = np.zeros_like(w)
    for _ in range(rounds):
        v = 0.9 * v - rate * (x.T @ (posteriors(x, w) - onehot) / len(x) + ridge * w) * 0.1
        w = w + v
    return w


def posteriors(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The probability of each class."""
    x = x if x.shape[1] == len(w) else np.c_[x, np.ones(len(x), np.float32)]
    z = x @ w
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def classifier(docs: DataFrame, sources: list[str], sample: int = SAMPLE) -> np.ndarray | None:
    """Weights fitted on about ``sample`` labelled rows, on all if there are no more; None without labelled rows.

    The rows are chosen by a threshold on a hash of their id, so that nothing is sorted
    or sent to one task; only their feature vectors of fixed size come to the driver.
    """
    rows = docs.where(F.col("source").isin(sources) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    total = rows.count()
    if total > sample:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < int(sample / total * 2**32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch[1].to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([r.tobytes() for r in x], pa.binary())], names=["source", "x"])

    found = rows.select("source", "text").mapInArrow(run, "source string, x binary").collect()
    if not found:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in found]).astype(np.float32)
    return fit(x, np.array([sources.index(r.source) for r in found]), len(sources))


def members(docs: DataFrame, sources: list[str], weights: np.ndarray | None, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens, k, p): tokens of every text and the place of its source among those with a target.

    Without a source ``k`` is -1 and ``p`` has the probabilities of the sources as packed floats.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    places = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            ids, given, texts = (c.to_pylist() for c in batch.columns[:3])
            soft: list[bytes | None] = [None] * len(ids)
            unknown = [i for i, s in enumerate(given) if s is None]
            if unknown:
                known = posteriors(features([texts[i] for i in unknown]), sent.value) if sent.value is not None else np.zeros((len(unknown), len(sources)))
                for i, row in zip(unknown, known.astype(np.float32)):
                    soft[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(given, pa.string()), pa.array([len(encode(t)) for t in texts], pa.int64()), pa.array([places.get(s, -1) for s in given], pa.int32()), pa.array(soft, pa.binary())],
                names=["doc_id", "source", "tokens", "k", "p"],
            )

    wanted = F.col("source").isNull() | F.col("source").isin(sources)
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0) & wanted)
    return rows.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint, k int, p binary")


def rates(p: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Each document's rate after the steps taken so far, kept within its bounds at each."""
    most = p @ caps
    r = np.zeros(len(p))
    for step in steps:
        r = np.clip(r + p @ step, 0, most)
    return r


def _memberships(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The share of each document of a batch in each source, one where the source is known."""
    k = batch.column("k").to_numpy()
    p = np.zeros((len(k), n))
    p[k >= 0, k[k >= 0]] = 1
    if (k < 0).any():
        p[k < 0] = np.frombuffer(b"".join(b for b in batch.column("p").to_pylist() if b is not None), np.float32).reshape(-1, n)
    return p


def _by_source(table: DataFrame, n: int) -> np.ndarray:
    """Tokens of the documents of each known source."""
    found = {r.k: r.t for r in table.where("k >= 0").groupBy("k").agg(F.sum("tokens").alias("t")).collect()}
    return np.array([float(found.get(k, 0)) for k in range(n)])


def _soft_totals(soft: DataFrame, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Expected tokens of each source from the documents without one: one row of sums per partition."""
    n = len(caps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            p, t = _memberships(batch, n), batch.column("tokens").to_numpy()
            total += p.T @ (t * (rates(p, caps, steps) if steps else 1.0))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(n), pa.int32()), "v": pa.array(total)})

    found = {r.k: r.v for r in soft.select("k", "p", "tokens").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return np.array([found.get(k, 0.0) for k in range(n)])


def fitted(table: DataFrame, soft: DataFrame, shares: np.ndarray, caps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of projected gradient least squares and the totals that they aim at.

    Steps end when every source is within ``CLOSE`` of its target, or when no step brings
    the farthest one nearer: a source at its cap can't gain from documents that only
    partly belong to it.
    """
    known, mass = _by_source(table, len(caps)), _soft_totals(soft, caps, [])
    mass = mass + known
    usable = (shares > 0) & (mass > 0)
    if not usable.any():
        return [np.zeros(len(caps))], np.zeros(len(caps))
    total = np.min(caps[usable] * mass[usable] / shares[usable])
    target = np.where(usable, shares * total, 0)
    scale = np.maximum(mass, 1)
    steps, least = [target / scale], np.inf
    for _ in range(STEPS):
        off = target - (known * rates(np.eye(len(caps)), caps, steps) + _soft_totals(soft, caps, steps))
        farthest = np.abs(off).max()
        if farthest <= CLOSE * total or farthest > 0.99 * least:
            break
        least = farthest
        steps.append(off / scale)
    return steps, target


def mixture(docs: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens, copies, membership) of the documents that are used at least once.

    ``membership`` is a document's share in each source, in the order of their names:
    one for its own source, probabilities where it has none.  ``tokenizer`` is the path of
    a public tokenizer's file of ranks, there on every executor.
    """
    rows = targets.orderBy("source").collect()  # one row per source
    sources = [r.source for r in rows]
    n = len(sources)
    shares, caps = np.array([r.target_share for r in rows], float), np.array([r.max_repeat for r in rows], float)
    shares = shares / max(shares.sum(), 1e-12)
    table = written(members(docs, sources, classifier(docs, sources), tokenizer), "members")
    soft = written(table.where("k < 0"), "soft-members")
    steps, _ = fitted(table, soft, shares, caps)

    def parts(batch: pa.RecordBatch):  # noqa: ANN202
        """Source, whole copies, place of the rounding key, and most copies of each document."""
        p, t = _memberships(batch, n), batch.column("tokens").to_numpy().astype(np.float64)
        rate = rates(p, caps, steps)
        whole = np.floor(rate + 1e-9)
        left = rate - whole
        ids = batch.column("doc_id").to_numpy().astype(np.uint64)
        mixed = (ids ^ (ids >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        chance = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
        key = np.clip(((chance - left + 1) / 2 * BINS).astype(int), 0, BINS - 1)
        key[left < 1e-9] = BINS  # nothing to round
        k = batch.column("k").to_numpy()
        known = np.where(k >= 0, k, n)  # n: no source of its own
        return known, t, rate, whole, key, np.floor(np.r_[caps, caps.min()][known] + 1e-9), p

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, wanted = np.zeros((n + 1, BINS + 1)), np.zeros(n + 1)
        for batch in batches:
            known, t, rate, whole, key, *_ = parts(batch)
            np.add.at(sums, (known, key), t)
            np.add.at(wanted, known, t * (rate - whole))
        at = np.argwhere(sums > 0)
        yield pa.RecordBatch.from_pydict({"s": pa.array(at[:, 0], pa.int32()), "k": pa.array(at[:, 1], pa.int32()), "v": pa.array(sums[tuple(at.T)])})
        yield pa.RecordBatch.from_pydict({"s": pa.array(range(n + 1), pa.int32()), "k": pa.array([-1] * (n + 1), pa.int32()), "v": pa.array(wanted)})

    sums, wanted = np.zeros((n + 1, BINS + 1)), np.zeros(n + 1)
    for r in table.mapInArrow(count, "s int, k int, v double").groupBy("s", "k").agg(F.sum("v").alias("v")).collect():
        if r.k < 0:
            wanted[r.s] = r.v
        else:
            sums[r.s, r.k] = r.v
    upto = np.cumsum(sums[:, :BINS], 1)
    threshold = np.array([int(np.abs(np.r_[0, upto[s]] - wanted[s]).argmin()) for s in range(n + 1)])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, _, _, whole, key, most, p = parts(batch)
            copies = np.minimum(whole + (key < threshold[known]), most).astype(np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("tokens"), pa.array(copies), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "source", "tokens", "copies", "membership"])
            yield out.filter(pa.array(copies > 0))

    return table.mapInArrow(choose, "doc_id bigint, source string, tokens bigint, copies bigint, membership array<double>")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, labelled_share, tokens, documents, most_copies, max_repeat) of a mixture.

    ``reached_share`` counts documents without a source by their membership,
    ``labelled_share`` leaves them out.
    """
    names = targets.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("k"), "target_share", "max_repeat")  # one row per source
    used = mixed.select("source", "copies", (F.col("tokens") * F.col("copies")).alias("used"), "membership")
    by = used.where("source is not null").groupBy("source").agg(F.sum("used").alias("labelled"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    soft = used.where("source is null").select("used", F.posexplode("membership").alias("k", "share")).groupBy("k").agg(F.sum(F.col("used") * F.col("share")).alias("soft"))
    joined = names.join(by, "source", "left").join(soft, "k", "left").na.fill(0)
    every = Window.partitionBy()  # over the rows of the sources
    return joined.select(
        "source",
        "target_share",
        ((F.col("labelled") + F.col("soft")) / F.sum(F.col("labelled") + F.col("soft")).over(every)).alias("reached_share"),
        (F.col("labelled") / F.sum("labelled").over(every)).alias("labelled_share"),
        (F.col("labelled") + F.col("soft")).alias("tokens"),
        "documents",
        "most_copies",
        "max_repeat",
    )
