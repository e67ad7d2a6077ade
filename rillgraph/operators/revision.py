"""Edit fragments between two versions of a sentence, and the measures built on them.

Sequence matching isn't relational: one Arrow function per batch aligns the pairs of
a row.  Null texts count as empty.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETED = "删"  # leads the text that an edit takes out


def fragments(old: str, new: str) -> list[str]:
    """What each edit from ``old`` to ``new`` puts in, or what it takes out behind a mark."""
    out = []
    for kind, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if kind != "equal":
            out.append(new[c:d] if d > c else DELETED + old[a:b])
    return out


def payload_f1(old: str, predicted: str, reference: str) -> float:
    """F1 over the characters of the edits: 1 if neither version changes anything, 0 if only one does."""
    p, r = (Counter("".join(fragments(old, x))) for x in (predicted, reference))
    if not p or not r:
        return float(not p and not r)
    both = sum((p & r).values())
    return 2 * both / (sum(p.values()) + sum(r.values()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fragments(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([fragments(a or "", b or "") for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(T.DoubleType())
def _payload(old: pd.Series, predicted: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([payload_f1(a or "", b or "", c or "") for a, b, c in zip(old, predicted, reference)], dtype=float)


def edit_fragments(old: str, new: str) -> Column:
    """The fragments of each edit."""
    return _fragments(old, new)


def edit_payload_f1(old: str, predicted: str, reference: str) -> Column:
    """F1 over the characters of the edits."""
    return _payload(old, predicted, reference)


def embedding_prf(predicted: Column, reference: Column) -> dict[str, Column]:
    """Precision and recall of two lists of unit vectors: mean of each vector's best clipped cosine on the other side."""
    from rillgraph.operators.dense import inner

    def side(a: Column, b: Column) -> Column:
        best = F.transform(a, lambda x: F.greatest(F.array_max(F.transform(b, lambda y: inner(x, y))), F.lit(0.0)))
        return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    both = (F.size(predicted) > 0) & (F.size(reference) > 0)
    neither = (F.size(predicted) == 0) & (F.size(reference) == 0)
    p = F.when(both, side(predicted, reference)).when(neither, 1.0).otherwise(0.0)
    r = F.when(both, side(reference, predicted)).when(neither, 1.0).otherwise(0.0)
    return {"p": p, "r": r, "f1": F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)}


def delta_embedding_prf(old: Column, predicted: Column, reference: Column, kept: Column | None = None, keep: Column | None = None) -> dict[str, Column]:
    """Precision, recall and F1 of an edit as a vector: the clipped cosine of both edits, less where the prediction's or the reference's is the longer one.

    ``kept`` and ``keep`` tell whether the prediction changes nothing and whether nothing
    should be changed, by default as the vectors have it: 1 if both, 0 if one does.
    """
    from rillgraph.operators.dense import inner, norm

    p, r = (F.zip_with(x, old, lambda a, b: a.cast("double") - b) for x in (predicted, reference))
    long_p, long_r = norm(p), norm(r)
    still_p, still_r = long_p < 1e-8, long_r < 1e-8
    kept, keep = still_p if kept is None else kept, still_r if keep is None else keep
    alike = F.when(still_p | still_r, 0.0).otherwise(F.least(F.greatest(inner(p, r) / (long_p * long_r), F.lit(0.0)), F.lit(1.0)))

    def side(own: Column, other: Column) -> Column:
        return F.when(kept & keep, 1.0).when(kept | keep, 0.0).otherwise(alike * F.least(F.lit(1.0), F.coalesce(F.try_divide(other, own), F.lit(0.0))))

    precision, recall = side(long_p, long_r), side(long_r, long_p)
    return {"p": precision, "r": recall, "f1": F.when(precision + recall > 0, 2 * precision * recall / F.when(precision + recall > 0, precision + recall)).otherwise(0.0)}


def delta_embedding_score(old: Column, predicted: Column, reference: Column) -> Column:
    """Clipped cosine of two edits as vectors, times how alike their lengths are; 1 if neither changes anything, 0 if one does."""
    from rillgraph.operators.dense import inner, norm

    p, r = (F.zip_with(x, old, lambda a, b: a.cast("double") - b) for x in (predicted, reference))
    np_, nr = norm(p), norm(r)
    still_p, still_r = np_ < 1e-8, nr < 1e-8
    cosine = F.least(F.greatest(inner(p, r) / (np_ * nr), F.lit(0.0)), F.lit(1.0))
    return F.when(still_p & still_r, 1.0).when(still_p | still_r, 0.0).otherwise(cosine * F.least(np_, nr) / F.greatest(np_, nr))
