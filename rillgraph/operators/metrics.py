"""Retrieval, generation and revision metrics as column expressions, and their averages.

Empty sides follow fixed rules: overlaps with an empty side are 0, two equal empty
answers match exactly, averages leave out nulls and are 0 over nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.functions import text as X


def _log2(i: Column) -> Column:
    return F.log2(i.cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def hits(ranked: Column, gold: Column, k: int) -> Column:
    """1 or 0 for each of the first ``k`` of a ranking."""
    return F.transform(F.slice(ranked, 1, k), lambda d: F.when(F.array_contains(gold, d), 1.0).otherwise(0.0))


def retrieval_metrics(ranked: str, gold: str, k: int, distinct: bool = False) -> dict[str, Column]:
    """MRR, Hit, Recall, Precision, nDCG and MAP at ``k``; ``distinct`` counts a document once after the cut."""
    r, g = F.coalesce(F.col(ranked), F.array().cast("array<bigint>")), F.array_distinct(F.coalesce(F.col(gold), F.array().cast("array<bigint>")))
    r = F.array_distinct(F.slice(r, 1, k)) if distinct else r
    h = hits(r, g, k)
    n = F.size(g)
    first = F.array_position(h, 1.0)
    gains = _sum(F.transform(h, lambda x, i: x / _log2(i + 2)))
    ideal = _sum(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(k)) - 1), lambda i: F.lit(1.0) / _log2(i + 2)))
    precise = _sum(F.transform(h, lambda x, i: x * _sum(F.slice(h, 1, i + 1)) / (i + 1)))
    some = n > 0
    return {
        f"mrr_{k}": F.when(first > 0, F.lit(1.0) / first).otherwise(0.0),
        f"hit_{k}": F.when(first > 0, 1.0).otherwise(0.0),
        f"recall_{k}": _sum(h) / F.greatest(n, F.lit(1)),
        f"precision_{k}": _sum(h) / k,
        f"ndcg_{k}": F.when(some, gains / F.when(some, ideal)).otherwise(0.0),
        f"map_{k}": F.when(some, precise / F.least(n, F.lit(k))).otherwise(0.0),
    }


def spec_accuracy(ranked_specs: str, gold_specs: str, k: int) -> Column:
    """Whether one of the first ``k`` documents is of a right specification."""
    return F.coalesce(F.arrays_overlap(F.slice(ranked_specs, 1, k), gold_specs), F.lit(False)).cast("double")


def retrieval_average(acc: Column, mrr: Column, ndcg: Column, coverage: Column | None = None) -> Column:
    """Mean of accuracy, MRR and nDCG; coverage takes the place of accuracy where it is given."""
    return ((acc if coverage is None else coverage) + mrr + ndcg) / 3


def generation_average(*components: Column) -> Column:
    """Mean of the measures of an answer; null where any of them is."""
    return sum(components[1:], components[0]) / len(components)


def retrieval_record(ranked: str, gold: str, k: int) -> dict[str, Column]:
    """The record of a question at ``k``: whether anything was found, the share found, precision, MRR, nDCG, MAP and their average."""
    m = retrieval_metrics(ranked, gold, k)
    found = {f"acc_{k}": m[f"hit_{k}"], f"coverage_{k}": m[f"recall_{k}"]} | {n: m[n] for n in (f"precision_{k}", f"mrr_{k}", f"ndcg_{k}", f"map_{k}")}
    return found | {f"ret_avg_{k}": retrieval_average(m[f"hit_{k}"], m[f"mrr_{k}"], m[f"ndcg_{k}"])}


def coverage_metrics(ranked: str, gold: str, k: int) -> dict[str, Column]:
    """Accuracy, coverage, MRR and nDCG of the first ``k``, of which each document counts once."""
    m = retrieval_metrics(ranked, gold, k, distinct=True)
    return {f"acc_{k}": m[f"hit_{k}"], f"coverage_{k}": m[f"recall_{k}"], f"mrr_{k}": m[f"mrr_{k}"], f"ndcg_{k}": m[f"ndcg_{k}"]}


def review_metrics(ranked: str, gold: str, ranked_specs: str, gold_specs: str, k: int) -> dict[str, Column]:
    """Accuracy, coverage, MRR and nDCG of the clauses found for a sentence, and whether one is of a right specification; gold counts once."""
    m = retrieval_metrics(ranked, gold, k)
    return {f"acc_{k}": m[f"hit_{k}"], f"coverage_{k}": m[f"recall_{k}"], f"spec_acc_{k}": spec_accuracy(ranked_specs, gold_specs, k), f"mrr_{k}": m[f"mrr_{k}"], f"ndcg_{k}": m[f"ndcg_{k}"]}


def answered(prediction: str, answer: str) -> Column:
    """Whether there is both a prediction and an answer to judge it by."""
    return (F.length(F.coalesce(prediction, F.lit(""))) > 0) & (F.length(F.coalesce(answer, F.lit(""))) > 0)


def generation_record(prediction: str, answer: str) -> dict[str, Column]:
    """The measures of a prediction; null where it or the answer is missing or empty."""
    chars_, tokens = char_prf(prediction, answer), token_prf(prediction, answer)
    found = {
        "gen_char_p": chars_["p"],
        "gen_char_r": chars_["r"],
        "gen_char_f1": chars_["f1"],
        "gen_token_p": tokens["p"],
        "gen_token_r": tokens["r"],
        "gen_token_f1": tokens["f1"],
        "gen_exact_match": exact_match(prediction, answer),
        "gen_rouge_l": rouge_l(prediction, answer),
        "gen_bleu1": bleu1(prediction, answer),
    }
    found["gen_avg"] = generation_average(*(found[n] for n in ("gen_char_f1", "gen_token_f1", "gen_rouge_l", "gen_bleu1")))
    return {n: F.when(answered(prediction, answer), c) for n, c in found.items()}


def chars(value: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def words(value: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(value, " "), lambda w: w != "")


def overlap(a: Column, b: Column) -> Column:
    """How many items two lists share, counted as often as both have them."""

    def counted(items: Column) -> Column:
        # each item with the number of equal ones before it, so that equal items differ
        return X.let(F.array_sort(items), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(s, x)).alias("n"))))

    return F.size(F.array_intersect(counted(a), counted(b)))


def prf(a: Column, b: Column) -> dict[str, Column]:
    """Precision, recall and F1 of the list ``a`` against ``b``; the lists and their overlap are worked out once."""

    def measured(s: Column) -> Column:
        n, m = F.size(s["a"]), F.size(s["b"])
        some = (n > 0) & (m > 0)
        part = lambda x, of: F.when(some, x / of).otherwise(0.0)
        return X.let(F.when(some, overlap(s["a"], s["b"])).otherwise(0), lambda both: F.struct(part(both, n).alias("p"), part(both, m).alias("r"), part(2 * both, n + m).alias("f1")))

    found = X.let(F.struct(a.alias("a"), b.alias("b")), measured)
    return {k: found[k] for k in ("p", "r", "f1")}


def char_prf(prediction: str, reference: str) -> dict[str, Column]:
    """Over the letters, digits and Han characters of two texts."""
    return prf(chars(X.normalized_chars(prediction)), chars(X.normalized_chars(reference)))


def token_prf(prediction: str, reference: str) -> dict[str, Column]:
    """Over the words of two normalised answers."""
    return prf(words(X.official_normalize(prediction)), words(X.official_normalize(reference)))


def exact_match(prediction: str, reference: str) -> Column:
    """Whether two answers are equal once normalised."""
    return (X.normalize_answer(prediction) == X.normalize_answer(reference)).cast("double")


def bleu1(prediction: str, reference: str) -> Column:
    """Share of the prediction's words that the reference has, with a penalty for brevity."""
    a, b = words(X.official_normalize(prediction)), words(X.official_normalize(reference))
    brevity = F.when(F.size(a) > F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.greatest(F.size(a), F.lit(1))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), brevity * overlap(a, b) / F.size(a)).otherwise(0.0)


def rouge_l(prediction: str, reference: str) -> Column:
    """F1 of the longest common subsequence of words: one row of its table per word, folded."""
    a, b = words(X.official_normalize(prediction)), words(X.official_normalize(reference))
    zero = F.transform(b, lambda _: F.lit(0))
    empty = F.array(F.lit(0))

    def step(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(b.alias("w"), row.alias("above"), F.slice(F.concat(empty, row), F.lit(1), F.size(row)).alias("corner")),
            empty,
            lambda out, z: F.concat(out, F.array(F.when(z["w"] == x, F.coalesce(z["corner"], F.lit(0)) + 1).otherwise(F.greatest(F.element_at(out, -1), z["above"])))),
            lambda out: F.slice(out, F.lit(2), F.size(b)),
        )

    last = F.aggregate(a, zero, step)
    n = F.coalesce(F.element_at(F.when(F.size(last) > 0, last), -1), F.lit(0))
    p, r = n / F.greatest(F.size(a), F.lit(1)), n / F.greatest(F.size(b), F.lit(1))
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)


def averages(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), scale: float = 100.0, extra: Sequence[Column] = ()) -> DataFrame:
    """Rows, and the mean of each metric times ``scale``, nulls left out, over all rows or by group; a null group is a group."""
    means = [F.coalesce(F.avg(m) * scale, F.lit(0.0)).alias(m) for m in metrics]
    return rows.groupBy(*by).agg(F.count("*").alias("num_queries"), *extra, *means)


def summary(rows: DataFrame, by: Sequence[str] = (), names: dict[str, str] | None = None, scale: float = 100.0) -> DataFrame:
    """:func:`averages` of every column of numbers or truth values, under other names where these are given."""
    kinds = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}
    numeric = [c for c, kind in rows.dtypes if kind in kinds and c not in by]
    found = averages(rows.select(*by, *(F.col(c).cast("double").alias(c) for c in numeric)), numeric, by, scale)
    return found.withColumnsRenamed(names or {})
