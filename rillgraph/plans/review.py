"""Scoring of reviews: what a reply changes against what should be changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.functions import text as X
from rillgraph.operators import metrics, revision


def score_rows(cases: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row of measures per case (qid, review_sentence, is_error, correct_sentence, gold_answer, prediction).

    A sentence without an error counts 1 for its edits if the reply says so and keeps
    it, else 0.
    """
    rows = cases.withColumn("predicted", X.replacement_sentence(prediction, "review_sentence")).withColumn("original", X.normalize_space("review_sentence"))
    kept = ~F.coalesce("is_error", F.lit(False)) & F.coalesce(~X.has_error(prediction), F.lit(False)) & (X.normalized_chars("predicted") == X.normalized_chars("review_sentence"))
    edits = F.when(~F.coalesce("is_error", F.lit(False)), kept.cast("double")).otherwise(revision.edit_payload_f1("original", "predicted", "correct_sentence"))
    sentence = {f"revision_char_{n}": c for n, c in metrics.char_prf("predicted", "correct_sentence").items()}
    answer = {f"answer_char_{n}": c for n, c in metrics.char_prf(prediction, "gold_answer").items()}
    return rows.select(
        "qid",
        "predicted",
        X.normalize_space("correct_sentence").alias("reference"),
        (F.col("predicted") != "").alias("parsed"),
        kept.alias("kept_as_it_is"),
        revision.edit_fragments("original", "predicted").alias("predicted_fragments"),
        revision.edit_fragments("original", "correct_sentence").alias("reference_fragments"),
        edits.alias("edit_f1"),
        X.revision_chunks("predicted").alias("predicted_chunks"),
        X.revision_chunks("correct_sentence").alias("reference_chunks"),
        *(c.alias(n) for n, c in (sentence | answer).items()),
    )
