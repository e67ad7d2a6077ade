"""Rankings: (qid, doc_id, score, rank), best first; ties go to the larger doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared to this many decimals, so that a difference in the last bit doesn't decide.
DECIMALS = 9


def top(scores: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The best ``k`` rows of each query, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.round("score", DECIMALS).desc(), F.col("doc_id").desc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_unmatched(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, and the documents of score 0 that can be among them: they rank by doc_id, so the ``k`` largest suffice."""
    best = top(scores.select("qid", "doc_id", "score"), k).drop("rank")
    last = [r.doc_id for r in docs.select("doc_id").orderBy(F.col("doc_id").desc()).limit(k).collect()]
    if not last:
        return best
    filled = queries.select("qid", F.explode(F.array(*(F.lit(i) for i in last))).alias("doc_id"), F.lit(0.0).alias("score"))
    return best.unionByName(filled).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


def in_order(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of questions that nothing can be ranked by: the ``k`` smallest ids in their order, score 0."""
    first = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(k).collect()]
    listed = F.array(*(F.lit(i).cast("bigint") for i in first)) if first else F.array().cast("array<bigint>")
    rows = queries.select("qid", F.posexplode(listed).alias("pos", "doc_id"))
    return rows.select("qid", "doc_id", F.lit(0.0).alias("score"), (F.col("pos") + 1).alias("rank"))


def as_lists(ranking: DataFrame, by: str = "qid") -> DataFrame:
    """One row per query with ``topk``, its doc_ids in order; lists are as short as the ranking was cut."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return ranking.groupBy(by).agg(F.transform(ordered, lambda x: x["doc_id"]).alias("topk"))
