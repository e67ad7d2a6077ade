"""Answers and reviews by a language model: asked, checked, asked again, mended.

Every round is a table: replies are checked by column expressions, accepted rows are
kept, and only the others are asked again.  Failures are columns, not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.functions import text as X
from rillgraph.operators import evidence, models
from rillgraph.sources.scratch import written


def retried(rows: DataFrame, prompt: str, factory: Callable[[], models.LanguageModel], verdict: Callable[[Column], Column], system: str = "", attempts: int = 3) -> DataFrame:
    """The rows with ``reply``, ``verdict``, ``attempts`` and ``error``; a row is asked again until its verdict is ``ok``, ``attempts`` times at most."""
    names = rows.columns
    pending, out = rows, None
    for n in range(1, attempts + 1):
        asked = models.replies(pending.select(*names), prompt, factory, system=system, attempts=1)
        found = F.when(F.col("reply").isNull(), "no reply").otherwise(X.let(X.clean_reply("reply"), verdict))
        checked = asked.select(*names, X.clean_reply("reply").alias("reply"), found.alias("verdict"), F.lit(n).alias("attempts"), "error")
        checked = written(checked, "replies")
        done = checked.where("verdict = 'ok'") if n < attempts else checked
        out = done if out is None else out.unionByName(done)
        pending = checked.where("verdict <> 'ok'")
        if n < attempts and pending.isEmpty():
            break
    return out


def answers(rows: DataFrame, factory: Callable[[], models.LanguageModel], system: str = "", attempts: int = 3) -> DataFrame:
    """(qid, prediction, origin, attempts, error) of rows (qid, question, hits).

    ``origin`` tells where an answer comes from: a valid ``reply``, a reply that was
    ``repaired``, the ``evidence`` alone; without a valid one it and the prediction are null
    and ``error`` has the reason.
    """
    texts = F.transform(F.coalesce("hits", F.expr("array()")), lambda h: h["text"])
    asked = rows.select("qid", F.coalesce("question", F.lit("")).alias("question"), texts.alias("texts"), evidence.prompt_for(F.coalesce("question", F.lit("")), F.col("hits")).alias("prompt"))
    found = retried(asked, "prompt", factory, lambda reply: evidence.validity(reply, F.col("texts")), system, attempts)
    # only what isn't valid as it is needs mending
    mend = lambda answer: F.when(F.col("verdict") != "ok", evidence.repaired(answer, F.col("question"), F.col("texts")))
    found = found.withColumn("mended", mend(F.coalesce("reply", F.lit("")))).withColumn("bare", mend(F.lit("")))
    valid = lambda c: evidence.validity(F.col(c), F.col("texts")) == "ok"
    origin = F.when(F.col("verdict") == "ok", "reply").when(F.col("reply").isNotNull() & (F.col("reply") != "") & valid("mended"), "repaired").when(valid("bare"), "evidence")
    prediction = F.when(origin == "reply", F.col("reply")).when(origin == "repaired", F.col("mended")).when(origin == "evidence", F.col("bare"))
    return found.select("qid", prediction.alias("prediction"), origin.alias("origin"), "attempts", F.when(origin.isNull(), F.coalesce("error", "verdict")).alias("error"))


def reviews(rows: DataFrame, factory: Callable[[], models.LanguageModel], system: str = "", attempts: int = 4, keywords: bool = True) -> DataFrame:
    """(qid, prediction, has_error, attempts, error) of rows (qid, scenario_context, review_sentence, hits); a reply without a verdict is asked for again."""
    asked = rows.select("qid", evidence.review_prompt(F.col("scenario_context"), F.col("review_sentence"), F.col("hits"), keywords).alias("prompt"))
    parsed = lambda reply: F.when(X.has_error(reply).isNotNull(), "ok").otherwise("no verdict")
    found = retried(asked, "prompt", factory, parsed, system, attempts)
    return found.select("qid", F.col("reply").alias("prediction"), X.has_error("reply").alias("has_error"), "attempts", F.when(F.col("verdict") != "ok", F.coalesce("error", "verdict")).alias("error"))
