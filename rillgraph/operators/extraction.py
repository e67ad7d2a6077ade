"""Entities and relations by a language model, kept in caches that grow by what they lack.

A run works only on keys that the cache hasn't got, and appends its rows; a run that is
broken off leaves what it has appended.  A reply that can't be used isn't an error: the
row has the text's own terms, ``llm_ok`` is false and ``error`` says why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.functions import json_repair
from rillgraph.functions import text as X
from rillgraph.operators import graph, models
from rillgraph.sources.readers import not_cached
from rillgraph.sources.scratch import exists

TEXT_CHARS, ENTITIES, RELATIONS, ASKED_ENTITIES, ASKED_RELATIONS = 3000, 24, 16, 16, 6
#: Our own wording; every function takes other prompts.
TEXT_PROMPT = "列出下文中的构件、材料、工序和指标，以及它们之间的关系。只返回 JSON：{\"entities\": [\"…\"], \"relations\": [[\"…\", \"…\"]]}\n\n"
ENTITY_PROMPT = "下面的问题涉及哪些构件、材料、工序和指标？每行写一个名称。\n\n"
RELATION_PROMPT = "下面的问题问的是哪些事物之间的关系？每行写一对，中间用 | 隔开。\n\n"


def _todo(rows: DataFrame, path: str, key: str) -> DataFrame:
    spark = rows.sparkSession
    cache = spark.read.parquet(path) if exists(spark, path) else rows.limit(0)
    return not_cached(rows, cache.select(key), key)


def extract_texts(rows: DataFrame, factory: Callable[[], models.LanguageModel], prompt: str = TEXT_PROMPT, attempts: int = 3) -> DataFrame:
    """(doc_key, entities, relations, llm_ok, error, loaded_at) of rows (doc_key, text)."""
    asked = rows.select("doc_key", "text", F.concat(F.lit(prompt), F.substring("text", 1, TEXT_CHARS)).alias("prompt"))
    found = models.replies(asked, "prompt", factory, attempts=attempts)
    plain = json_repair.reply_graph(json_repair.reply_object("reply"), ENTITIES, RELATIONS)
    found = found.select("doc_key", "text", "error", plain.alias("g")).withColumn("ok", F.size("g.entities") > 0)
    entities = F.when(F.col("ok"), F.col("g.entities")).otherwise(X.extract_terms("text", ENTITIES))
    error = F.when(~F.col("ok"), F.coalesce("error", F.lit("no entities")))
    return found.select("doc_key", entities.alias("entities"), F.col("g.relations").alias("relations"), F.col("ok").alias("llm_ok"), error.alias("error"), F.current_timestamp().alias("loaded_at"))


def extend_text_cache(corpus: DataFrame, path: str, factory: Callable[[], models.LanguageModel], prompt: str = TEXT_PROMPT, attempts: int = 3) -> DataFrame:
    """The cache of a corpus's extractions after the texts that it lacked were added."""
    extract_texts(_todo(graph.keyed(corpus), path, "doc_key"), factory, prompt, attempts).write.mode("append").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def extract_questions(rows: DataFrame, factory: Callable[[], models.LanguageModel], prompts: tuple[str, str] = (ENTITY_PROMPT, RELATION_PROMPT), attempts: int = 3) -> DataFrame:
    """(question, entities, relations, llm_ok, error) of distinct questions: one call for the entities, one for the relations."""
    asked = rows.select("question", F.concat(F.lit(prompts[0]), "question").alias("prompt"))
    found = models.replies(asked, "prompt", factory, attempts=attempts).select("question", F.slice(json_repair.reply_lines(F.col("reply")), 1, ASKED_ENTITIES).alias("entities"), F.col("error").alias("first"))
    found = models.replies(found.withColumn("prompt", F.concat(F.lit(prompts[1]), "question")), "prompt", factory, attempts=attempts)
    pairs = F.slice(json_repair.reply_pairs(F.col("reply")), 1, ASKED_RELATIONS)
    ok = F.size("entities") > 0
    terms = F.when(ok, F.col("entities")).otherwise(X.extract_terms("question", ASKED_ENTITIES))
    return found.select("question", terms.alias("entities"), pairs.alias("relations"), ok.alias("llm_ok"), F.when(~ok, F.coalesce("first", F.lit("no entities"))).alias("error"))


def extend_question_cache(questions: DataFrame, path: str, factory: Callable[[], models.LanguageModel], prompts: tuple[str, str] = (ENTITY_PROMPT, RELATION_PROMPT), attempts: int = 3) -> DataFrame:
    """The cache of questions after those that it lacked were added; empty questions aren't asked about."""
    rows = questions.where(F.length("question") > 0).select("question")
    extract_questions(_todo(rows, path, "question"), factory, prompts, attempts).write.mode("append").parquet(path)
    return questions.sparkSession.read.parquet(path)
