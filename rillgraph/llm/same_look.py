"""Problem 1: visually identical text with different characters.

``consistent_form`` adds the consistent spelling of a column; ``lookalike_pairs``
finds the rows whose texts look the same but are stored differently.  The pairs
are joined on a 128-bit hash of the form, after rows whose form has only one
stored spelling have been taken out; the remaining groups are salted, so that one
large group is spread over many tasks.

Nulls give null forms and no pairs; blank texts have the form ``''``; repeated
rows of identical characters aren't pairs of each other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.llm import forms
from rillgraph.llm.keys import LONG_ENOUGH, look_keys
from rillgraph.sources.scratch import written

SALTS = 8


@F.pandas_udf(T.StringType())
def _form(texts: pd.Series) -> pd.Series:
    return pd.Series([forms.consistent(t) if isinstance(t, str) else None for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def _looks_same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([forms.consistent(x) == forms.consistent(y) for x, y in zip(a, b)])


def consistent_form(text: Column | str) -> Column:
    """The consistent form of a text column."""
    return _form(F.col(text) if isinstance(text, str) else text)


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG_ENOUGH) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: long-enough texts that look the same but aren't stored identically."""
    keys = written(look_keys(docs, id_col, text_col, least), "look-keys")
    mixed = keys.groupBy("f1", "f2").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("f1", "f2")
    rows = keys.join(mixed, ["f1", "f2"])
    a = rows.select("f1", "f2", F.col("r").alias("ra"), F.col("doc_id").alias("doc_id_a"), F.pmod("doc_id", F.lit(SALTS)).alias("salt"))
    b = rows.select("f1", "f2", F.col("r").alias("rb"), F.col("doc_id").alias("doc_id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return a.join(b, ["f1", "f2", "salt"]).where("doc_id_a < doc_id_b and ra <> rb").select("doc_id_a", "doc_id_b")


def lookalike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG_ENOUGH) -> DataFrame:
    """(doc_id, class_id, spellings) of the long-enough texts: the smallest doc_id that looks the same, and in how many spellings the class is stored."""
    keys = written(look_keys(docs, id_col, text_col, least), "look-keys")
    # spellings are made distinct before they are counted, so that a large class is spread by them
    spelt = keys.groupBy("f1", "f2", "r").agg(F.min("doc_id").alias("doc_id"))
    classes = spelt.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("spellings"))
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return keys.withColumn("salt", F.pmod("doc_id", F.lit(SALTS))).join(salted, ["f1", "f2", "salt"]).select("doc_id", "class_id", "spellings")


def lookalike_cases(cases: DataFrame, key: str = "qid", left: str = "review_sentence", right: str = "correct_sentence") -> DataFrame:
    """The distinct keys of rows whose two sentences look the same but aren't stored identically."""
    both = cases.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    return both.where(_looks_same(left, right)).select(key).distinct()


def found(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """p1_found: field, key_a, key_b."""
    texts = lookalike_pairs(docs).select(F.lit("text").alias("field"), F.col("doc_id_a").cast("string").alias("key_a"), F.col("doc_id_b").cast("string").alias("key_b"))
    sentences = lookalike_cases(cases).select(F.lit("sentence").alias("field"), F.col("qid").alias("key_a"), F.col("qid").alias("key_b"))
    return texts.unionByName(sentences)
