"""prepare, infer and evaluate as three plans with tables between them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.operators import answers, bm25, dense, evidence, graph, metrics, models, ranking, semantic, subgraph
from rillgraph.sources import readers
from rillgraph.sources.scratch import drop, written

# Tuned and frozen parameters of the subgraph methods.
PRESETS = {"tuned": {"n": 3, "alpha": 0.03, "gamma": 0.7, "weight": 0.85}, "frozen": {"n": 2, "alpha": 0.03, "gamma": 0.7, "weight": 1.0}}


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    ks: tuple[int, ...] = (5, 10)
    sample_size: int | None = None
    seed: int = 20260101
    methods: tuple[str, ...] = ("bm25", "subgraph")
    group_by: tuple[str, ...] = ("hop_group",)
    preset: str = "tuned"
    #: makes the encoder of the dense and the semantic method, in the tasks
    encoder: Callable[[], models.Encoder] = models.HashEncoder
    #: makes the language model that answers; none asks for no answers
    model: Callable[[], models.LanguageModel] | None = None
    #: similarities that the semantic method takes for none
    least: float = -1.0


def configured(settings: dict) -> Config:
    """A configuration from nested settings, with the defaults of :class:`Config` for what they leave out."""
    retrieval, evaluation, sampling = (settings.get(k) or {} for k in ("retrieval", "evaluation", "sample"))
    found = {
        "top_k": retrieval.get("top_k"),
        "methods": retrieval.get("methods") and tuple(retrieval["methods"]),
        "preset": retrieval.get("preset"),
        "least": retrieval.get("least"),
        "ks": evaluation.get("k") and tuple(evaluation["k"]),
        "group_by": evaluation.get("group_by") and tuple(evaluation["group_by"]),
        "sample_size": sampling.get("size"),
        "seed": sampling.get("seed"),
    }
    config = Config(**{k: v for k, v in found.items() if v is not None})
    # measures at k need as many results
    return replace(config, top_k=max(config.top_k, *config.ks))


def load_config(path: str) -> Config:
    """:func:`configured` from a JSON file, or a YAML file where its parser is installed."""
    with open(path, encoding="utf-8") as lines:
        if path.endswith(".json"):
            return configured(json.load(lines) or {})
        try:
            import yaml
        except ImportError as e:
            raise ImportError(f"{path}: reading YAML needs PyYAML; give the settings as JSON") from e
        return configured(yaml.safe_load(lines) or {})


def questions(raw: DataFrame) -> DataFrame:
    """One row per qid with a question; repeated deliveries are dropped, group names lower-cased."""
    kept = raw.where(F.length("question") > 0).groupBy("qid").agg(F.max(F.struct("question", "answer", "gold", "hop_group")).alias("q"))
    return kept.select("qid", "q.question", "q.answer", "q.gold", F.lower("q.hop_group").alias("hop_group"))


def prepare(corpus: DataFrame, raw_queries: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """The corpus and the chosen questions with gold ids that exist."""
    chosen = readers.sample(questions(raw_queries), config.sample_size, config.seed)
    return corpus, chosen.drop("gold").join(readers.valid_gold(chosen, corpus), "qid")


def _bm25(corpus: DataFrame, queries: DataFrame, extracted: DataFrame, cache: DataFrame | None, config: Config) -> DataFrame:
    return bm25.rank(corpus, queries, config.top_k)


def _dense(corpus: DataFrame, queries: DataFrame, extracted: DataFrame, cache: DataFrame | None, config: Config) -> DataFrame:
    def vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
        found = models.encoded(rows, text, config.encoder).withColumnRenamed("text", "_text")
        return rows.select(key, F.col(text).alias("_text")).join(found, "_text").select(key, "embedding")

    return dense.rank(vectors(corpus, "doc_id", "text"), vectors(queries, "qid", "question"), config.top_k)


def indexed(corpus: DataFrame, extracted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The document graph with numbers for names, and the vocabulary; the names of documents aren't kept."""
    named = graph.document_graph(corpus, graph_source(corpus, extracted))
    found = graph.indexed(named)
    drop(named)
    return found


def _graph(corpus: DataFrame, extracted: DataFrame | None, gamma: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, words = indexed(corpus, extracted)
    return docs, words, graph.expansion(docs, words, None, gamma, listed=True)


def graph_source(corpus: DataFrame, extracted: DataFrame | None) -> DataFrame:
    """The extraction that was given, or one made of the corpus by rules."""
    return graph.corpus_graph(corpus) if extracted is None else extracted


def _subgraph(corpus: DataFrame, queries: DataFrame, extracted: DataFrame | None, cache: DataFrame | None, config: Config) -> DataFrame:
    p = PRESETS[config.preset]
    return subgraph.rank(*_graph(corpus, extracted, p["gamma"]), queries, cache, config.top_k, p["n"], p["alpha"])


def _semantic(corpus: DataFrame, queries: DataFrame, extracted: DataFrame | None, cache: DataFrame | None, config: Config) -> DataFrame:
    p = PRESETS[config.preset]
    return semantic.rank(*_graph(corpus, extracted, p["gamma"]), queries, cache, config.encoder, config.top_k, p["n"], p["alpha"], p["weight"], least=config.least)


Method = Callable[[DataFrame, DataFrame, DataFrame | None, DataFrame | None, Config], DataFrame]
#: Retrieval methods by name; more can be added.
METHODS: dict[str, Method] = {"bm25": _bm25, "dense": _dense, "subgraph": _subgraph, "semantic": _semantic}


def rank(method: str, corpus: DataFrame, queries: DataFrame, extracted: DataFrame | None, cache: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """The ranking of one method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(METHODS)}")
    return METHODS[method](corpus, queries, extracted, cache, config)


def infer(corpus: DataFrame, queries: DataFrame, extracted: DataFrame | None, cache: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """One row per method and question: ``topk``, the evidence for its answer and, with a model, the answer and where it comes from."""
    out = None
    for method in config.methods:
        ranked = written(rank(method, corpus, queries, extracted, cache, config).select("qid", "doc_id", "score", "rank"), "ranking")
        row = queries.join(ranking.as_lists(ranked), "qid", "left").join(evidence.gathered(ranked, corpus, config.top_k), "qid", "left").withColumn("method", F.lit(method))
        if config.model:
            row = row.join(answers.answers(row.select("qid", "question", "hits"), config.model), "qid", "left")
        out = row if out is None else out.unionByName(row)
    return out


def evaluate(predictions: DataFrame, config: Config = Config()) -> DataFrame:
    """(method, group_field, group_value, num_queries, num_with_prediction, metrics): over all questions and by group.

    Measures of answers are there where predictions have them, and leave out questions
    without an answer or a prediction.
    """
    columns = {}
    for k in config.ks:
        columns |= metrics.retrieval_record("topk", "gold", k)
    spoken = "prediction" in predictions.columns
    if spoken:
        columns |= metrics.generation_record("prediction", "answer")
    said = (F.length(F.coalesce("prediction", F.lit(""))) > 0) if spoken else F.lit(False)
    rows = predictions.select("method", *config.group_by, said.cast("int").alias("_said"), *(c.alias(n) for n, c in columns.items()))
    rows, names, out = written(rows, "records"), list(columns), None  # not worked out again for each group
    for g in (None, *config.group_by):
        field, value = F.lit(g).cast("string"), F.coalesce(g, F.lit("None")) if g else F.lit(None).cast("string")
        part = metrics.averages(rows, names, ["method", g] if g else ["method"], extra=[F.sum("_said").alias("num_with_prediction")])
        part = part.select("method", field.alias("group_field"), value.alias("group_value"), "num_queries", "num_with_prediction", *names)
        out = part if out is None else out.unionByName(part)
    return out
