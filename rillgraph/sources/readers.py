"""Sources and sinks of corpora, questions, predictions and reports."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgraph.functions.text import normalize_space
from rillgraph.sources.scratch import exists, written

CORPUS = "doc_id bigint, text string, source string, title string"
QUERIES = "qid string, question string, answer string, gold array<bigint>, `group` string"
PASSAGE_FIELDS = ("context", "text", "passage", "content", "paragraph")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON document, or an array of rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON row per line; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or lines of plain text, JSON strings or objects with ``text``; ids follow the files' order where they're missing.

    Files named ``.json`` hold one array each, which one task reads.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "value")).withColumn("at", F.monotonically_increasing_id())
        lines = lines.select("value", "at", F.lit(True).alias("element"))
    else:
        lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id()).withColumn("element", F.lit(False))
    as_object = F.from_json("value", "doc_id bigint, text string")
    as_string = F.when(F.col("value").startswith('"') & ~F.col("element"), F.get_json_object(F.concat(F.lit('{"t":'), "value", F.lit("}")), "$.t"))
    rows = lines.select("at", as_object["doc_id"].alias("given"), F.coalesce(as_object["text"], as_string, "value").alias("text"))
    return numbered(rows, "at").select(F.coalesce("given", "doc_id").alias("doc_id"), "text")


def renamed(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Source columns under the names used here; ``fields`` gives the source column of a name, others stay."""
    return rows.withColumnsRenamed({source: name for name, source in fields.items() if source in rows.columns and source != name})


def numbered(rows: DataFrame, *order: Column | str, into: str = "doc_id") -> DataFrame:
    """Contiguous numbers from 0 in the order of some columns: sizes of sorted partitions, then places within them.

    The sorted rows are written with their partition, so that sizes and places are of
    the same rows.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    spread = written(spread, "numbered")
    sizes = {r._p: r.n for r in spread.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    place = F.col("_i") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    return spread.withColumn(into, F.get(F.array(*(F.lit(s).cast("bigint") for s in starts or [0])), F.col("_p")) + place).drop("_p", "_i")


def passage_text(passage: Column, fields: tuple[str, ...] = PASSAGE_FIELDS) -> Column:
    """The first field of a passage that isn't empty."""
    return F.coalesce(*(F.nullif(passage[f], F.lit("")) for f in fields), F.lit(""))


def flatten_passages(rows: DataFrame, passages: str, order: str, fields: tuple[str, ...] = PASSAGE_FIELDS) -> DataFrame:
    """(doc_id, text, title, source): non-empty trimmed passages of all rows, numbered in order.

    Passages are texts or structs with one of ``fields``, in an array or in arrays within it.
    """
    kind = rows.schema[passages].dataType.elementType
    flat = rows.select(F.col(order).alias("_row"), F.posexplode(passages).alias("_at", "_p"))
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
        flat = flat.select("_row", "_at", F.posexplode("_p").alias("_in", "_p"))
    else:
        flat = flat.withColumn("_in", F.lit(0))
    held = kind.names if isinstance(kind, T.StructType) else []
    text = passage_text(F.col("_p"), tuple(f for f in fields if f in held)) if held else F.col("_p")
    other = [(F.col("_p")[n] if n in held else F.lit(None)).cast("string").alias(n) for n in ("title", "source")]
    flat = flat.select("_row", "_at", "_in", F.trim(text).alias("text"), *other).where("text <> ''")
    return numbered(flat, "_row", "_at", "_in").select("doc_id", "text", "title", "source")


def nested_benchmark(rows: DataFrame, order: str, passages: str = "passages", fields: tuple[str, ...] = PASSAGE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Corpus and questions of rows (qid, question, answer, gold_texts, group) that bring their passages along.

    Gold texts become the smallest id of an equal passage; a question without any is given
    its row's first passage.  Empty questions are dropped.
    """
    corpus = flatten_passages(rows, passages, order, fields)
    kind = rows.schema[passages].dataType.elementType
    every = F.flatten(passages) if isinstance(kind, T.ArrayType) else F.col(passages)
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    plain = F.transform(every, lambda p: F.trim(passage_text(p, tuple(f for f in fields if f in kind.names)) if isinstance(kind, T.StructType) else p))
    first = F.get(F.filter(plain, lambda t: t != ""), F.lit(0))
    asked = rows.where(F.length("question") > 0).withColumn("_first", first)
    found = resolve_gold(asked, corpus)
    instead = resolve_gold(asked.select("qid", F.when(F.col("_first").isNotNull(), F.array("_first")).alias("gold_texts")), corpus).withColumnRenamed("gold", "_instead")
    out = asked.select("qid", "question", "answer", "group").join(found, "qid").join(instead, "qid")
    return corpus, out.select("qid", "question", "answer", F.when(F.size("gold") > 0, F.col("gold")).otherwise(F.col("_instead")).alias("gold"), "group")


def local_benchmark(spark: SparkSession, corpus: str, queries: str, fields: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Corpus and questions from two files of JSON lines; empty questions are dropped, a missing file is an error that names it."""
    for path in (corpus, queries):
        if not exists(spark, path):
            raise FileNotFoundError(f"{path}: prepare the benchmark first")
    if fields:
        read = lambda path, schema: renamed(spark.read.option("mode", "FAILFAST").json(path), fields)
        rows, asked = (_shaped(read(p, s), s) for p, s in ((corpus, CORPUS), (queries, QUERIES)))
    else:
        rows, asked = read_json_lines(spark, corpus, CORPUS), read_json_lines(spark, queries, QUERIES)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    docs = numbered(rows.withColumnRenamed("doc_id", "given"), "_at").select(F.coalesce("given", "doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source", "title")
    return docs, asked.where(F.length("question") > 0)


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, null where a table hasn't got them."""
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields))


def write_prepared(folder: str, corpus: DataFrame, queries: DataFrame, **facts: str) -> None:
    """Corpus, questions and a manifest with their sizes, the version of the data and further facts."""
    write_rows(corpus, f"{folder}/corpus")
    write_rows(queries, f"{folder}/queries")
    spark = corpus.sparkSession
    corpus, queries = read_prepared(spark, folder)
    sizes = corpus.agg(F.count("*").alias("documents")).join(queries.agg(F.count("*").alias("questions")))
    version = fingerprint(corpus, "doc_id", "text").join(fingerprint(queries, "qid", "question").withColumnRenamed("version", "questions_version"))
    write_report(sizes.join(version).select("*", *(F.lit(v).alias(k) for k, v in facts.items())), f"{folder}/manifest")


def read_prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_prepared` has written."""
    for part in ("corpus", "queries"):
        if not exists(spark, f"{folder}/{part}"):
            raise FileNotFoundError(f"{folder}/{part}: prepare the benchmark first")
    return spark.read.parquet(f"{folder}/corpus"), spark.read.parquet(f"{folder}/queries")


def write_rows(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Rows as files that appear only when all are complete."""
    df.write.mode(mode).format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def fingerprint(df: DataFrame, order: str, text: str) -> DataFrame:
    """One row: a SHA-1 over the SHA-1s of all texts and their keys, merged in a tree by the first digits of the hashes.

    Every node below the leaves has at most 4,096 children, and a leaf takes one in 7e10
    of all rows, so that no task holds many hashes.
    """
    found = df.select(F.col(order).cast("string").alias("k"), F.sha1(F.coalesce(F.col(text), F.lit(""))).alias("h")).select(F.sha1(F.concat_ws(":", "k", "h")).alias("h"))
    found = found.withColumn("at", F.col("h"))
    for digits in (9, 6, 3, 0):
        found = found.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("h"))
    return found.select(F.col("h").alias("version"))


def code_version(folder: str | None = None) -> str:
    """A SHA-1 over the source files of a folder and their names, by default of this package."""
    root = Path(folder) if folder else Path(__file__).parents[1]
    digest = hashlib.sha1()
    for path in sorted(root.rglob("*.py")):
        digest.update(f"{path.relative_to(root).as_posix()}:{hashlib.sha1(path.read_bytes()).hexdigest()}\n".encode())
    return digest.hexdigest()


def resolve_gold(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, gold): gold texts as the smallest id of an equal text, in order, once each; unknown ones are dropped."""
    ids = corpus.select(normalize_space("text").alias("key"), "doc_id").where("key <> ''").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    asked = queries.select("qid", F.posexplode_outer("gold_texts").alias("pos", "t")).withColumn("key", normalize_space("t"))
    found = asked.join(ids, "key", "left").groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("pos", "doc_id"))))
    return found.groupBy("qid").agg(F.transform(ordered, lambda x: x["doc_id"]).alias("gold"))


def valid_gold(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, gold): the gold ids that exist, once each, in their order."""
    asked = queries.select("qid", F.posexplode_outer("gold").alias("pos", "doc_id"))
    known = asked.join(corpus.select("doc_id").distinct().withColumn("there", F.lit(True)), "doc_id", "left")
    firsts = known.groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"), F.max("there").alias("there"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", "doc_id"))))
    return firsts.groupBy("qid").agg(F.transform(ordered, lambda x: x["doc_id"]).alias("gold"))


def sample(queries: DataFrame, size: int | None, seed: int, by: str = "qid") -> DataFrame:
    """``size`` rows chosen by a seeded hash of their key, the same at each run; all if there are no more.

    The first digits of the hashes are counted, at most 65,536 of them, to find where the
    last row lies; only rows that share its digits are sorted.
    """
    if size is None:
        return queries
    hashed = queries.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(by).cast("string"), F.lit(""))))).withColumn("_d", F.substring("_h", 1, 4))
    left, last = size, None
    for r in sorted(hashed.groupBy("_d").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_d"]):
        if r.n > left:
            last = r["_d"]
            break
        left -= r.n
    if last is None:
        return queries
    sooner = hashed.where(F.col("_d") < last)
    return sooner.unionByName(hashed.where(F.col("_d") == last).orderBy("_h", by).limit(left)).drop("_h", "_d")


def not_cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows whose key the cache doesn't hold yet, one per key."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(cache.select(key), key, "left_anti")
