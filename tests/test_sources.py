import json
import time

import pytest
from pyspark.sql import functions as F

from rillgraph import cli
from rillgraph.sources import readers, scratch
from rillgraph.streaming.incremental import extend_cache


def test_corpus_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(["plain text", '"a string"', json.dumps({"text": "an object"}), "", json.dumps({"doc_id": 7, "text": "with id"})]))
    rows = {r.doc_id: r.text for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()}
    assert rows == {0: "plain text", 1: "a string", 2: "an object", 7: "with id"}


def test_numbering_and_passages(spark):
    df = spark.range(100).select((F.col("id") * 3 % 101).alias("k"))
    assert [(r.doc_id, r.k) for r in readers.numbered(df, "k").orderBy("k").collect()] == list(enumerate(sorted(i * 3 % 101 for i in range(100))))
    nested = spark.createDataFrame([(1, [" b ", ""]), (0, ["a", None])], "row int, passages array<string>")
    assert [(r.doc_id, r.text) for r in readers.flatten_passages(nested, "passages", "row").orderBy("doc_id").collect()] == [(0, "a"), (1, "b")]


def test_gold(spark):
    corpus = spark.createDataFrame([(0, "alpha"), (1, " beta "), (2, "alpha"), (3, None)], "doc_id bigint, text string")
    texts = spark.createDataFrame([("a", ["beta", "alpha", "beta"]), ("b", ["missing"]), ("c", None)], "qid string, gold_texts array<string>")
    assert {r.qid: r.gold for r in readers.resolve_gold(texts, corpus).collect()} == {"a": [1, 0], "b": [], "c": []}
    ids = spark.createDataFrame([("a", [1, 0, 1]), ("b", [9]), ("c", None)], "qid string, gold array<bigint>")
    assert {r.qid: r.gold for r in readers.valid_gold(ids, corpus).collect()} == {"a": [1, 0], "b": [], "c": []}


def test_sampling(spark):
    df = spark.createDataFrame([(f"q{i}",) for i in range(10)], "qid string")
    chosen = lambda n, seed: sorted(r.qid for r in readers.sample(df, n, seed).collect())
    assert chosen(4, 7) == chosen(4, 7) and len(chosen(4, 7)) == 4 and chosen(4, 7) != chosen(4, 8)
    assert len(chosen(None, 7)) == len(chosen(99, 7)) == 10


def test_fingerprint(spark):
    df = spark.createDataFrame([(0, "a"), (1, None)], "i int, t string")
    version = readers.fingerprint(df, "i", "t").first().version
    assert len(version) == 40 and version == readers.fingerprint(df.repartition(3), "i", "t").first().version
    assert version != readers.fingerprint(df.limit(1), "i", "t").first().version


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "c").write_text('{"text": "x"}\n\n{"doc_id": 5, "text": "y"}\n')
    (tmp_path / "q").write_text('{"qid": "a", "question": "x?", "gold": [0], "group": "g"}\n{"qid": "b", "question": ""}\n')
    docs, queries = readers.local_benchmark(spark, str(tmp_path / "c"), str(tmp_path / "q"))
    assert sorted(r.doc_id for r in docs.collect()) == [0, 5] and [r.qid for r in queries.collect()] == ["a"]


def test_arriving_documents(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    work = lambda df: df.select("key", F.lit("done").alias("state"))

    def run(keys, name):
        spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema("key string").parquet(f"{source}/*")
        extend_cache(stream, cache, "key", work, str(tmp_path / "checkpoint")).awaitTermination()

    run(["a", "b", "a"], "one")
    run(["b", "c"], "two")
    assert sorted(r.key for r in spark.read.parquet(cache).collect()) == ["a", "b", "c"]


def test_corpus_array_and_missing_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(["plain", {"text": "an object"}, {"doc_id": 9, "text": "with id"}, '"quoted"']))
    assert {r.doc_id: r.text for r in readers.read_corpus(spark, str(tmp_path / "c.json")).collect()} == {0: "plain", 1: "an object", 9: "with id", 3: '"quoted"'}
    for call in (lambda: readers.read_corpus(spark, str(tmp_path / "no")), lambda: readers.local_benchmark(spark, str(tmp_path / "no"), str(tmp_path / "c.json")), lambda: readers.read_prepared(spark, str(tmp_path / "no"))):
        with pytest.raises(FileNotFoundError):
            call()


def test_passages_of_structs_and_nested_ones(spark):
    df = spark.createDataFrame([(0, [[("", " a ", "T")], [("b", None, None)]]), (1, [])], "row int, p array<array<struct<context:string,text:string,title:string>>>")
    assert [(r.doc_id, r.text, r.title, r.source) for r in readers.flatten_passages(df, "p", "row").orderBy("doc_id").collect()] == [(0, "a", "T", None), (1, "b", None, None)]


def test_benchmark_of_rows_with_passages(spark):
    rows = [("a", "x?", "y", ["p1", "p2"], ["p2"], "g"), ("b", "z?", None, ["", " p3 "], ["unknown"], None), ("c", "", None, ["p4"], None, None), ("d", "w?", None, None, None, None)]
    df = spark.createDataFrame(rows, "qid string, question string, answer string, passages array<string>, gold_texts array<string>, `group` string")
    corpus, queries = readers.nested_benchmark(df, "qid")
    assert {r.doc_id: r.text for r in corpus.collect()} == {0: "p1", 1: "p2", 2: "p3", 3: "p4"}
    assert {r.qid: r.gold for r in queries.collect()} == {"a": [1], "b": [2], "d": []}


def test_renamed_fields(spark, tmp_path):
    assert readers.renamed(spark.createDataFrame([(1, 2)], "id int, body int"), {"doc_id": "id", "text": "body", "title": "none"}).columns == ["doc_id", "text"]
    (tmp_path / "c").write_text('{"id": 4, "body": "x"}\n')
    (tmp_path / "q").write_text('{"qid": "a", "ask": "x?", "gold": [4]}\n')
    docs, queries = readers.local_benchmark(spark, str(tmp_path / "c"), str(tmp_path / "q"), {"doc_id": "id", "text": "body", "question": "ask"})
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(4, "x")] and [(r.question, r.gold) for r in queries.collect()] == [("x?", [4])]


def test_samples_are_the_smallest_hashes(spark):
    import hashlib

    names = [f"q{i}" for i in range(3000)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "qid string")
    want = sorted(names, key=lambda n: hashlib.md5(f"5:{n or ''}".encode()).hexdigest())
    for size in (0, 1, 700, 3001, 4000):
        assert sorted(map(str, want[:size])) == sorted(str(r.qid) for r in readers.sample(df, size, 5).collect())


def test_numbers_of_equal_keys_and_of_nothing(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2)], "k string, i int")
    assert [(r.n, r.k, r.i) for r in readers.numbered(df, "k", F.col("i").desc(), into="n").orderBy("n").collect()] == [(0, "a", 2), (1, "a", 1), (2, "b", 1)]
    assert readers.numbered(df.limit(0), "k").count() == 0


def test_scratch_folder(spark, tmp_path):
    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "spark://host" if key == "spark.master" else default

    with pytest.raises(ValueError):
        scratch.shared_folder(Cluster)
    df = scratch.written(spark.range(5).withColumn("g", (F.col("id") % 2).cast("int")), "t", "g")
    assert df.where("g = 1").count() == 2 and scratch.exists(spark, df.inputFiles()[0])
    held = df.inputFiles()[0]
    assert scratch.clean(spark) > 0 and not scratch.exists(spark, held) and scratch.clean(spark) == 0


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = lambda: {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks())}
    kept = spark.range(1000).groupBy((F.col("id") % 10).alias("g")).count()
    before = {b for b in blocks() if b.startswith("shuffle")}
    df = scratch.written(kept, "counts")
    for _ in range(50):
        left = {b for b in blocks() if b.startswith("shuffle")} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and df.count() == kept.count() == 10 and spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_code_version(tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    before = readers.code_version(str(tmp_path))
    assert len(before) == len(readers.code_version()) == 40 and before == readers.code_version(str(tmp_path))
    (tmp_path / "a.py").rename(tmp_path / "b.py")
    assert readers.code_version(str(tmp_path)) != before


def test_command_line(spark, tmp_path):
    (tmp_path / "c").write_text("".join(json.dumps({"text": t}) + "\n" for t in ("Concrete is cured for days.", "Rebar follows drawings.")))
    (tmp_path / "q").write_text('{"qid": "a", "question": "concrete days", "gold": [0], "group": "g"}\n{"qid": "b", "question": "rebar", "gold": [1]}\n')
    cli.run(spark, ["prepare", str(tmp_path / "c"), str(tmp_path / "q"), str(tmp_path / "out"), "--limit", "1"])
    cli.run(spark, ["infer", str(tmp_path / "out"), "--methods", "bm25", "subgraph", "--top-k", "2"])
    cli.run(spark, ["evaluate", str(tmp_path / "out")])
    report = spark.read.json(str(tmp_path / "out/report")).collect()
    assert {(r.method, r.acc_5) for r in report} == {("bm25", 100), ("subgraph", 100)} and {r.num_queries for r in report} == {1}
    manifest = spark.read.json(str(tmp_path / "out/manifest")).first()
    assert manifest.documents == 2 and manifest.questions == 1 and len(manifest.version) == 40
