import math
import time

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import dense, evidence, metrics, revision


def judged(spark, ranked, gold, k, **more):
    df = spark.createDataFrame([(ranked, gold)], "r array<bigint>, g array<bigint>")
    return df.select(*(c.alias(n) for n, c in metrics.retrieval_metrics("r", "g", k, **more).items())).first().asDict()


def test_retrieval_metrics(spark):
    m = judged(spark, [1, 0, 2, 3], [2], 5)
    assert m["mrr_5"] == pytest.approx(1 / 3) and m["hit_5"] == 1 and m["recall_5"] == 1
    assert m["precision_5"] == pytest.approx(0.2) and m["ndcg_5"] == pytest.approx(0.5) and m["map_5"] == pytest.approx(1 / 3)
    m = judged(spark, [1, 2, 2, 5], [2, 5], 4, distinct=True)
    assert m["hit_4"] == 1 and m["recall_4"] == 1 and m["mrr_4"] == 0.5
    assert set(judged(spark, [], [], 5).values()) == {0.0} and set(judged(spark, None, None, 5).values()) == {0.0}


def pair(spark, f, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    found = f("a", "b")
    return tuple(df.select(*found.values()).first()) if isinstance(found, dict) else df.select(found).first()[0]


def test_overlaps(spark):
    assert pair(spark, metrics.char_prf, "混凝土", "混凝土强度") == pytest.approx((1, 0.6, 0.75))
    assert pair(spark, metrics.token_prf, "The concrete strength", "concrete strength") == pytest.approx((1, 1, 1))
    assert pair(spark, metrics.char_prf, None, "x") == (0, 0, 0)
    assert pair(spark, metrics.exact_match, "甲 ", "甲") == 1 and pair(spark, metrics.exact_match, "", None) == 1
    assert pair(spark, metrics.rouge_l, "x B C", "x B D") == pytest.approx(2 / 3)
    assert pair(spark, metrics.rouge_l, "", "x") == 0
    assert pair(spark, metrics.bleu1, "x B C", "x B D") == pytest.approx(2 / 3)
    assert pair(spark, metrics.bleu1, "x", "x y") == pytest.approx(math.exp(-1))


def test_rouge_against_plain_table(spark):
    import random

    rng = random.Random(1)
    rows = [(" ".join(rng.choices("xyz", k=rng.randrange(0, 6))), " ".join(rng.choices("xyz", k=rng.randrange(0, 6)))) for _ in range(60)]

    def plain(a, b):
        a, b = a.split(), b.split()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        n = t[-1][-1]
        return 2 * n / (len(a) + len(b)) if n else 0.0

    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", metrics.rouge_l("a", "b").alias("f")).collect():
        assert r.f == pytest.approx(plain(r.a, r.b))


def test_revisions(spark):
    assert revision.fragments("甲乙丙", "甲乙丁") == ["丁"] and revision.fragments("甲乙", "甲") == [revision.DELETED + "乙"]
    assert revision.payload_f1("甲乙丙", "甲乙丁", "甲乙丁") == 1 and revision.payload_f1("甲", "甲", "甲") == 1 and revision.payload_f1("甲", "甲", "乙") == 0
    df = spark.createDataFrame([([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]], [])], "a array<array<float>>, b array<array<float>>, n array<array<float>>")
    assert tuple(df.select(*revision.embedding_prf(F.col("a"), F.col("b")).values()).first()) == pytest.approx((1, 0.5, 2 / 3))
    assert tuple(df.select(*revision.embedding_prf(F.col("n"), F.col("n")).values()).first()) == (1, 1, 1)
    assert tuple(df.select(*revision.embedding_prf(F.col("a"), F.col("n")).values()).first()) == (0, 0, 0)
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0, 0.0])], "o array<float>, p array<float>, s array<float>")
    assert v.select(revision.delta_embedding_score(F.col("o"), F.col("p"), F.col("p"))).first()[0] == pytest.approx(1)
    assert v.select(revision.delta_embedding_score(F.col("o"), F.col("s"), F.col("p"))).first()[0] == 0


def test_averages_skip_nulls_and_keep_null_groups(spark):
    df = spark.createDataFrame([("x", 1.0, None), ("x", 0.0, 0.5), (None, None, None)], "g string, a double, b double")
    whole = metrics.averages(df, ["a", "b"]).first()
    assert (whole.num_queries, whole.a, whole.b) == (3, 50, 50)
    assert {r.g: (r.a, r.b) for r in metrics.averages(df, ["a", "b"], ["g"]).collect()} == {"x": (50, 50), None: (0, 0)}
    acc, mrr, ndcg = F.lit(0.8), F.lit(0.5), F.lit(0.7)
    assert df.select(metrics.retrieval_average(acc, mrr, ndcg)).first()[0] == pytest.approx(2 / 3)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 5.0, 3.0])], "v array<float>, x array<double>")
    assert df.select(dense.normalized(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    assert df.select(dense.top_mean(F.col("x"), 2)).first()[0] == 4 and df.select(dense.top_mean(F.col("x"), 9)).first()[0] == 3


def test_answers(spark):
    text = "高强螺栓储存温度不应少于五度。其他句子也在这里。"
    df = spark.createDataFrame([("依据“高强螺栓储存温度不应少于五度”" + "甲" * 90, [text]), ("短", [text]), ("乙" * 120, [text]), ("“假的引文”" + "乙" * 120, [text])], "a string, t array<string>")
    assert [r[0] for r in df.select(evidence.validity(F.col("a"), F.col("t"))).collect()] == ["ok", "short", "no quote", "not verbatim"]
    fixed = df.select(evidence.repaired(F.col("a"), F.lit("螺栓温度"), F.col("t")).alias("r"), "t")
    assert all(r[0] == "ok" for r in fixed.select(evidence.validity(F.col("r"), F.col("t"))).collect())
    assert df.select(evidence.best_quote(F.lit("螺栓储存温度"), F.col("t"))).first()[0] == "高强螺栓储存温度不应少于五度。"


def test_review_rows(spark):
    from rillgraph.plans.review import score_rows

    fixed, fine = "修改建议：建议改为：“甲乙丁。”", "修改建议：无错误。"
    rows = [("a", "甲乙丙", True, "甲乙丁", fixed, fixed), ("b", "甲", False, "甲", fine, fine), ("c", "甲", False, "甲", fine, fixed), ("d", None, None, None, None, None)]
    got = {r.qid: r for r in score_rows(spark.createDataFrame(rows, "qid string, review_sentence string, is_error boolean, correct_sentence string, gold_answer string, prediction string")).collect()}
    assert got["a"].edit_f1 == 1 and got["a"].reference_fragments == ["丁"] and got["a"].revision_char_f1 == 1 and got["a"].answer_char_f1 == 1
    assert got["b"].edit_f1 == 1 and got["b"].kept_as_it_is and got["c"].edit_f1 == 0 and not got["d"].parsed


def row(df, columns):
    return df.select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_records(spark):
    df = spark.createDataFrame([([1, 0, 2], [2], ["x", None], ["x"])], "r array<bigint>, g array<bigint>, rs array<string>, gs array<string>")
    got = row(df, metrics.retrieval_record("r", "g", 3))
    assert got == pytest.approx({"acc_3": 1, "coverage_3": 1, "precision_3": 1 / 3, "mrr_3": 1 / 3, "ndcg_3": 0.5, "map_3": 1 / 3, "ret_avg_3": (1 + 1 / 3 + 0.5) / 3})
    df = df.withColumn("r", F.array(*(F.lit(i).cast("bigint") for i in (1, 2, 3))))
    got = row(df, metrics.review_metrics("r", "g", "rs", "gs", 3))
    assert got == pytest.approx({"acc_3": 1, "coverage_3": 1, "spec_acc_3": 1, "mrr_3": 0.5, "ndcg_3": 1 / math.log2(3)})
    twice = spark.createDataFrame([([1, 2, 2, 5], [2, 5])], "r array<bigint>, g array<bigint>")
    got = row(twice, metrics.coverage_metrics("r", "g", 4))
    assert got["acc_4"] == got["coverage_4"] == 1 and got["mrr_4"] == 0.5
    nothing = spark.createDataFrame([(None, None)], "rs array<string>, gs array<string>")
    assert nothing.select(metrics.spec_accuracy("rs", "gs", 5)).first()[0] == 0


def test_generation_records(spark):
    df = spark.createDataFrame([("same words", "same words"), ("", "x"), ("x", None)], "p string, a string")
    rows = df.select(*(c.alias(n) for n, c in metrics.generation_record("p", "a").items())).collect()
    assert set(rows[0]) == {1.0} and set(rows[1]) == set(rows[2]) == {None}
    assert df.select(metrics.generation_average(F.lit(0.5), F.lit(0.5), F.lit(1.0))).first()[0] == pytest.approx(2 / 3)


def test_summary_of_every_number(spark):
    df = spark.createDataFrame([("x", 0.25, True, "t"), ("x", 0.75, False, "t"), (None, None, True, "t")], "g string, a double, b boolean, t string")
    got = {r.g: r.asDict() for r in metrics.summary(df, ["g"], {"a": "alpha"}).collect()}
    assert got["x"] == {"g": "x", "num_queries": 2, "alpha": 50, "b": 50} and got[None]["b"] == 100


def test_delta_of_vectors(spark):
    v = spark.createDataFrame([([0.0, 0.0], [0.0, 1.0], [0.0, 2.0], [1.0, 0.0])], "o array<double>, p array<double>, r array<double>, s array<double>")
    of = lambda a, b, *more: tuple(v.select(*revision.delta_embedding_prf(F.col("o"), F.col(a), F.col(b), *more).values()).first())
    assert of("p", "p") == pytest.approx((1, 1, 1)) and of("p", "r") == pytest.approx((1, 0.5, 2 / 3)) and of("r", "p") == pytest.approx((0.5, 1, 2 / 3))
    assert of("p", "s") == (0, 0, 0) and of("o", "o") == (1, 1, 1) and of("o", "p") == (0, 0, 0)
    assert of("o", "p", F.lit(False), F.lit(False)) == (0, 0, 0) and of("p", "r", F.lit(True), F.lit(True)) == (1, 1, 1)


def test_a_refusal_is_dropped_from_a_repaired_answer(spark):
    text = "高强螺栓储存温度不应少于五度。"
    df = spark.createDataFrame([("信息不足，无法回答。" + "丙" * 100, [text]), ("", [text])], "a string, t array<string>")
    fixed = df.select(evidence.repaired(F.col("a"), F.lit("螺栓温度"), F.col("t")).alias("r"), "t")
    got = fixed.select("r", evidence.validity(F.col("r"), F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == ["ok", "ok"] and "丙" not in got[0].r and got[0].r == got[1].r
    assert df.select(evidence.repaired(F.lit(""), F.lit(""), F.col("t"), notes=())).first()[0].endswith("”。")


def test_long_questions_are_gone_through_once_for_a_quote(spark):
    clause = "高强螺栓储存温度不应少于五度。" + "".join(f"第{i}批构件开封后在{i}小时内用完并留样。" for i in range(40))
    question = "".join(f"{i}号构件" for i in range(3000)) + "螺栓储存温度"
    df = spark.createDataFrame([(question, [clause])], "q string, t array<string>")
    began = time.time()
    quote, mended = df.select(evidence.best_quote(F.col("q"), F.col("t")), evidence.repaired(F.lit(""), F.col("q"), F.col("t"))).first()
    assert time.time() - began < 60
    assert quote == "高强螺栓储存温度不应少于五度。" and quote in mended


def test_clause_groups_of_many_hits_are_worked_out_once_a_hit(spark):
    hits = [(i + 1, i, "S", None, f"{i // 2}.1", "短", None) for i in range(400)] + [(401, 400, "S", None, "900", "短", None)]
    df = spark.createDataFrame([("q", hits)], f"q string, hits {evidence.EVIDENCE}")
    began = time.time()
    prompt = df.select(evidence.answer_prompt(F.col("q"), F.col("hits"))).first()[0]
    assert time.time() - began < 60
    marks = prompt[prompt.index("同组条文：") :].split("\n")[0]
    assert marks.endswith("[400]") and marks.count("[") == 400
