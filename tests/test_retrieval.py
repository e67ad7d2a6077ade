import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.operators import answers, bm25, dense, evidence, extraction, graph, joins, models, semantic, subgraph
from rillgraph.plans import pipeline
from rillgraph.sources import scratch

DOCS = [(0, "Concrete must be cured for fourteen days."), (1, "Rebar spacing follows drawings."), (2, "Formwork stays until strength is reached."), (3, None)]


def test_bm25_ranks_the_matching_text_and_keeps_all(spark):
    corpus = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", "concrete cured fourteen days"), ("none", "")], "qid string, question string")
    ranked = {}
    for r in bm25.rank(corpus, queries, 4).orderBy("qid", "rank").collect():
        ranked.setdefault(r.qid, []).append(r.doc_id)
    assert ranked["q"][0] == 0 and sorted(ranked["q"]) == [0, 1, 2, 3]
    assert ranked["none"] == [3, 2, 1, 0]


def test_bm25_leaves_out_pairs_that_cannot_be_best(spark, monkeypatch):
    monkeypatch.setattr(bm25, "POSTINGS_A_BLOCK", 100)
    monkeypatch.setattr(bm25, "QUERIES_A_BLOCK", 7)
    rng = random.Random(5)
    said = lambda most: " ".join(f"w{min(int(rng.expovariate(0.2)), 29)}" for _ in range(rng.randint(0, most)))
    corpus = spark.createDataFrame([(i, said(12)) for i in range(300)] + [(300 + i, "w1 w2") for i in range(40)] + [(400, None)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(f"q{i}", said(6)) for i in range(20)] + [("same", "w1 w2 w1"), ("none", "absent"), ("null", None)], "qid string, question string")
    every = bm25.scores(corpus, queries)
    want = bm25.ranking.top(bm25.ranking.with_unmatched(every, queries, corpus, 4), 4)
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())
    assert rows(bm25.rank(corpus, queries, 4)) == rows(want)
    assert bm25.best(corpus, queries, 4).count() < every.count() / 3
    assert bm25.rank(corpus.limit(0), queries, 4).count() == 0 and bm25.rank(corpus, queries.limit(0), 4).count() == 0


def test_bm25_sends_on_only_the_best_and_asks_equal_questions_once(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"aa b{i % 7} c{i % 3} and much that nobody asks for") for i in range(60)] + [(5, "aa aa b1"), (5, "aa"), (None, "aa")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(f"q{i}", f"aa b{i % 2} c1 absent{i}") for i in range(12)], "qid string, question string")
    kept, every = {}, bm25.scores(corpus.where("doc_id <> 5"), queries)
    monkeypatch.setattr(bm25, "written", lambda df, name: kept.setdefault(name, scratch.written(df, name)))
    rows = lambda df: sorted((r.qid, r.doc_id, round(r.score, 8)) for r in df.collect())
    found = bm25.best(corpus, queries, 4)
    assert found.count() == 12 * 4  # a pair that isn't among the best doesn't leave
    assert kept["queries"].count() == 2  # of 12, since absent words don't tell them apart
    assert kept["bags"].agg(F.max(F.size("t"))).first()[0] <= 4  # words that nobody asks for aren't written
    kept.clear()
    monkeypatch.setattr(bm25, "TOKENS_SENT", 0)  # more than can be sent
    assert rows(bm25.best(corpus, queries, 4)) == rows(found)
    kept.clear()
    want = bm25.ranking.top(every, 4).select("qid", "doc_id", "score")
    assert rows(bm25.best(corpus.where("doc_id <> 5"), queries, 4)) == rows(want)


def test_evidence_moves_only_texts_that_were_found(spark):
    corpus = spark.createDataFrame([(i, f"text {i}", "s", "n", "1", None) for i in range(30)], "doc_id bigint, text string, spec_id string, spec_name string, clause string, scenario_keywords array<string>")
    ranked = spark.createDataFrame([("q", 3, 1), ("q", 8, 2), ("r", 3, 1), ("r", 9, 7)], "qid string, doc_id bigint, rank int")
    found = evidence.gathered(ranked, corpus, 5)
    assert {(r.qid, tuple(h.text for h in r.hits)) for r in found.collect()} == {("q", ("text 3", "text 8")), ("r", ("text 3",))}
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_formula(spark):
    corpus = spark.createDataFrame([(0, "aa bb"), (1, "aa"), (2, "cc")], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", "bb bb")], "qid string, question string")
    idf = math.log1p((3 - 1 + 0.5) / 1.5)
    want = 2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (4 / 3)))
    assert bm25.scores(corpus, queries).first().score == pytest.approx(want)


def test_dense_is_a_full_ranking(spark):
    vectors = models.encoded(spark.createDataFrame([(t,) for t in "abcde"], "t string"), "t").select(F.ascii("text").cast("bigint").alias("doc_id"), "embedding")
    ranked = dense.rank(vectors, vectors.select(F.col("doc_id").alias("qid"), "embedding"), 5).collect()
    assert len(ranked) == 25 and all(r.qid == r.doc_id for r in ranked if r["rank"] == 1)
    assert dense.rank(vectors.limit(0), vectors.select(F.col("doc_id").alias("qid"), "embedding"), 5).count() == 0


def test_entities_and_relations(spark):
    corpus = spark.createDataFrame([(0, "Weld Throat near Shear Stud. Quiet words."), (1, "Weld Throat near Shear Stud. Quiet words."), (2, None)], "doc_id bigint, text string")
    found = graph.entities(corpus)
    rows = found.orderBy("rank").collect()
    assert {r.key for r in rows} >= {"weld throat", "shear stud", "words"} and len({r.doc_key for r in rows}) == 1
    assert rows[0].key in ("weld throat", "shear stud") and max(r["rank"] for r in rows) <= 24
    pairs = {(r.src, r.dst) for r in graph.relations(found).collect()}
    assert pairs and not any({"words", "Weld Throat"} == set(p) for p in pairs)
    lonely = spark.createDataFrame([("k", 1, "A", [0]), ("k", 2, "B", [1])], "doc_key string, rank int, surface string, sents array<int>")
    assert [(r.src, r.dst) for r in graph.relations(lonely).collect()] == [("A", "B")]
    assert graph.entities(corpus.limit(0)).count() == 0


NAMED = "doc_id bigint, entities array<string>, relations array<struct<src:string,dst:string>>"


def test_expansion_and_exact_scores(spark):
    docs, words = graph.indexed(spark.createDataFrame([(0, ["a"], None), (1, ["d"], None), (2, ["b", "c"], None)], NAMED))
    of = {r.name: r.entity for r in words.collect()}
    assert of == {"a": 0, "b": 1, "c": 2, "d": 3}
    links = spark.createDataFrame([(of[x], of[y]) for x, y in ("ab", "ba", "bc", "cb", "cd", "dc")], "u bigint, v bigint")
    reach = graph.expansion(docs, words, links)
    assert {(r.doc_id, r.entity, r.hop) for r in reach.collect()} >= {(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 3, 0), (1, 2, 1), (1, 1, 2)}
    assert not any(r.doc_id == 0 and r.entity == 3 for r in reach.collect())
    tight = graph.expansion(docs, words, links, cap=2).groupBy("doc_id").count().collect()
    assert all(r["count"] == 2 for r in tight)
    terms = spark.createDataFrame([("q", 0, "a")], "qid string, pos int, term string")
    w = math.log1p(3 / 1) ** 0.25
    got = {r.doc_id: r.score for r in subgraph.scores(docs, words, reach, terms, n=3, alpha=0.03).collect()}
    offered = w / 3
    assert got[0] == pytest.approx((w / 3 - 0.03) / offered) and got[2] == pytest.approx(max(0.7 * w / 3 - 0.06, 0) / offered)
    asked = spark.createDataFrame([("q", "Aaa"), ("none", "")], "qid string, question string")
    order = {}
    for r in subgraph.rank(docs, words, reach, asked, k=2).orderBy("rank").collect():
        order.setdefault(r.qid, []).append(r.doc_id)
    assert order == {"q": [2, 1], "none": [0, 1]}  # without terms in the order of ids


def test_expansion_stays_in_arrays(spark):
    docs = spark.createDataFrame([(0, [0, 1], None), (1, [1, 2], None), (2, [], None)], "doc_id bigint, entities array<bigint>, relations array<struct<src:bigint,dst:bigint>>")
    words = spark.createDataFrame([(0, "a", 1, 0.9), (1, "b", 2, 0.8), (2, "c", 1, 0.7)], "entity bigint, name string, df bigint, idf double")
    reach = graph.expansion(docs, words, graph.edges(docs))
    assert {(r.doc_id, r.entity, r.hop, round(r.weight, 3)) for r in reach.collect()} == {(0, 0, 0, 0.9), (0, 1, 0, 0.8), (0, 2, 1, 0.49), (1, 1, 0, 0.8), (1, 2, 0, 0.7), (1, 0, 1, 0.63)}
    assert "Join" not in reach._jdf.queryExecution().simpleString()
    assert {r.entity for r in joins.only(reach, spark.createDataFrame([(2,), (2,)], "entity bigint"), "entity").collect()} == {2}


def test_expansion_shuffles_only_what_lists_that_are_sent_leave_open(spark, monkeypatch):
    # every document has the entity 3, whose two neighbours bound what others can add: only 0 of entity 2 is below
    docs = spark.createDataFrame([(i, [2, 3] if i % 2 else [3], None) for i in range(40)], "doc_id bigint, entities array<bigint>, relations array<struct<src:bigint,dst:bigint>>")
    words = spark.createDataFrame([(0, "a", 1, 1.0), (1, "b", 1, 1.0), (2, "c", 20, 0.9), (3, "d", 40, 0.8)], "entity bigint, name string, df bigint, idf double")
    links = spark.createDataFrame([(3, 0), (3, 1), (3, 2), (2, 0), (2, 0)], "u bigint, v bigint")
    assert {r.u: r.vs for r in graph.neighbours(links, 2, "bigint").collect()} == {3: [0, 1], 2: [0]}
    monkeypatch.setattr(graph, "PAIRS_HELD", 1)
    assert {r.u: r.vs for r in graph.neighbours(links, 2, "int").collect()} == {3: [0, 1], 2: [0]}
    kept = {}
    monkeypatch.setattr(graph, "written", lambda df, name: kept.setdefault(name, []).append(scratch.written(df, name)) or kept[name][-1])
    reach = graph.expansion(docs, words, links, cap=2)
    assert {(r.doc_id, r.entity, r.hop) for r in reach.collect()} == {(i, e, h) for i in range(40) for e, h in ([(2, 0), (3, 0)] if i % 2 else [(3, 0), (0, 1)])}
    assert [df.count() for df in kept["one-hop"]] == [40, 0]  # no document is gone through in two hops
    assert kept["one-hop"][0].agg(F.max(F.size("one"))).first()[0] <= 1
    rows = reach.groupBy("doc_id", "hop").agg(F.count("*"), F.round(F.sum("weight"), 6))
    sums = graph.expansion(docs, words, links, cap=2, summed=True).select("doc_id", "hop", "entities", F.round("weight", 6))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, rows.collect()))
    monkeypatch.setattr(graph, "LISTS_SENT", 0)
    assert sorted(map(tuple, graph.expansion(docs, words, links, cap=2).collect())) == sorted(map(tuple, reach.collect()))


def plain_expansion(entities, idf, links, gamma, cap):
    """Breadth first, one document at a time."""
    out = {}
    for doc, own in entities.items():
        hops = {e: 0 for e in own}
        for hop in (1, 2):
            for u in [e for e, h in hops.items() if h == hop - 1]:
                for v in links.get(u, ()):
                    hops.setdefault(v, hop)
        best = sorted(hops, key=lambda e: (-round(gamma ** hops[e] * idf[e], 9), e))[:cap]
        out |= {(doc, e): hops[e] for e in best}
    return out


@pytest.mark.parametrize("cap", [1, 3, 6, 15])
def test_expansion_against_one_document_at_a_time(spark, cap):
    import random

    rng = random.Random(cap)
    names = [f"e{i:02}" for i in range(60)]
    rows = []
    for i in range(80):
        own = sorted({names[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randrange(5))})
        relations = [(rng.choice(names).upper(), rng.choice(own or names)) for _ in range(rng.randrange(4))]
        rows.append((i, own, relations or None))
    docs, words = graph.indexed(spark.createDataFrame(rows, NAMED))
    of = {r.name: (r.entity, r.idf) for r in words.collect()}
    assert sorted(i for i, _ in of.values()) == list(range(len(of)))
    links = {}
    for _, own, relations in rows:
        pairs = [(a.lower(), b) for a, b in relations] if relations else [(a, b) for i, a in enumerate(own) for b in own[i + 1 : i + 8]]
        for a, b in pairs:
            if a in of and b in of:
                links.setdefault(of[a][0], set()).add(of[b][0])
                links.setdefault(of[b][0], set()).add(of[a][0])
    found = graph.edges(docs)
    assert {(r.u, r.v) for r in found.collect()} == {(u, v) for u, vs in links.items() for v in vs}
    want = plain_expansion({i: [of[e][0] for e in own] for i, own, _ in rows}, dict(of.values()), links, 0.7, cap)
    assert {(r.doc_id, r.entity): r.hop for r in graph.expansion(docs, words, found, cap=cap).collect()} == want


def test_semantic_scores(spark):
    docs, words = graph.indexed(spark.createDataFrame([(0, ["aaa"], None), (1, ["bbb"], None)], NAMED))
    reach = graph.expansion(docs, words, graph.edges(docs))
    entities = models.encoded(words, "name").join(words.withColumnRenamed("name", "text"), "text").select("entity", "embedding")
    asked = entities.where("entity = 0").select(F.lit(1).alias("term_id"), "embedding")
    terms = spark.createDataFrame([("q", 1)], "qid string, term_id int")
    sims = semantic.similarities(asked, entities)
    got = {r.doc_id: r.score for r in semantic.scores(docs, semantic.coverage(sims, terms, reach, 3), semantic.offered(sims, terms, words, 3)).collect()}
    a, b = models.HashEncoder().encode_batch(["aaa", "bbb"])
    c, w = float(a @ b), math.log1p(2) ** 0.25
    whole = max(w * (1 + c) / 2, 1e-9)
    assert got[0] == pytest.approx(max(w - 0.03, 0) / whole, rel=1e-5) and got[1] == pytest.approx(max(c * w - 0.03, 0) / whole, rel=1e-5)


def test_relation_terms(spark):
    docs, words = graph.indexed(spark.createDataFrame([(0, ["a", "b"], [("A", "B"), ("A", "unknown")]), (1, ["c", "d"], None)], NAMED))
    edges = semantic.local_edges(docs)
    assert {(r.doc_id, r.pos, r.u, r.v) for r in edges.collect()} == {(0, 0, 0, 1), (0, 1, 1, 0), (1, 0, 2, 3), (1, 1, 3, 2)}
    assert semantic.local_edges(docs, 1).count() == 2 and semantic.local_edges(docs, None).count() == 4
    idf = spark.createDataFrame([(e, 2.0) for e in range(4)], "entity bigint, idf double")
    ends = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.2), (1, 2, 0.1), (1, 3, 0.0), (2, 1, 0.5), (2, 0, 0.0), (2, 2, 0.0), (2, 3, 0.4)], "term_id int, entity bigint, sim double")
    relations = spark.createDataFrame([("q", 0, 1, 2)], "qid string, rel int, src_id int, dst_id int")
    related, whole = semantic.relation_terms(relations, ends, idf, edges)
    assert {r.doc_id: r.related for r in related.collect()} == pytest.approx({0: 1.5, 1: 0.5}) and whole.first().related_offered == pytest.approx(1.5)
    assert semantic.relation_terms(relations, ends, idf, edges, None)[1].first().related_offered == pytest.approx(1.5)
    covered = spark.createDataFrame([("q", 0, 0.01), ("q", 1, 1.0)], "qid string, doc_id bigint, covered double")
    offered = spark.createDataFrame([("q", 2.0)], "qid string, offered double")
    paper = {r.doc_id: r.score for r in semantic.scores(docs, covered, offered, (related, whole), weight=1.0).collect()}
    plain = {r.doc_id: r.score for r in semantic.scores(docs, covered, offered, (related, whole), paper=False).collect()}
    assert paper == pytest.approx({0: 1.5 / 3.5, 1: (0.94 + 0.5) / 3.5}) and plain == pytest.approx({0: (0.01 + 1.5 - 0.06) / 3.5, 1: (1 + 0.5 - 0.06) / 3.5})


def test_pipeline(spark, tables):
    read = lambda n: spark.read.parquet(f"{tables}/{n}.parquet")
    corpus, queries = pipeline.prepare(read("review_example"), read("benchmark_query"), pipeline.Config(sample_size=5))
    assert queries.count() == 5
    config = pipeline.Config(methods=("bm25",))
    report = pipeline.evaluate(pipeline.infer(corpus, queries, read("corpus_graph"), None, config), config).collect()
    assert report[0].num_queries == 5 and all(0 <= r.ndcg_10 <= 100 for r in report)
    dense_report = pipeline.evaluate(pipeline.infer(corpus, queries, None, None, pipeline.Config(methods=("dense",))))
    assert dense_report.first().num_with_prediction == 0 and "ret_avg_5" in dense_report.columns
    with pytest.raises(ValueError):
        pipeline.rank("other", corpus, queries, read("corpus_graph"), None)


def test_replies_are_retried_and_failures_are_columns(spark):
    class Moody:
        def __init__(self):
            self.calls = 0

        def call_text(self, system, user):
            self.calls += 1
            if user == "fail":
                raise TimeoutError("slow")
            return "good" if self.calls > 1 else "bad"

    df = spark.createDataFrame([("ask",), ("fail",)], "prompt string").coalesce(1)
    rows = {r.prompt: r for r in models.replies(df, "prompt", Moody, accept=lambda t: t == "good").collect()}
    assert rows["ask"].reply == "good" and rows["ask"].attempts == 2 and rows["ask"].error is None
    assert rows["fail"].reply is None and "TimeoutError" in rows["fail"].error


CLAUSE = "高强螺栓储存温度不应少于五度，开封后十二小时内用完，每批留样备查。"


def test_answers_are_checked_retried_and_mended(spark):
    class Scripted:
        """Answers by what the question asks for; refuses the first time."""

        def __init__(self):
            self.asked = {}

        def call_text(self, system, user):
            n = self.asked[user] = self.asked.get(user, 0) + 1
            if "fail" in user:
                raise TimeoutError("slow")
            if "good" in user:
                return "<think>…</think>依据“高强螺栓储存温度不应少于五度”" + "甲" * 90
            return "修改建议：无错误。" if "verdict" in user and n else "draft"

    hit = "hits array<struct<rank:int,doc_id:bigint,spec_id:string,spec_name:string,clause:string,text:string,scenario_keywords:array<string>>>"
    found = [(1, 0, "S", None, "1.2", CLAUSE, None)]
    rows = spark.createDataFrame([("a", "good", found), ("b", "other", found), ("c", "fail", found), ("d", "fail", None), ("e", None, found)], f"qid string, question string, {hit}")
    got = {r.qid: r for r in answers.answers(rows, Scripted, attempts=2).collect()}
    assert got["a"].origin == "reply" and got["a"].attempts == 1 and got["a"].prediction.startswith("依据") and got["a"].error is None
    assert got["b"].origin == "repaired" and "draft" in got["b"].prediction and got["b"].attempts == 2
    assert got["c"].origin == "evidence" and CLAUSE[:10] in got["c"].prediction
    assert got["e"].origin == "repaired" and len(got) == 5
    assert got["d"].origin is not None or "TimeoutError" in got["d"].error
    cases = spark.createDataFrame([("a", "ctx", "verdict", found), ("b", None, "other", None)], f"qid string, scenario_context string, review_sentence string, {hit}")
    got = {r.qid: r for r in answers.reviews(cases, Scripted, attempts=2).collect()}
    assert got["a"].has_error is False and got["a"].error is None and got["b"].has_error is None and got["b"].error == "no verdict"


def test_semantic_method(spark):
    corpus = spark.createDataFrame([(0, "Weld Throat near Shear Stud."), (1, "Formwork props stay."), (2, None)], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", "Shear Stud"), ("none", "")], "qid string, question string")
    cache = spark.createDataFrame([("Shear Stud", ["shear stud"], [("shear stud", "weld throat")])], "question string, entities array<string>, relations array<struct<src:string,dst:string>>")
    for given in (None, cache):
        ranked = {}
        for r in pipeline.rank("semantic", corpus, queries, None, given, pipeline.Config(top_k=3, least=0.6)).orderBy("rank").collect():
            ranked.setdefault(r.qid, []).append(r.doc_id)
        assert ranked["q"][0] == 0 and sorted(ranked["q"]) == [0, 1, 2] and ranked["none"] == [0, 1, 2]


@pytest.mark.parametrize("paper", [True, False])
def test_alignment_keeps_the_best_over_blocks(paper):
    rng = np.random.default_rng(3)
    terms, links, whole = rng.integers(0, 3, (40, 9)) * (rng.random((40, 9)) < 0.4), rng.integers(0, 2, (40, 5)), rng.uniform(1, 4, 40)
    terms[:, 0] = 1
    has, holds = rng.integers(0, 4, (300, 9)) / 4 * (rng.random((300, 9)) < 0.3), rng.integers(0, 3, (300, 5)) / 2
    cost = rng.integers(0, 20, 300) * 0.03

    def rows(m):
        at, number = np.nonzero(m)
        return at, number, m[at, number].astype(float)

    found = semantic.Aligned(rows(terms), rows(links), whole, 4, paper)
    for a in range(0, 300, 70):
        block = slice(a, min(a + 70, 300))
        found.add(np.arange(300)[block], cost[block], *((np.bincount(x[0], minlength=len(cost[block])), *x[1:]) for x in (rows(has[block]), rows(holds[block]))))
    covered, related = terms @ has.T, links @ holds.T
    score = (np.maximum(covered - cost, 0) + related if paper else np.maximum(covered + related - cost, 0)) / whole[:, None]
    score = np.where(covered > 0, score, -1)
    want = {q: {int(d): score[q, d] for d in np.lexsort((np.arange(300), np.round(score[q], 9)))[-4:]} for q in range(40)}
    got = {}
    for q, d, x in zip(*found.rows()):
        got.setdefault(int(q), {})[int(d)] = x
    assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q]) for q in want)


def test_semantic_ranking_sends_on_only_the_best(spark, monkeypatch):
    class Letters:
        """Names are as similar as their letters are."""

        def encode_batch(self, texts):
            m = np.array([[t.count(c) for c in "abcd"] for t in texts], float).reshape(len(texts), 4)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)

    rng = random.Random(5)
    names = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(25)]
    listed = lambda: [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 4))]
    rows = [(i, rng.sample(names, rng.randint(0, 6)), rng.choice([None, listed()])) for i in range(60)]
    docs, words = graph.indexed(spark.createDataFrame(rows, NAMED))
    queries = spark.createDataFrame([(f"q{i}", f"question {i % 9}") for i in range(20)], "qid string, question string")
    cache = spark.createDataFrame([(f"question {i}", [rng.choice([*names, "zzz"]) for _ in range(3)], listed()) for i in range(8)], "question string, entities array<string>, relations array<struct<src:string,dst:string>>")
    reach = graph.expansion(docs, words, None, cap=8, listed=True)
    told = graph.expansion(docs, words, graph.pairs(docs), cap=8)
    assert sorted(map(tuple, reach.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.*").collect())) == sorted(map(tuple, told.collect()))
    monkeypatch.setattr(semantic, "MARKS_A_BLOCK", 40)
    sizes, inner = [], semantic.best
    monkeypatch.setattr(semantic, "best", lambda *a: (sizes.append((f := inner(*a)) and f.count()), f)[1])
    for given, paper in ((cache, True), (cache, False), (None, True)):
        rank = lambda: sorted((r.qid, r.rank, r.doc_id, round(r.score, 7)) for r in semantic.rank(docs, words, reach, queries, given, Letters, 3, 2, paper=paper, least=0.6).collect())  # noqa: B023, E731
        few = rank()
        with monkeypatch.context() as m:
            m.setattr(semantic, "SENT", -1)  # all pairs, by joins
            assert rank() == few
    assert sizes[1::2] == [None] * 3 and 0 < max(sizes[::2]) <= 20 * 3


def test_spread_joins_lose_and_repeat_nothing(spark):
    many = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (3, 100)], "k int, i int").withColumn("rows", F.when(F.col("k") == 1, 120_000).otherwise(1))
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").withColumn("rows", F.when(F.col("k") == 1, 120_000).otherwise(1))
    want = sorted([(1, i, v) for i in range(50) for v in "ab"] + [(2, 99, "c")])
    assert sorted((r.k, r.i, r.v) for r in joins.spread(many, few, "k", "i", "rows").collect()) == want
    assert sorted((r.k, r.i, r.v) for r in joins.spread(many.drop("rows"), few.drop("rows"), "k", "i").collect()) == want


def test_evaluation_of_answers(spark):
    rows = [("m", "g", [1], [1], "甲乙", "甲乙"), ("m", None, [1], [2], None, "甲"), ("m", "g", [1], [2], "甲", "")]
    df = spark.createDataFrame(rows, "method string, hop_group string, topk array<bigint>, gold array<bigint>, prediction string, answer string")
    got = {r.group_value: r for r in pipeline.evaluate(df).collect()}
    assert got[None].num_queries == 3 and got[None].num_with_prediction == 2 and got[None].gen_char_f1 == 100 and got[None].acc_5 == pytest.approx(100 / 3)
    assert got["None"].num_queries == 1 and got["g"].num_queries == 2


def test_caches_of_extractions_grow_by_what_they_lack(spark, tmp_path):
    class Lister:
        def call_text(self, system, user):
            if "Broken" in user:
                raise ConnectionError("gone")
            if user.startswith(extraction.TEXT_PROMPT[:4]):
                return '```json\n{"entities": ["Shear Stud" "Weld Throat"], "relations": [["Shear Stud", "Weld Throat"]]}\n```'
            return "- Shear Stud\n- Weld Throat" if "|" not in user else "Shear Stud | Weld Throat"

    corpus = spark.createDataFrame([(0, "Shear  Stud"), (1, "Shear Stud"), (2, "Broken Beam"), (3, None)], "doc_id bigint, text string")
    path = str(tmp_path / "texts")
    got = {tuple(r.entities): r for r in extraction.extend_text_cache(corpus, path, Lister, attempts=1).collect()}
    assert got["Shear Stud", "Weld Throat"].llm_ok and [tuple(p) for p in got["Shear Stud", "Weld Throat"].relations] == [("Shear Stud", "Weld Throat")] and len(got) == 2
    failed = got["Broken Beam", "broken", "beam"]
    assert not failed.llm_ok and "ConnectionError" in failed.error and failed.relations == []
    more = corpus.union(spark.createDataFrame([(4, "Other")], "doc_id bigint, text string"))
    assert extraction.extend_text_cache(more, path, Lister).count() == 3
    asked = spark.createDataFrame([("What holds?",), ("What holds?",), ("Broken?",), ("",), (None,)], "question string")
    path = str(tmp_path / "questions")
    for _ in range(2):
        got = {r.question: r for r in extraction.extend_question_cache(asked, path, Lister, attempts=1).collect()}
        assert got["What holds?"].entities == ["Shear Stud", "Weld Throat"] and [tuple(p) for p in got["What holds?"].relations] == [("Shear Stud", "Weld Throat")]
        assert got["Broken?"].entities == ["Broken"] and not got["Broken?"].llm_ok and len(got) == 2
    # the caches are what ranking takes
    ranked = pipeline.rank("subgraph", corpus, asked.where("question = 'What holds?'").distinct().withColumn("qid", F.lit("q")), spark.read.parquet(str(tmp_path / "texts")), spark.read.parquet(path), pipeline.Config(top_k=2))
    assert {r.doc_id for r in ranked.collect()} == {0, 1}


def test_prompts_with_and_without_evidence(spark):
    df = spark.createDataFrame([("q", [(1, 0, "S", None, "1.2", CLAUSE, None)]), ("q", []), ("q", None)], f"q string, hits {evidence.EVIDENCE}")
    got = [r[0] for r in df.select(evidence.prompt_for(F.col("q"), F.col("hits"))).collect()]
    assert CLAUSE in got[0] and got[1] == got[2] and "证据" not in got[1]
    assert df.select(evidence.prompt_for(F.col("q"), F.col("hits"), False)).first()[0] == got[1]


def test_vectors_are_kept(spark, tmp_path):
    class Counting(models.HashEncoder):
        def encode_batch(self, texts):
            (tmp_path / "asked").open("a").write("".join(f"{t}\n" for t in texts))
            return super().encode_batch(texts)

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    for more in ([], ["c"]):
        rows = df.union(spark.createDataFrame([(m,) for m in more], "t string"))
        assert {r.text for r in models.encoded_by(rows, "t", str(tmp_path / "vectors"), Counting).collect()} == {"a", "b", *more}
    assert sorted((tmp_path / "asked").read_text().split()) == ["a", "b", "c"]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"retrieval": {"top_k": 5, "methods": ["dense"]}, "evaluation": {"k": [5, 10]}, "sample": {"size": 3}}')
    config = pipeline.load_config(str(tmp_path / "s.json"))
    assert (config.top_k, config.methods, config.ks, config.sample_size, config.seed) == (10, ("dense",), (5, 10), 3, pipeline.Config.seed)
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("retrieval: {preset: frozen}\nevaluation:\n")
    assert pipeline.load_config(str(tmp_path / "s.yaml")).preset == "frozen"


def test_exact_ranking_sends_on_only_the_best(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(25)]
    listed = lambda: [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 4))]
    rows = [(i, rng.sample(names, rng.randint(0, 6)), rng.choice([None, listed()])) for i in range(80)]
    docs, words = graph.indexed(spark.createDataFrame(rows, NAMED))
    queries = spark.createDataFrame([(f"q{i}", f"question {i % 9}" if i else "") for i in range(20)], "qid string, question string")
    cache = spark.createDataFrame([(f"question {i}", [rng.choice([*names, "zzz"]) for _ in range(3)] + ["n1", "n1"]) for i in range(8)], "question string, entities array<string>")
    lists, long = graph.expansion(docs, words, None, cap=8, listed=True), graph.expansion(docs, words, None, cap=8)
    found = lambda reach: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 7)) for r in subgraph.rank(docs, words, reach, queries, cache, 3, 2).collect())
    want = found(long)
    monkeypatch.setattr(semantic, "MARKS_A_BLOCK", 40)
    with monkeypatch.context() as m:
        m.setattr(subgraph, "scores", None)  # no rows of all pairs
        assert found(lists) == want and any(x[3] > 0 for x in want)
    monkeypatch.setattr(semantic, "SENT", -1)  # more than can be sent
    assert found(lists) == want


def test_names_are_numbered_in_the_tasks(spark, monkeypatch):
    rows = [(0, ["a", "b"], [("A", "B"), ("B", "none"), (None, "a")]), (1, ["b", "c", "d"], None), (2, [], []), (3, None, None), (None, ["a"], [("A", "B")])]
    docs = spark.createDataFrame(rows, NAMED)

    def found():
        held, words = graph.indexed(docs)
        names = {r.entity: r.name for r in words.collect()}
        return sorted((str(r.doc_id), [names[e] for e in r.entities], r.relations and [(names[x.src], names[x.dst]) for x in r.relations]) for r in held.collect())

    with monkeypatch.context() as m:
        m.setattr(graph, "NAMES_SENT", -1)
        want = found()
    monkeypatch.setattr(graph.F, "posexplode", None)  # no row for each name
    assert found() == want and ("0", ["a", "b"], [("a", "b")]) in want


def test_names_of_documents_are_deleted_once_numbered(spark, monkeypatch):
    corpus = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    kept, inner = [], graph.document_graph
    monkeypatch.setattr(graph, "document_graph", lambda *a: kept.append(inner(*a)) or kept[-1])
    docs, words = pipeline.indexed(corpus, None)
    path = kept[0].inputFiles()[0].rpartition("/")[0]
    assert not scratch.exists(spark, path) and docs.count() == 4 and words.count() > 0


def test_methods_by_subgraphs_make_no_row_of_each_pair(spark, tables, monkeypatch):
    read = lambda n: spark.read.parquet(f"{tables}/{n}.parquet")
    corpus, queries = pipeline.prepare(read("review_example"), read("benchmark_query"), pipeline.Config(sample_size=9))
    config = pipeline.Config(methods=("subgraph",), top_k=3)
    monkeypatch.setattr(subgraph, "scores", None)
    found = pipeline.infer(corpus, queries, read("corpus_graph"), read("query_cache"), config).select("qid", "topk").collect()
    assert len(found) == 9 and all(len(set(r.topk)) == 3 for r in found)


def test_expansion_shuffles_no_list_that_is_sent(spark, monkeypatch):
    rows = [(i, ["hub", f"a{i % 7}", f"b{i}"], None) for i in range(40)]
    docs, words = graph.indexed(spark.createDataFrame(rows, NAMED))
    kept = {}
    monkeypatch.setattr(graph, "written", lambda df, name: kept.setdefault(name, scratch.written(df, name)))
    found = lambda: sorted(map(tuple, graph.expansion(docs, words, None, cap=2).collect()))
    want = found()
    assert kept["lists-sent"].columns == ["u"] and kept["lists-sent"].count() > 0  # of these lists only the names are shuffled
    kept.clear()
    monkeypatch.setattr(joins, "ROWS_A_SALT", 3)  # entities of many rows are split
    assert found() == want
