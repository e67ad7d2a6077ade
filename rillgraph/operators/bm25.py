"""BM25 over an inverted table: one row per document and token.

Queries are scored together by joins on tokens; a document is touched only through
the tokens that it shares with a query.  Null texts are empty documents, which count
in the collection's size and average length.

A ranking doesn't need the score of every pair, whose number grows as queries times
documents.  Documents are reduced to the tokens that are asked for, a row each, and
queries to the tokens that are known, one for all with the same; queries are sent to
the documents, a task goes through its documents in blocks, and only the best of each
query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.functions import text as X
from rillgraph.operators import joins, ranking
from rillgraph.sources.readers import numbered
from rillgraph.sources.scratch import written

K1, B = 1.2, 0.75
#: Postings in a block, and queries that are sent at a time.
POSTINGS_A_BLOCK, QUERIES_A_BLOCK = 500_000, 50_000
#: Finding a document in a token's list takes as long as adding so many.
SEARCH = 8
#: Number of asked tokens up to which they are sent to all tasks.
TOKENS_SENT = 2_000_000
#: Bounds of scores are compared with so much to spare, more than what rounding to ``ranking.DECIMALS`` changes.
SPARE = 1e-8


def token_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, dl, token, tf): each text is tokenised once; a document without tokens has no row."""
    tokens = corpus.select("doc_id", X.bm25_tokens(text_col).alias("tokens")).select("doc_id", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("token"))
    return tokens.groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))


def lengths(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, dl) of every document, empty ones too."""
    return corpus.select("doc_id", F.size(X.bm25_tokens(text_col)).cast("bigint").alias("dl"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(token, df)."""
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def scores(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score) of every pair with a common token; a token that a query repeats counts each time."""
    tf = written(token_counts(corpus), "postings")
    # one row; documents' lengths add up to the number of tokens
    whole = tf.agg(F.sum("tf").alias("tokens")).join(corpus.agg(F.count("*").alias("n"))).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))
    asked = queries.select("qid", F.explode(X.bm25_tokens("question")).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))
    known = asked.join(document_frequency(tf), "token").join(F.broadcast(whole))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joins.spread(tf, known, "token", "doc_id").groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * weight).alias("score"))


class Best:
    """The ``k`` best documents of each query among blocks of documents.

    ``asked`` has a row (query, token, factor, bound) per token of a query, sorted by
    queries numbered from 0: a token adds the factor times its weight in the document,
    and ``bound`` is a score that ``k`` documents reach; it rises with what was found.
    Tokens that together stay below the bound only add to documents that have another one.
    """

    def __init__(self, asked: tuple[np.ndarray, ...], k: int) -> None:
        self.query, self.token, self.factor, bound = asked
        self.k = k
        first = np.flatnonzero(np.r_[True, self.query[1:] != self.query[:-1]][: len(self.query)])
        self.bound = bound[first].copy()
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, docs: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, weights: np.ndarray) -> None:
        """Takes up a block: documents, the number of tokens of each, and these with their weights."""
        if not len(tokens) or not len(self.query):
            return
        at = np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(tokens, kind="stable")
        at, tokens, weights = at[order], tokens[order], weights[order]
        known, start = np.unique(tokens, return_index=True)
        end, most = np.r_[start[1:], len(tokens)], np.maximum.reduceat(weights, start)
        place = np.minimum(np.searchsorted(known, self.token), len(known) - 1)
        there = known[place] == self.token
        query, place, factor = self.query[there], place[there], self.factor[there]
        upper = factor * most[place]
        order = np.lexsort((upper, query))  # the least that a token can add first
        query, place, factor, upper = (x[order] for x in (query, place, factor, upper))
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
        last = np.r_[first[1:], len(query)]
        total = np.add.reduceat(upper, first) if len(first) else np.zeros(0)
        score = np.zeros(len(docs))
        for f in np.flatnonzero(total >= self.bound[query[first]] - SPARE):
            a, z = first[f], last[f]
            q = int(query[a])
            least = self.bound[q] - SPARE
            below = np.cumsum(upper[a:z])
            rest = min(int(np.searchsorted(below, least)), z - a - 1)  # so many tokens can't reach the bound together
            left = below[rest - 1] if rest else 0.0
            for i in range(a + rest, z):
                p = place[i]
                score[at[start[p] : end[p]]] += factor[i] * weights[start[p] : end[p]]
            reached = np.flatnonzero(score >= max(least - left, 1e-300))
            for i in range(a + rest - 1, a - 1, -1):
                if not len(reached):
                    break
                p = place[i]
                holders, adds = at[start[p] : end[p]], weights[start[p] : end[p]]
                if len(reached) * SEARCH > len(holders):
                    score[holders] += factor[i] * adds
                else:
                    there = np.minimum(np.searchsorted(holders, reached), len(holders) - 1)
                    hit = holders[there] == reached
                    score[reached[hit]] += factor[i] * adds[there[hit]]
                reached = reached[score[reached] >= least - (below[i - a - 1] if i > a else 0.0)]
            if len(reached):
                self._keep(q, docs[reached], score[reached])
            score.fill(0.0)

    def _keep(self, q: int, docs: np.ndarray, sums: np.ndarray) -> None:
        if q in self.found:
            docs, sums = np.concatenate((self.found[q][0], docs)), np.concatenate((self.found[q][1], sums))
        if len(docs) > self.k:
            rounded = np.round(sums, ranking.DECIMALS)
            some = np.flatnonzero(rounded >= np.partition(rounded, -self.k)[-self.k])
            chosen = some[np.lexsort((docs[some], rounded[some]))[-self.k :]]
            docs, sums = docs[chosen], sums[chosen]
        if len(docs) == self.k:
            self.bound[q] = max(self.bound[q], sums.min())
        self.found[q] = docs, sums

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, doc_id, score) of what was found."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        docs, sums = (np.concatenate(x) for x in zip(*self.found.values()))
        return np.repeat(np.array(list(self.found), np.int64), [len(d) for d, _ in self.found.values()]), docs, sums


def bags(corpus: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, dl, t, tf): a row per document with its length, and those of its tokens that are among words (token, t); each text is tokenised once."""
    tokenised = corpus.select("doc_id", X.bm25_tokens("text").alias("tokens"))
    if words.count() > TOKENS_SENT:
        rows = tokenised.withColumn("row", F.monotonically_increasing_id()).withColumn("dl", F.size("tokens"))
        known = rows.select("row", "doc_id", "dl", F.explode_outer("tokens").alias("token")).join(words, "token", "left")
        counted = known.groupBy("row", "doc_id", "dl", "t").agg(F.count("*").cast("int").alias("tf"))
        listed = counted.groupBy("row", "doc_id", "dl").agg(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "tf"))).alias("p"))
        return listed.select("doc_id", "dl", F.col("p.t").alias("t"), F.col("p.tf").alias("tf"))
    held = words.toArrow()
    sent = corpus.sparkSession.sparkContext.broadcast((held.column("token").combine_chunks(), held.column("t").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = sent.value
        for batch in batches:
            ends = batch[1].offsets.to_numpy()
            dl = np.diff(ends)
            place = pc.fill_null(pc.index_in(batch[1].values.slice(ends[0], ends[-1] - ends[0]).cast(names.type), names), -1).to_numpy()
            known = place >= 0
            both, tf = np.unique(np.repeat(np.arange(len(dl)), dl)[known] * max(len(names), 1) + place[known], return_counts=True)
            row, place = np.divmod(both, max(len(names), 1))
            cuts = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(dl)))], pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (numbers[place], tf)]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(dl, pa.int32()), *lists], names=["doc_id", "dl", "t", "tf"])

    return tokenised.mapInArrow(run, f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, dl int, t array<int>, tf array<int>")


def best(corpus: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score) as of :func:`scores`, only of the ``k`` best of each query."""
    asked = written(queries.select("qid", F.explode(X.bm25_tokens("question")).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf")), "asked")
    words = written(numbered(asked.select("token").distinct(), "token", into="t").select("token", F.col("t").cast("int").alias("t")), "asked-tokens")
    docs = written(bags(corpus, words), "bags")
    whole = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    n, avgdl = whole.n, whole.tokens / max(whole.n, 1)

    def weight(tf: Column, dl: Column) -> Column:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl or 1.0)))

    some = docs.where(F.size("t") > 0)
    if some.groupBy("doc_id").count().where("count > 1").isEmpty():
        held = some.select("doc_id", "t", F.transform("tf", lambda tf: weight(tf, F.col("dl"))).alias("w"))
        postings = held.select(F.lit(1).alias("rows"), F.explode(F.arrays_zip("t", "w")).alias("p")).select("p.t", "rows", "p.w")
    else:  # ids that come several times
        each = some.select("doc_id", "dl", F.explode(F.arrays_zip("t", "tf")).alias("p")).groupBy("doc_id", "dl", "p.t").agg(F.sum("p.tf").alias("tf"))
        postings = written(each.groupBy("doc_id", "t").agg(F.count("*").alias("rows"), F.sum(weight(F.col("tf"), F.col("dl"))).alias("w")), "postings")
        held = postings.groupBy("doc_id").agg(F.collect_list(F.struct("t", "w")).alias("p")).select("doc_id", F.col("p.t").alias("t"), F.col("p.w").alias("w"))
    held = held.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "t", "w")
    # what the k-th of a token's documents gets: a document of several tokens has no less
    place = Window.partitionBy("t").orderBy(F.col("w").desc())
    kth = postings.select("t", "w").withColumn("k", F.row_number().over(place)).where(F.col("k") <= k).groupBy("t").agg(F.when(F.count("*") == k, F.min("w")).otherwise(0.0).alias("kth"))
    df = written(postings.groupBy("t").agg(F.sum("rows").alias("df")).join(kth, "t"), "known-tokens")
    # queries with the same known tokens have the same best documents
    known = asked.join(words, "token").join(df.select("t"), "t").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("t", "qtf"))).alias("bag"))
    known = written(known, "known")
    kinds = written(known.select("bag").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    tokens = kinds.select("q", F.explode("bag").alias("a")).select("q", "a.t", "a.qtf").join(df, "t").withColumn("factor", F.col("qtf") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tokens = written(tokens.select("q", "t", "factor", F.max(F.col("factor") * F.col("kth")).over(Window.partitionBy("q")).alias("bound")), "factors")
    groups = max(1, -(-kinds.count() // QUERIES_A_BLOCK))

    def against(group: int) -> DataFrame:
        rows = tokens.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == group).orderBy("q").toArrow()
        ids, query = np.unique(rows.column("q").to_numpy(), return_inverse=True)
        sent = corpus.sparkSession.sparkContext.broadcast((ids, (query.astype(np.int32), *(rows.column(c).to_numpy() for c in ("t", "factor", "bound")))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            found, block, size = Best(asked, k), [], 0

            def add() -> None:
                found.add(*(np.concatenate(x) for x in zip(*block)))
                block.clear()

            for batch in batches:
                ends = batch[1].offsets.to_numpy()
                lists = (c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in (batch[1], batch[2]))
                block.append((batch[0].to_numpy(), np.diff(ends), *lists))
                size += ends[-1] - ends[0]
                if size >= POSTINGS_A_BLOCK:
                    add()
                    size = 0
            if block:
                add()
            query, docs, sums = found.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(docs, pa.int64()), pa.array(sums)], names=["q", "doc_id", "score"])

        return held.mapInArrow(run, "q bigint, doc_id bigint, score double")

    found = against(0)
    for group in range(1, groups):
        found = found.unionByName(against(group))
    top = ranking.top(found, k, "q").select("q", "doc_id", "score")
    return top.join(kinds, "q").join(known, "bag").select("qid", "doc_id", "score")


def rank(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` documents of each query; documents without a common token follow with score 0; written once."""
    return written(ranking.top(ranking.with_unmatched(best(corpus, queries, k), queries, corpus, k), k), "best")
