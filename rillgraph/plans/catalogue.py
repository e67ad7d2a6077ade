"""The queries of the engine's own operators over whole tables, with equivalent SQL where SQL can express them.

Scores are rounded in both, so that a difference in the last bit of a sum doesn't
count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions import json_repair
from rillgraph.functions import text as X
from rillgraph.operators import bm25, dense, evidence, graph, metrics, models, ranking, revision, subgraph
from rillgraph.plans import pipeline, review
from rillgraph.sources import readers
from rillgraph.sources.scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    """A pattern or text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


# --- SQL building blocks -------------------------------------------------------------------------------------------
SPACE = "trim(regexp_replace(coalesce({0}, ''), " + q(X.WS + "+") + ", ' ', 'g'))"
STRIP = "regexp_replace({0}, " + q(f"^{X.WS}+|{X.WS}+$") + ", '', 'g')"
KEY = "sha1(" + SPACE + ")"
TOKENS = (
    "list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), " + q(X.BM25_TOKEN) + "), lambda t: not list_contains(" + listed(X.STOP_EN)
    + ", lower(t)) and not list_contains(" + listed(X.STOP_ZH) + ", t)), lambda t: lower(t))"
)
GRAPH_TOKENS = "list_transform(regexp_extract_all(coalesce({0}, ''), " + q(X.GRAPH_TOKEN) + "), lambda t: trim(lower(t), " + q(X.EDGE_SIGNS) + "))"
NORMAL_CHARS = "lower(regexp_replace(coalesce({0}, ''), " + q(f"[^0-9A-Za-z{X.HAN}]") + ", '', 'g'))"
SPAN = "regexp_replace(replace(replace(coalesce({0}, ''), " + q(X.COMMENTARY_LABEL) + ", ''), " + q(X.COMMENTARY) + ", ''), " + q(X.WS + "+") + ", '', 'g')"
ARTICLE = q(X.ARTICLE)
OFFICIAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), " + q(r"[!-/:-@\[-`{-~]") + ", '', 'g'), " + ARTICLE + ", '\\1 \\2', 'g'), " + ARTICLE + ", '\\1 \\2', 'g'), " + q(X.WS + "+") + ", ' ', 'g'))"


def sql(template: str, *args: str) -> str:
    """A building block around columns; braces of patterns stay as they are."""
    for i, a in enumerate(args):
        template = template.replace("{" + str(i) + "}", a)
    return template.replace("{{", "{").replace("}}", "}")


ASKED = "asked as (select qid, max_by({{question: question, answer: answer, gold: gold, hop_group: hop_group}}, question) as q from benchmark_query where length(question) > 0 group by qid), questions as (select qid, q.question as question, q.answer as answer, q.gold as gold, lower(q.hop_group) as hop_group from asked)".replace("{{", "{").replace("}}", "}")


def bm25_ctes(k: int) -> str:
    return f"""{ASKED},
  tok as (select doc_id, unnest({sql(TOKENS, 'text')}) as token from review_example),
  tf as (select doc_id, token, count(*) as tf from tok group by all),
  dl as (select doc_id, len({sql(TOKENS, 'text')}) as dl from review_example),
  st as (select count(*) as n, avg(dl) as avgdl from dl),
  df as (select token, count(*) as df from tf group by token),
  qt as (select qid, token, count(*) as qtf from (select qid, unnest({sql(TOKENS, 'question')}) as token from questions) group by all),
  sc as (select qid, tf.doc_id, sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as score
         from qt join tf using (token) join df using (token) join dl on dl.doc_id = tf.doc_id cross join st group by all),
  al as (select qid, doc_id, max(score) as score from (select * from sc union all select qid, doc_id, 0.0::double from questions, (select doc_id from review_example order by doc_id desc limit {k})) group by all),
  ranked as (select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from al qualify rank <= {k})"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_example")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.questions(table(spark, folder, "benchmark_query"))


# --- text ----------------------------------------------------------------------------------------------------------
@query(f"select doc_id, {sql(KEY, 'text')} as doc_key from review_example")
def doc_cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", X.cache_key("text").alias("doc_key"))


@query(f"select {sql(KEY, 'text')} as doc_key, count(*) as copies, min(doc_id) as first_doc_id from review_example where text is not null group by 1 having count(*) > 1")
def dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    keyed = corpus(spark, folder).where("text is not null").groupBy(X.cache_key("text").alias("doc_key"))
    return keyed.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


@query(f"select doc_id, {sql(NORMAL_CHARS, 'text')} as chars, {sql(SPAN, 'text')} as span, left({sql(SPACE, 'split_part(text, ' + q(X.COMMENTARY) + ', 1)')}, {X.CLAUSE_CHARS}) as direct from review_example")
def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", X.normalized_chars("text").alias("chars"), X.normalized_span("text").alias("span"), X.direct_clause_text("text").alias("direct"))


@query(
    "select doc_id, case when len(n) >= 2 then spec_id || ':' || n[1] || '.' || n[2] when len(n) = 1 then spec_id || ':' || n[1] else spec_id end as clause_group "
    "from (select doc_id, spec_id, regexp_extract_all(coalesce(clause, ''), '[0-9]+') as n from review_example)"
)
def clause_groups(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", X.clause_group("spec_id", "clause").alias("clause_group"))


@query(f"select distinct qid, list_aggregate(regexp_extract_all(coalesce(gold_answer, ''), {q(X.QUOTED)}, 1), 'string_agg', '|') as quotes from review_case")
def quoted_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = X.quoted_spans("gold_answer")
    return table(spark, folder, "review_case").select("qid", F.when(F.size(spans) > 0, F.array_join(spans, "|")).alias("quotes")).distinct()


@query(
    "select distinct qid, case when regexp_matches(t, '修改建议[：:]" + X.WS + "*(?:无错误|无误|符合|无需修改)') then false "
    "when regexp_matches(t, '修改建议[：:].*(?:有错误|有误|不符合|应改为|建议改为)') then true when contains(t, '无错误，无需修改') then false "
    "when regexp_matches(t, '有错误|建议改为|应改为|不符合') then true end as has_error from (select qid, " + sql(SPACE, "gold_answer") + " as t from review_case)"
)
def verdict_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_case").select("qid", X.has_error("gold_answer").alias("has_error")).distinct()


@query(
    "with a as (select distinct qid, review_sentence, " + sql(STRIP, "coalesce(gold_answer, '')") + " as t from review_case), "
    "s as (select *, " + sql(STRIP, "regexp_extract(t, '(?s)^.*修改建议[：:](.*)$', 1)") + " as section from a), "
    "p as (select *, regexp_extract(section, '(?s)(?:建议|应)?改为[：:]" + X.WS + "*[“\"''‘](.*?)[”\"''’]" + X.WS + "*[。.]?" + X.WS + "*$', 1) as quoted, "
    "regexp_extract(section, '(?s)(?:建议|应)?改为[：:]" + X.WS + "*(.+?)" + X.WS + "*$', 1) as plain from s) "
    "select distinct qid, case when not regexp_matches(t, '修改建议[：:]') then '' when regexp_matches(section, '无错误|无误|无需修改') then " + sql(SPACE, "review_sentence")
    + " when quoted <> '' then trim(" + sql(SPACE, "quoted") + ", '。.') else trim(" + sql(SPACE, "plain") + ", '“”\"''‘’。.') end as replacement from p"
)
def replacement_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_case").select("qid", X.replacement_sentence("gold_answer", "review_sentence").alias("replacement")).distinct()


@query("with " + ASKED + ", n as (select qid, " + sql(STRIP, "replace(question, chr(13) || chr(10), chr(10))") + " as t from questions), c as (select *, strpos(t, chr(10) || chr(10)) as cut from n) "
       "select qid, case when cut > 0 then " + sql(STRIP, "left(t, cut - 1)") + " else '' end as context, case when cut > 0 then " + sql(STRIP, "substr(t, cut + 2)") + " else t end as query from c")
def question_split(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("qid", X.split_question("question").alias("s")).select("qid", "s.context", "s.query")


TERMS = f"""t as (select {{key}}, {sql(SPACE, '{text}')} as text from {{source}}),
  w as (select *, list_filter(list_transform(regexp_extract_all(text, {q(X.TERM_WORD)}), lambda x: lower(x)), lambda x: not list_contains({listed(X.STOP_EN)}, x)) as words from t),
  e as (select {{key}}, list_filter(list_concat(list_concat(regexp_extract_all(text, {q(X.TERM_HAN)}), regexp_extract_all(text, {q(X.TERM_PHRASE)})),
        list_concat(words, list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))), lambda x: not list_contains({listed(X.STOP_ZH)}, x)) as every from w),
  l as (select *, list_transform(every, lambda x: lower(x)) as low from e),
  terms as (select {{key}}, list_filter(every, lambda x, i: list_position(low, lower(x)) = i)[1:{{most}}] as terms from l)"""


def terms_sql(key: str, text: str, source: str, most: int) -> str:
    return TERMS.replace("{key}", key).replace("{text}", text).replace("{source}", source).replace("{most}", str(most))


@query(f"with {terms_sql('doc_id', 'text', 'review_example', 48)} select doc_id, list_aggregate(terms, 'string_agg', '|') as terms from terms")
def extract_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = X.extract_terms("text")
    return corpus(spark, folder).select("doc_id", F.when(F.size(terms) > 0, F.array_join(terms, "|")).alias("terms"))


@query(f"select doc_id, '[DOCID:' || doc_id || ']' || chr(10) || coalesce(text, '') as tagged, list_aggregate(list_distinct([doc_id, doc_id]), 'string_agg', '|') as parsed from review_example")
def docid_tag_parse(spark: SparkSession, folder: str) -> DataFrame:
    tagged = X.tag_document("doc_id", "text")
    return corpus(spark, folder).select("doc_id", tagged.alias("tagged"), F.array_join(X.parse_document_ids(F.concat(tagged, tagged), 1 << 40), "|").alias("parsed"))


# --- BM25 ----------------------------------------------------------------------------------------------------------
@query(f"select doc_id, len({sql(TOKENS, 'text')}) as dl from review_example")
def bm25_tokens_stats(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.lengths(corpus(spark, folder))


@query(f"select token, count(*) as df from (select distinct doc_id, unnest({sql(TOKENS, 'text')}) as token from review_example) group by token")
def bm25_df(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.document_frequency(bm25.token_counts(corpus(spark, folder)))


@query(f"with {bm25_ctes(10)} select qid, doc_id, round(score, 6) as score, rank from ranked")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.rank(corpus(spark, folder), asked(spark, folder), 10).withColumn("score", F.round("score", 6))


# --- vectors: queries are every row whose id is divisible by 50 ------------------------------------------------------
UNIT = "v as (select vec_id as doc_id, label, list_transform(embedding, lambda x: x::double / case when sqrt(list_inner_product(embedding::double[], embedding::double[])) < 1e-8 then 1 else sqrt(list_inner_product(embedding::double[], embedding::double[])) end) as e from embeddings)"
DENSE = "with " + UNIT + ", r as (select a.doc_id as qid, b.doc_id, b.label, a.label as want, round(list_inner_product(a.e, b.e), 9) as score, row_number() over (partition by a.doc_id order by round(list_inner_product(a.e, b.e), 9) desc, b.doc_id desc) as rank from v a, v b where a.doc_id % 50 = 0 qualify rank <= 10)"


def _dense(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return vectors, dense.rank(vectors, vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "embedding"), 10)


@query(DENSE + " select qid, doc_id, round(score, 6) as score, rank from r")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder)[1].withColumn("score", F.round("score", 6))


@query(DENSE + " select qid, count(*) filter (label = want) / 10.0::double as precision_10 from r group by qid")
def dense_label_precision(spark: SparkSession, folder: str) -> DataFrame:
    vectors, ranked = _dense(spark, folder)
    labels = vectors.select("doc_id", "label")
    both = ranked.join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("qid"), F.col("label").alias("want")), "qid")
    return both.groupBy("qid").agg((F.sum((F.col("label") == F.col("want")).cast("double")) / 10).alias("precision_10"))


# --- graph ---------------------------------------------------------------------------------------------------------
@query(f"select token, count(*) as df from (select distinct doc_id, unnest({sql(GRAPH_TOKENS, 'text')}) as token from review_example) where not list_contains({listed(X.STOP_EN)}, token) group by token")
def graph_token_df(spark: SparkSession, folder: str) -> DataFrame:
    return graph.token_frequency(corpus(spark, folder))


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), " + q(rf"([.!?]){X.WS}+") + ", '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(" + STRIP.replace("{0}", "s") + ")), lambda s: s <> '')"


@query(f"select doc_id, len(s) as sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::bigint as chars from (select doc_id, {sql(SENTENCES, 'text')} as s from review_example)")
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = X.sentences("text")
    return corpus(spark, folder).select("doc_id", F.size(s).cast("bigint").alias("sentences"), F.aggregate(s, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("chars"))


PHRASES = "regexp_extract_all({0}, " + q(f"{X.PROPER_AFTER}({X.PROPER_PHRASE})") + ", 1)"


@query(f"select doc_id, unnest(p) as phrase, generate_subscripts(p, 1) - 1 as pos from (select doc_id, {sql(PHRASES, 'text')} as p from review_example where text is not null)")
def proper_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", F.posexplode(X.proper_phrases("text")).alias("pos", "phrase")).withColumn("pos", F.col("pos").cast("bigint"))


ENTITIES = f"""td as (select token, count(*) as df from (select distinct doc_id, unnest({sql(GRAPH_TOKENS, 'text')}) as token from review_example) where not list_contains({listed(X.STOP_EN)}, token) group by token),
  nn as (select count(*) as n from review_example),
  ky as (select {sql(KEY, 'text')} as doc_key, min(text) as text from review_example where text is not null group by 1),
  se as (select doc_key, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as sent from (select doc_key, {sql(SENTENCES, 'text')} as s from ky)),
  ph as (select doc_key, sent, unnest(p) as surface, generate_subscripts(p, 1) - 1 as pos from (select doc_key, sent, {sql(PHRASES, 'sentence')} as p from se)),
  pt as (select *, unnest({sql(GRAPH_TOKENS, 'surface')}) as token from ph),
  wt as (select doc_key, sent, pos, surface, count(*) as words, coalesce(max(df), 0) as df, any_value(n) as n, sum(case when list_contains({listed(X.STOP_EN)}, token) then 0 else ln(1 + n / greatest(coalesce(df, 0), 1)::double) end) as weight
         from pt left join td using (token) cross join nn group by all),
  na as (select doc_key, sent, 0 as kind, pos, trim({sql(SPACE, 'surface')}, {q(X.ENTITY_EDGE)}) as surface, 8 + 1.5::double * words + weight as score from wt where not (words = 1 and df > greatest(20, n // 100))),
  ra as (select doc_key, sent, 1 as kind, 0 as pos, trim(token, {q(X.ENTITY_EDGE)}) as surface, ln(1 + n / df::double) as score from (select distinct doc_key, sent, unnest({sql(GRAPH_TOKENS, 'sentence')}) as token from se) join td using (token) cross join nn where df <= greatest(120, n // 30)),
  ek as (select *, lower(trim(regexp_replace(surface, {q(X.WS + '+')}, ' ', 'g'), {q(X.ENTITY_EDGE)})) as key from (select * from na union all select * from ra)),
  eg as (select doc_key, key, max(score) as score, arg_min(surface, sent::bigint * 1000000 + kind * 500000 + pos) as surface, list_distinct(list(sent)) as sents from ek where length(key) >= 3 and not list_contains({listed(X.STOP_EN)}, key) group by all),
  en as (select *, row_number() over (partition by doc_key order by round(score, 9) desc, len(string_split(key, ' ')) desc, key) as rank from eg qualify rank <= {graph.MAX_ENTITIES})"""


@query(f"with {ENTITIES} select doc_key, rank, key, surface, round(score, 6) as score from en")
def graph_entities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.entities(corpus(spark, folder)).select("doc_key", "rank", "key", "surface", F.round("score", 6).alias("score"))


@query(f"""with {ENTITIES}, pr as (select a.doc_key, a.rank as i, b.rank as j, a.surface as src, b.surface as dst, list_has_any(a.sents, b.sents) as together from en a join en b on a.doc_key = b.doc_key and a.rank < b.rank),
  ch as (select * from pr where together or (j = i + 1 and doc_key not in (select doc_key from pr where together)))
  select doc_key, row_number() over (partition by doc_key order by i, j) - 1 as pos, src, dst from ch qualify pos < {graph.MAX_RELATIONS}""")
def graph_relations(spark: SparkSession, folder: str) -> DataFrame:
    return graph.relations(graph.entities(corpus(spark, folder))).withColumn("pos", F.col("pos").cast("bigint"))


DOC_GRAPH = f"""g as (select doc_key, max_by({{entities: entities, relations: relations}}, loaded_at) as g from corpus_graph group by doc_key),
  {terms_sql('doc_id', 'text', 'review_example', graph.FALLBACK_TERMS)},
  dg as (select doc_id, coalesce(nullif(list_filter(list_transform(coalesce(g.entities, []), lambda x: lower(x)), lambda x, i: x is not null and trim(x) <> '' and list_position(list_transform(g.entities, lambda y: lower(y)), x) = i), []),
         list_filter(list_transform(terms, lambda x: lower(x)), lambda x, i: list_position(list_transform(terms, lambda y: lower(y)), x) = i)) as entities,
         nullif(g.relations, []) as relations
         from (select doc_id, {sql(KEY, 'text')} as doc_key from review_example) left join g using (doc_key) join terms using (doc_id)),
  own as (select doc_id, unnest(entities) as entity from dg),
  idf as (select entity, count(*) as df, pow(greatest(ln(1 + (select count(*) from dg) / greatest(count(*), 0.5)::double), 1e-6), 0.25) as idf from own group by entity)"""


@query(f"with {DOC_GRAPH} select entity, df, round(idf, 6) as idf from idf")
def entity_idf(spark: SparkSession, folder: str) -> DataFrame:
    words = graph.vocabulary(graph.document_graph(corpus(spark, folder), table(spark, folder, "corpus_graph")))
    return words.select(F.col("name").alias("entity"), "df", F.round("idf", 6).alias("idf"))


EDGES = f"""one as (select lower(r.src) as u, lower(r.dst) as v from (select unnest(relations) as r from dg) where lower(r.src) in (select entity from idf) and lower(r.dst) in (select entity from idf)
    union all select a.e as u, b.e as v from (select doc_id, unnest(entities) as e, generate_subscripts(entities, 1) as i from dg where relations is null) a
      join (select doc_id, unnest(entities) as e, generate_subscripts(entities, 1) as i from dg where relations is null) b on a.doc_id = b.doc_id and b.i between a.i + 1 and a.i + {graph.WINDOW}),
  edge as (select u, v from one union select v, u from one)"""


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return pipeline.indexed(corpus(spark, folder), table(spark, folder, "corpus_graph"))


@query(f"with {DOC_GRAPH}, {EDGES} select u as entity, count(*) as neighbours from edge group by u")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    docs, words = _graph(spark, folder)
    found = graph.edges(docs).groupBy(F.col("u").alias("entity")).agg(F.count("*").alias("neighbours"))
    return found.join(words, "entity").select(F.col("name").alias("entity"), "neighbours")


REACH = f"""h1 as (select o.doc_id, e.v as entity, 1 as hop from own o join edge e on e.u = o.entity group by all),
  h2 as (select h.doc_id, e.v as entity, 2 as hop from h1 h join edge e on e.u = h.entity group by all),
  hops as (select doc_id, entity, min(hop) as hop from (select doc_id, entity, 0 as hop from own union all select * from h1 union all select * from h2) group by all),
  reach as (select doc_id, entity, hop, pow({graph.GAMMA}, hop) * idf as weight from hops join idf using (entity) qualify row_number() over (partition by doc_id order by round(pow({graph.GAMMA}, hop) * idf, 9) desc, entity) <= {graph.EXPANSION_CAP})"""


@query(f"with {DOC_GRAPH}, {EDGES}, {REACH} select doc_id, hop, count(*) as entities, round(sum(weight), 5) as weight from reach group by all")
def expansion_hops(spark: SparkSession, folder: str) -> DataFrame:
    docs, words = _graph(spark, folder)
    return graph.expansion(docs, words, graph.pairs(docs), summed=True).groupBy("doc_id", "hop").agg(F.sum("entities").alias("entities"), F.round(F.sum("weight"), 5).alias("weight"))


SUBGRAPH = f"""qd as (select qid, question from questions),
  qterms as (select qid, terms as own_terms from ({{terms}})),
  qe as (select qd.qid, coalesce(nullif(list_filter(coalesce(c.entities, []), lambda e: e is not null and trim(e) <> ''), []), own_terms)[1:{subgraph.MOST_TERMS}] as terms from qd left join query_cache c using (question) join qterms using (qid)),
  qx as (select qid, lower(unnest(terms)) as term, generate_subscripts(terms, 1) as pos from qe),
  qk as (select * from qx qualify row_number() over (partition by qid order by length(term) desc, pos) <= {subgraph.MAX_TERMS}),
  known as (select qid, pos, term, idf from qk join idf on idf.entity = term),
  offered as (select qid, sum(idf / least({subgraph.TOP_N}, greatest((select count(*) from idf), 1))) as offered from known group by qid),
  hit as (select qid, doc_id, sum(weight) as weight from known join reach on reach.entity = known.term group by all),
  sizes as (select doc_id, len(entities) as own from dg), lens as (select doc_id, count(*) as len from reach group by doc_id),
  sc as (select qid, hit.doc_id, greatest(weight / least(greatest(len, 1), {subgraph.TOP_N}) - {subgraph.ALPHA}::double * own, 0.0) / greatest(offered, 1e-9) as score from hit join lens using (doc_id) join sizes using (doc_id) join offered using (qid)),
  al as (select qid, doc_id, max(score) as score from (select * from sc union all select qid, doc_id, 0.0::double from (select distinct qid from qk), (select doc_id from review_example order by doc_id desc limit {{k}})) group by all),
  ranked as (select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id desc) as rank from al qualify rank <= {{k}}
    union all select qid, doc_id, 0.0::double, row_number() over (partition by qid order by doc_id) from (select qid from questions where qid not in (select qid from qk)), (select doc_id from review_example order by doc_id limit {{k}}))"""


def subgraph_ctes(k: int) -> str:
    inner_terms = "with " + terms_sql("qid", "question", "questions", subgraph.MOST_TERMS) + " select * from terms"
    return f"{ASKED}, {DOC_GRAPH}, {EDGES}, {REACH}, {SUBGRAPH.replace('{terms}', inner_terms).replace('{k}', str(k))}"


def _subgraph_sql(final: str) -> str:
    return f"with {subgraph_ctes(5)} {final}"


@query(_subgraph_sql("select qid, doc_id, round(score, 6) as score, rank from ranked"))
def subgraph_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs, words = _graph(spark, folder)
    ranked = subgraph.rank(docs, words, graph.expansion(docs, words, None, listed=True), asked(spark, folder), table(spark, folder, "query_cache"), 5)
    return ranked.withColumn("score", F.round("score", 6))


@query("with " + ASKED + f", {terms_sql('qid', 'question', 'questions', subgraph.MOST_TERMS)}, qe as (select questions.qid, coalesce(nullif(list_filter(coalesce(c.entities, []), lambda e: e is not null and trim(e) <> ''), []), terms)[1:{subgraph.MOST_TERMS}] as terms "
       f"from questions left join query_cache c using (question) join terms using (qid)), qx as (select qid, lower(unnest(terms)) as term, generate_subscripts(terms, 1) - 1 as pos from qe) "
       f"select qid, pos, term from qx qualify row_number() over (partition by qid order by length(term) desc, pos) <= {subgraph.MAX_TERMS}")
def query_graph_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return subgraph.query_terms(asked(spark, folder), table(spark, folder, "query_cache")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"select count(distinct k) as todo, count(distinct k) filter (cached) as done from (select {sql(KEY, 'text')} as k, {sql(KEY, 'text')} in (select doc_key from corpus_graph) as cached from review_example where text is not null)".replace("count(distinct k) as todo", "count(distinct k) filter (not cached) as todo"))
def cache_todo(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder).where("text is not null").select(X.cache_key("text").alias("doc_key"))
    cache = table(spark, folder, "corpus_graph").select("doc_key")
    todo = readers.not_cached(rows, cache, "doc_key").agg(F.count("*").alias("todo"))
    return todo.join(rows.join(cache, "doc_key", "left_semi").agg(F.count_distinct("doc_key").alias("done")))


# --- gold, samples, fingerprints --------------------------------------------------------------------------------------
@query("with " + ASKED + ", g as (select qid, unnest(gold) as d, generate_subscripts(gold, 1) as pos from questions), f as (select qid, d, min(pos) as pos from g where d in (select doc_id from review_example) group by all), "
       "l as (select qid, string_agg(d::varchar, '|' order by pos) as gold from f group by qid) select qid, gold from questions left join l using (qid)".replace("select qid, gold from questions", "select questions.qid, l.gold from questions"))
def gold_resolution(spark: SparkSession, folder: str) -> DataFrame:
    found = readers.valid_gold(asked(spark, folder), corpus(spark, folder))
    return found.select("qid", F.when(F.size("gold") > 0, F.array_join("gold", "|")).alias("gold"))


@query("with " + ASKED + ", n as (select count(*) // 4 as n from questions) select qid from questions order by md5('7:' || qid), qid limit (select n from n)")
def sample_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder)
    return readers.sample(rows, rows.count() // 4, 7).select("qid")


@query("with h as (select sha1(doc_id::varchar || ':' || sha1(coalesce(text, ''))) as h from review_example), a as (select left(h, 9) as node, sha1(string_agg(h, '' order by h)) as h from h group by 1), "
       "b as (select left(node, 6) as node, sha1(string_agg(h, '' order by h)) as h from a group by 1), c as (select left(node, 3) as node, sha1(string_agg(h, '' order by h)) as h from b group by 1) "
       "select sha1(string_agg(h, '' order by h)) as version from c")
def data_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return readers.fingerprint(corpus(spark, folder), "doc_id", "text")


@query("with p as (select doc_id as d, unnest(scenario_keywords) as t, generate_subscripts(scenario_keywords, 1) as i from review_example) select row_number() over (order by d, i) - 1 as doc_id, trim(t) as text from p where trim(t) <> ''")
def flatten_passages(spark: SparkSession, folder: str) -> DataFrame:
    return readers.flatten_passages(corpus(spark, folder), "scenario_keywords", "doc_id").select("doc_id", "text")


# --- metrics -----------------------------------------------------------------------------------------------------------
def _metric_sql(k: int) -> str:
    return f"""case when f{k} > 0 then 1.0::double / f{k} else 0 end as mrr_{k}, coalesce((f{k} > 0)::double, 0) as hit_{k}, coalesce(n{k}, 0)::double / greatest(len(gold), 1) as recall_{k}, coalesce(n{k}, 0)::double / {k} as precision_{k},
      case when len(gold) > 0 then coalesce(d{k}, 0) / list_sum(list_transform(range(0, least(len(gold), {k})), lambda i: 1.0::double / log2(i + 2))) else 0.0 end as ndcg_{k}, case when len(gold) > 0 then coalesce(m{k}, 0) / least(len(gold), {k}) else 0.0 end as map_{k}"""


def eval_ctes(ranked: str, by: str = "") -> str:
    """Metrics at 5 and 10 of a ranking (qid, doc_id, rank); ``by`` is a further column of the ranking, led by a comma."""
    per = ", ".join(f"min(rank) filter (h = 1 and rank <= {k}) as f{k}, sum(h) filter (rank <= {k}) as n{k}, sum(h / log2(rank + 1)) filter (rank <= {k}) as d{k}, sum(h * c::double / rank) filter (rank <= {k}) as m{k}" for k in (5, 10))
    methods = f"(select distinct {by.strip(', ')} from {ranked})" if by else ""
    return f"""gx as (select qid, unnest(gold) as d, generate_subscripts(gold, 1) as pos from questions), gu as (select distinct qid, d from gx where d in (select doc_id from review_example)),
  gl as (select questions.qid, hop_group{by}, coalesce(list(d) filter (d is not null), []) as gold from questions left join gu using (qid) {'cross join ' + methods if by else ''} group by all),
  hit as (select rk.qid, rank{by}, (gu.d is not null)::int as h from {ranked} rk left join gu on gu.qid = rk.qid and gu.d = rk.doc_id), run as (select *, sum(h) over (partition by qid{by} order by rank) as c from hit),
  per as (select qid{by}, {per} from run group by all),
  met as (select gl.qid, hop_group{by}, {_metric_sql(5)}, {_metric_sql(10)} from gl left join per using (qid{by}))"""


EVAL = f"with {bm25_ctes(10)}, {eval_ctes('ranked')}"
NAMES = [f"{m}_{k}" for k in (5, 10) for m in ("mrr", "hit", "recall", "precision", "ndcg", "map")]


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, hop_group, gold, topk) by BM25."""
    clauses, queries = corpus(spark, folder), asked(spark, folder)
    ranked = ranking.as_lists(bm25.rank(clauses, queries, 10))
    return queries.select("qid", "hop_group").join(readers.valid_gold(queries, clauses), "qid").join(ranked, "qid", "left")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("qid", "hop_group", *(c.alias(n) for k in (5, 10) for n, c in metrics.retrieval_metrics("topk", "gold", k).items()))


@query(EVAL + " select qid, " + ", ".join(f"round({m}, 6) as {m}" for m in NAMES) + " from met")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("qid", *(F.round(m, 6).alias(m) for m in NAMES))


@query(EVAL + " select hop_group, count(*) as num_queries, " + ", ".join(f"round(avg({m}) * 100, 6) as {m}" for m in NAMES) + " from met group by hop_group")
def metrics_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.averages(_judged(spark, folder), NAMES, ["hop_group"]).select("hop_group", "num_queries", *(F.round(m, 6).alias(m) for m in NAMES))


RECORD = [f"{m}_{k}" for k in (5, 10) for m in ("acc", "coverage", "precision", "mrr", "ndcg", "map", "ret_avg")]
RECORD_SQL = {f"{m}_{k}": f"{x}_{k}" for k in (5, 10) for m, x in (("acc", "hit"), ("coverage", "recall"), ("precision", "precision"), ("mrr", "mrr"), ("ndcg", "ndcg"), ("map", "map"))} | {f"ret_avg_{k}": f"(hit_{k} + mrr_{k} + ndcg_{k}) / 3" for k in (5, 10)}


@query(EVAL + " select qid, " + ", ".join(f"round({RECORD_SQL[m]}, 6) as {m}" for m in RECORD) + " from met")
def retrieval_records(spark: SparkSession, folder: str) -> DataFrame:
    columns = metrics.retrieval_record("topk", "gold", 5) | metrics.retrieval_record("topk", "gold", 10)
    return _found(spark, folder).select("qid", *(F.round(columns[m], 6).alias(m) for m in RECORD))


@query(EVAL + """, three as (select qid, min(rank) filter (h = 1) as f, sum(h) as n, sum(h / log2(rank + 1)) as d from run where rank <= 3 group by qid)
  select gl.qid, coalesce((f > 0)::double, 0) as acc_5, round(coalesce(n, 0)::double / greatest(len(gold), 1), 6) as coverage_5, round(case when f > 0 then 1.0::double / f else 0 end, 6) as mrr_5,
  round(case when len(gold) > 0 then coalesce(d, 0) / list_sum(list_transform(range(0, least(len(gold), 5)), lambda i: 1.0::double / log2(i + 2))) else 0.0 end, 6) as ndcg_5 from gl left join three using (qid)""")
def coverage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The three best clauses, listed twice: what comes again doesn't count."""
    rows = _found(spark, folder).withColumn("twice", F.concat(F.slice("topk", 1, 3), F.slice("topk", 1, 3)))
    return rows.select("qid", *(F.round(c, 6).alias(n) for n, c in metrics.coverage_metrics("twice", "gold", 5).items()))


@query(EVAL + """, gs as (select distinct gu.qid, spec_id from gu join review_example on doc_id = d where spec_id is not null), rs as (select distinct qid, spec_id from ranked join review_example using (doc_id) where rank <= 5),
  sp as (select distinct qid from gs join rs using (qid, spec_id))
  select met.qid, hit_5 as acc_5, round(recall_5, 6) as coverage_5, round(mrr_5, 6) as mrr_5, round(ndcg_5, 6) as ndcg_5, (sp.qid is not null)::double as spec_acc_5 from met left join sp on sp.qid = met.qid""")
def review_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _found(spark, folder)
    specs = corpus(spark, folder).select("doc_id", "spec_id")

    def of(column: str) -> DataFrame:
        return rows.select("qid", F.posexplode(column).alias("pos", "doc_id")).join(specs, "doc_id").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "spec_id"))), lambda x: x["spec_id"]).alias(f"{column}_specs"))

    rows = rows.join(of("topk"), "qid", "left").join(of("gold"), "qid", "left")
    return rows.select("qid", *(F.round(c, 6).alias(n) for n, c in metrics.review_metrics("topk", "gold", "topk_specs", "gold_specs", 5).items()))


BY_METHOD = f"""with {ASKED}, two as (select 'bm25' as method, qid, doc_id, rank from (with {bm25_ctes(10)} select * from ranked) union all select 'subgraph', qid, doc_id, rank from (with {subgraph_ctes(10)} select * from ranked)),
  {eval_ctes('two', ', method')}, rec as (select method, hop_group, {', '.join(f'{x} as {m}' for m, x in RECORD_SQL.items())} from met)"""
_MEANS = ", ".join(f"round(avg({m}) * 100, 5) as {m}" for m in RECORD)


@query(f"{BY_METHOD} select method, null::varchar as group_field, null::varchar as group_value, count(*) as num_queries, 0::bigint as num_with_prediction, {_MEANS} from rec group by method "
       f"union all select method, 'hop_group', coalesce(hop_group, 'None'), count(*), 0::bigint, {_MEANS} from rec group by method, hop_group")
def metrics_by_method(spark: SparkSession, folder: str) -> DataFrame:
    clauses, queries = pipeline.prepare(corpus(spark, folder), table(spark, folder, "benchmark_query"))
    found = pipeline.infer(clauses, queries, table(spark, folder, "corpus_graph"), table(spark, folder, "query_cache"))
    report = pipeline.evaluate(found)
    return report.select(*(F.round(c, 5).alias(c) if c in RECORD else c for c in report.columns))


@query()
def answers_by_method(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a stand-in model, and the whole report on them."""
    clauses, queries = pipeline.prepare(corpus(spark, folder), table(spark, folder, "benchmark_query"))
    config = pipeline.Config(methods=("bm25",), model=models.EchoModel)
    return pipeline.evaluate(pipeline.infer(clauses, queries, None, None, config), config)


@query()
def subgraph_semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """By vectors of hashes, which only tell equal names from others: similarities below 0.5 are chance."""
    config = pipeline.Config(top_k=5, least=0.5)
    ranked = pipeline.rank("semantic", corpus(spark, folder), asked(spark, folder), table(spark, folder, "corpus_graph"), table(spark, folder, "query_cache"), config)
    return ranked.withColumn("score", F.round("score", 5))


CASES = "cases as (select distinct qid, review_sentence, correct_sentence from review_case)"


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_case").select("qid", "review_sentence", "correct_sentence").distinct()


def _prf_sql(a: str, b: str) -> str:
    both = f"list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x)))))"
    return f"select qid, case when len({a}) > 0 and len({b}) > 0 then coalesce({both}, 0)::double / len({a}) else 0 end as p, case when len({a}) > 0 and len({b}) > 0 then coalesce({both}, 0)::double / len({b}) else 0 end as r"


F1 = "select qid, round(p, 6) as p, round(r, 6) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from m"


@query("with " + CASES + f", c as (select qid, regexp_extract_all({sql(NORMAL_CHARS, 'review_sentence')}, '.') as a, regexp_extract_all({sql(NORMAL_CHARS, 'correct_sentence')}, '.') as b from cases), m as (" + _prf_sql("a", "b") + " from c) " + F1)
def char_prf(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("qid", *(F.round(c, 6).alias(n) for n, c in metrics.char_prf("review_sentence", "correct_sentence").items()))


WORDS = "c as (select qid, list_filter(string_split(" + OFFICIAL.replace("{0}", "review_sentence") + ", ' '), lambda w: w <> '') as a, list_filter(string_split(" + OFFICIAL.replace("{0}", "correct_sentence") + ", ' '), lambda w: w <> '') as b from cases)"


@query("with " + CASES + ", " + WORDS + ", m as (" + _prf_sql("a", "b") + " from c) " + F1)
def token_prf(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("qid", *(F.round(c, 6).alias(n) for n, c in metrics.token_prf("review_sentence", "correct_sentence").items()))


@query("with " + CASES + ", " + WORDS + ", m as (" + _prf_sql("a", "b") + ", a, b from c) select qid, round(case when len(a) > len(b) then p else p * exp(1 - len(b)::double / greatest(len(a), 1)) end, 6) as bleu1 from m")
def bleu1(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("qid", F.round(metrics.bleu1("review_sentence", "correct_sentence"), 6).alias("bleu1"))


ANSWER = "trim(regexp_replace(lower(coalesce({0}, '')), " + q(f"[^0-9a-z{X.HAN}]+") + ", ' ', 'g'))"


@query("with " + CASES + f" select qid, ({ANSWER.replace('{0}', 'review_sentence')} = {ANSWER.replace('{0}', 'correct_sentence')})::double as exact_match from cases")
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("qid", metrics.exact_match("review_sentence", "correct_sentence").alias("exact_match"))


SPOKEN = ("gen_char_p", "gen_char_r", "gen_char_f1", "gen_token_p", "gen_token_r", "gen_token_f1", "gen_exact_match", "gen_bleu1")


@query("with " + CASES + f", c as (select qid, regexp_extract_all({sql(NORMAL_CHARS, 'review_sentence')}, '.') as a, regexp_extract_all({sql(NORMAL_CHARS, 'correct_sentence')}, '.') as b from cases), cm as (" + _prf_sql("a", "b") + " from c), cf as (" + F1.replace("from m", "from cm") + "), "
       + WORDS.replace("c as", "w as") + ", tm as (" + _prf_sql("a", "b") + ", a, b from w), tf as (" + F1.replace("from m", "from tm") + "), "
       + "bl as (select qid, round(case when len(a) > len(b) then p else p * exp(1 - len(b)::double / greatest(len(a), 1)) end, 6) as bleu1 from tm), "
       + f"em as (select qid, length(coalesce(review_sentence, '')) > 0 and length(coalesce(correct_sentence, '')) > 0 as judged, ({ANSWER.replace('{0}', 'review_sentence')} = {ANSWER.replace('{0}', 'correct_sentence')})::double as em from cases) "
       + "select qid, case when judged then cf.p end as gen_char_p, case when judged then cf.r end as gen_char_r, case when judged then cf.f1 end as gen_char_f1, case when judged then tf.p end as gen_token_p, case when judged then tf.r end as gen_token_r, case when judged then tf.f1 end as gen_token_f1, "
       + "case when judged then em end as gen_exact_match, case when judged then bleu1 end as gen_bleu1 from em join cf using (qid) join tf using (qid) join bl using (qid)")
def generation_records(spark: SparkSession, folder: str) -> DataFrame:
    columns = metrics.generation_record("review_sentence", "correct_sentence")
    return _cases(spark, folder).select("qid", *(F.round(columns[n], 6).alias(n) for n in SPOKEN))


@query()
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("qid", F.round(metrics.rouge_l("review_sentence", "correct_sentence"), 6).alias("rouge_l"))


@query()
def edit_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(spark, folder).select("qid", revision.edit_fragments("review_sentence", "correct_sentence").alias("fragments"))


@query()
def edit_payload_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "review_case").select("qid", "review_sentence", "correct_sentence", X.replacement_sentence("gold_answer", "review_sentence").alias("predicted")).distinct()
    return rows.select("qid", F.round(revision.edit_payload_f1("review_sentence", "predicted", "correct_sentence"), 6).alias("f1"))


@query()
def review_scores(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "review_case").select("qid", "review_sentence", "is_error", "correct_sentence", "gold_answer").distinct()
    rows = review.score_rows(cases.withColumn("prediction", F.col("gold_answer")))
    return rows.select("qid", "parsed", "kept_as_it_is", *(F.round(c, 6).alias(c) for c in ("edit_f1", "revision_char_f1", "answer_char_f1")))


@query()
def embedding_prf(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cases(spark, folder)
    sides = rows.select("qid", F.lit("p").alias("side"), F.explode(X.revision_chunks("review_sentence")).alias("text")).unionByName(rows.select("qid", F.lit("r").alias("side"), F.explode(X.revision_chunks("correct_sentence")).alias("text")))
    vectors = sides.join(models.encoded(sides, "text"), "text").groupBy("qid").agg(*(F.collect_list(F.when(F.col("side") == s, F.col("embedding"))).alias(f"side_{s}") for s in ("p", "r")))
    return vectors.select("qid", *(F.round(c, 5).alias(n) for n, c in revision.embedding_prf(F.col("side_p"), F.col("side_r")).items()))


GROUPS = UNIT + ", g as (select doc_id // 20 as g, doc_id % 20 as k, e from v)"


@query("with " + GROUPS + """, s as (select a.g, a.k as x, b.k as y, greatest(list_inner_product(a.e, b.e), 0) as sim from g a join g b on a.g = b.g and a.k < 10 and b.k >= 10),
  p as (select g, avg(m) as p from (select g, x, max(sim) as m from s group by all) group by g), r as (select g, avg(m) as r from (select g, y, max(sim) as m from s group by all) group by g)
  select g as qid, round(p, 5) as p, round(r, 5) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 5) as f1 from p join r using (g)""")
def vector_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of 20 neighbouring vectors: ten as chunks of a prediction, ten as those of the reference."""
    rows = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("qid"), (F.col("vec_id") % 20 < 10).alias("side"), dense.normalized(F.col("embedding")).alias("e"))
    both = rows.groupBy("qid").agg(F.collect_list(F.when(F.col("side"), F.col("e"))).alias("a"), F.collect_list(F.when(~F.col("side"), F.col("e"))).alias("b"))
    return both.select("qid", *(F.round(c, 5).alias(n) for n, c in revision.embedding_prf(F.col("a"), F.col("b")).items()))


@query("with " + GROUPS + """, t as (select a.g, list_transform(range(1, len(a.e) + 1), lambda i: b.e[i] - a.e[i]) as p, list_transform(range(1, len(a.e) + 1), lambda i: c.e[i] - a.e[i]) as r from g a join g b on b.g = a.g and b.k = 1 join g c on c.g = a.g and c.k = 2 where a.k = 0),
  n as (select g, sqrt(list_inner_product(p, p)) as np, sqrt(list_inner_product(r, r)) as nr, least(greatest(list_inner_product(p, r) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(r, r))), 0), 1) as alike from t),
  m as (select g as qid, alike * least(1, nr / np) as p, alike * least(1, np / nr) as r from n) select qid, round(p, 5) as p, round(r, 5) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 5) as f1 from m""")
def vector_delta_prf(spark: SparkSession, folder: str) -> DataFrame:
    """The first three of 20 neighbouring vectors as a sentence, its predicted and its right revision."""
    rows = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("qid"), (F.col("vec_id") % 20).alias("k"), dense.normalized(F.col("embedding")).alias("e"))
    three = rows.where("k < 3").groupBy("qid").agg(*(F.max(F.when(F.col("k") == k, F.col("e"))).alias(n) for k, n in enumerate("opr")))
    three = three.where("o is not null and p is not null and r is not null")
    return three.select("qid", *(F.round(c, 5).alias(f"v_{n}") for n, c in revision.delta_embedding_prf(F.col("o"), F.col("p"), F.col("r")).items())).toDF("qid", "p", "r", "f1")


# --- evidence ------------------------------------------------------------------------------------------------------------
def _evidence(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    clauses, queries = corpus(spark, folder), asked(spark, folder)
    return queries.join(evidence.gathered(bm25.rank(clauses, queries, k), clauses, k), "qid", "left")


HIT = "'[' || rank || '] ' || coalesce(spec_name, spec_id, '') || ' 第' || coalesce(clause, '') || '条' || chr(10) || left(" + sql(SPACE, "split_part(text, " + q(X.COMMENTARY) + ", 1)") + f", {X.CLAUSE_CHARS})"


@query(f"with {bm25_ctes(5)} select qid, string_agg({HIT}, chr(10) || chr(10) order by rank) as block from ranked join review_example using (doc_id) group by qid")
def evidence_block(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder).select("qid", evidence.block(F.col("hits")).alias("block"))


GROUPED = "case when len(regexp_extract_all(coalesce(clause, ''), '[0-9]+')) >= 2 then spec_id || ':' || regexp_extract_all(clause, '[0-9]+')[1] || '.' || regexp_extract_all(clause, '[0-9]+')[2] when len(regexp_extract_all(coalesce(clause, ''), '[0-9]+')) = 1 then spec_id || ':' || regexp_extract_all(clause, '[0-9]+')[1] else spec_id end"


@query(f"""with {bm25_ctes(5)}, h as (select qid, rank, {HIT} as hit, count(*) over (partition by qid, {GROUPED}) as same from ranked join review_example using (doc_id)),
  b as (select qid, string_agg(hit, chr(10) || chr(10) order by rank) as block, coalesce(string_agg('[' || rank || ']', ' ' order by rank) filter (same >= 2), '') as marks from h group by qid)
  select qid, '问题：' || chr(10) || question || chr(10) || chr(10) || '证据：' || chr(10) || block || case when marks <> '' then chr(10) || chr(10) || '同组条文：' || marks else '' end || chr(10) || chr(10) || '请依据证据作答，逐字引用至少一处原文，101至300字。' as prompt from questions join b using (qid)""")
def answer_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder).select("qid", evidence.answer_prompt(F.col("question"), F.col("hits")).alias("prompt"))


@query(f"""with {bm25_ctes(5)}, ev as (select qid, list({sql(SPAN, 'text')}) as spans from ranked join review_example using (doc_id) group by qid),
  a as (select questions.qid, coalesce(answer, '') as answer, list_transform(regexp_extract_all(coalesce(answer, ''), {q(X.QUOTED)}, 1), lambda x: {sql(SPAN, 'x')}) as quotes, spans from questions left join ev using (qid))
  select qid, case when length(answer) < {evidence.SHORTEST} then 'short' when length(answer) > {evidence.LONGEST} then 'long' when {' or '.join(f"contains(answer, {q(r)})" for r in evidence.REFUSALS)} then 'refusal'
  when len(spans) > 0 and len(quotes) = 0 then 'no quote' when len(spans) > 0 and len(list_filter(quotes, lambda x: len(list_filter(spans, lambda s: contains(s, x))) = 0)) > 0 then 'not verbatim' else 'ok' end as validity from a""")
def answer_validity(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.transform(F.coalesce("hits", F.expr("array()")), lambda h: h["text"])
    return _evidence(spark, folder).select("qid", evidence.validity(F.coalesce("answer", F.lit("")), texts).alias("validity"))


@query()
def repaired_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _evidence(spark, folder).select("qid", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), F.transform("hits", lambda h: h["text"]).alias("texts"))
    rows = rows.withColumn("quote", evidence.best_quote(F.concat("question", "answer"), F.col("texts")))
    return rows.select("qid", "quote", evidence.repaired(F.col("answer"), F.col("question"), F.col("texts"), quote=F.col("quote")).alias("repaired"))


# --- replies as JSON: made from the extraction table ---------------------------------------------------------------------
@query("select doc_key, loaded_at, least(len(list_distinct(list_filter(list_transform(coalesce(entities, []), lambda e: trim(e)), lambda e: e is not null and length(e) between 2 and 79))), 24)::bigint as entities, "
       "least(len(list_filter(coalesce(relations, []), lambda r: trim(r.src) <> '' and trim(r.dst) <> '')), 16)::bigint as relations from corpus_graph")
def graph_json_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corpus_graph").select("doc_key", "loaded_at", F.to_json(F.struct(F.col("entities"), F.transform("relations", lambda r: F.array(r["src"], r["dst"])).alias("relations"))).alias("reply"))
    return rows.select("doc_key", "loaded_at", json_repair.reply_graph(F.concat(F.lit("```json\n"), "reply", F.lit("\n```"))).alias("g")).select("doc_key", "loaded_at", F.size("g.entities").cast("bigint").alias("entities"), F.size("g.relations").cast("bigint").alias("relations"))


def _listed(spark: SparkSession, folder: str, reply: Callable) -> DataFrame:
    rows = table(spark, folder, "corpus_graph").select("doc_key", "loaded_at", F.coalesce("entities", F.array().cast("array<string>")).alias("e"), F.coalesce("relations", F.expr("array()")).alias("r"))
    return rows.select("doc_key", "loaded_at", reply(rows).alias("reply"))


ROW_LINES = "list_transform(string_split(trim(reply), chr(10)), lambda x: trim(regexp_replace(trim(x), '^(?:[-*•·]|[0-9]{1,3}[.)、])[ \\t]*', '')))"


@query(f"with a as (select doc_key, loaded_at, coalesce(list_aggregate(list_transform(list_filter(entities, lambda e: e is not null), lambda e: '- ' || e), 'string_agg', chr(10)), '') as reply from corpus_graph) "
       f"select doc_key, loaded_at, len(list_distinct(list_filter({ROW_LINES}, lambda x: length(x) between 2 and 59)))::bigint as lines from a")
def reply_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _listed(spark, folder, lambda _: F.array_join(F.transform(F.filter("e", lambda e: e.isNotNull()), lambda e: F.concat(F.lit("- "), e)), "\n"))
    return rows.select("doc_key", "loaded_at", F.size(json_repair.reply_lines(F.col("reply"))).cast("bigint").alias("lines"))


@query()
def json_repair_replies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corpus_graph").select("doc_key", "loaded_at", F.to_json(F.struct("entities", "relations")).alias("reply"))
    broken = F.regexp_replace("reply", '","', '" "')  # as if the model had left out commas
    return rows.select("doc_key", "loaded_at", json_repair.reply_object(broken).alias("object"))
