from pyspark.sql import functions as F

from rillgraph.functions import json_repair
from rillgraph.functions import text as X


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values)], schema).select(column).first()[0]


def test_space_and_keys(spark):
    assert one(spark, X.normalize_space("c0"), " a 　b\n\tc ") == "a b c"
    assert one(spark, X.normalize_space("c0"), None) == ""
    assert one(spark, X.cache_key("c0"), "a  b") == one(spark, X.cache_key("c0"), " a b ")
    assert one(spark, X.normalized_chars("c0"), "Ab-1 钢。") == "ab1钢"
    assert one(spark, X.safe_name("c0"), "/a b:c/") == "a_b_c"


def test_tokens(spark):
    assert one(spark, X.bm25_tokens("c0"), "The C30 concrete 混凝土强度, of x/y.") == ["c30", "concrete", "混凝土强度", "x/y."]
    assert one(spark, X.graph_tokens("c0"), "It's Bolted. ab") == ["it's", "bolted"]
    assert one(spark, X.entity_key("c0"), " -Shear  Stud. ") == "shear stud"
    assert one(spark, X.sentences("c0"), "A b. C d!  E") == ["A b.", "C d!", "E"]
    assert one(spark, X.bm25_tokens("c0"), None) == []


def test_terms_keep_the_first_of_equal_ones(spark):
    assert one(spark, X.extract_terms("c0"), "Shear Stud welds shear stud") == ["Shear Stud", "shear", "stud", "welds", "stud welds", "welds shear"]
    assert one(spark, X.extract_terms("c0", 2), "混凝土 钢筋 模板") == ["混凝土", "钢筋"]
    assert one(spark, X.extract_terms("c0"), "") == []


def test_questions_clauses_and_markers(spark):
    assert tuple(one(spark, X.split_question("c0"), "ctx\r\n\r\nask")) == ("ctx", "ask")
    assert tuple(one(spark, X.split_question("c0"), "ask")) == ("", "ask")
    assert one(spark, X.clause_group("c0", "c1"), "GB1", "5.3.2") == "GB1:5.3"
    assert one(spark, X.clause_group("c0", "c1"), "GB1", "附录") == "GB1"
    assert one(spark, X.direct_clause_text("c0"), "a  b▼ c") == "a b"
    text = "[DOCID:1] x [DOCID:0] [DOCID:9] [DOCID:1]"
    assert one(spark, X.parse_document_ids("c0", 2), text) == [1, 0]
    assert one(spark, X.parse_document_ids("c0", 2, 1), text) == [1]


def test_reviews(spark):
    assert one(spark, X.has_error("c0"), "修改建议：无错误。") is False
    assert one(spark, X.has_error("c0"), "修改建议：建议改为：“乙”") is True
    assert one(spark, X.has_error("c0"), "没有说法") is None
    assert one(spark, X.replacement_sentence("c0", "c1"), "修改建议：建议改为：“乙 丙。”", "甲") == "乙 丙"
    assert one(spark, X.replacement_sentence("c0", "c1"), "修改建议：无错误", " 甲 ") == "甲"
    assert one(spark, X.replacement_sentence("c0", "c1"), "无", "甲") == ""
    assert one(spark, X.revision_chunks("c0"), "甲。乙；丙") == ["甲", "乙", "丙"]
    assert one(spark, X.quoted_spans("c0"), "用“甲”和\"乙\"") == ["甲", "乙"]
    assert one(spark, X.official_normalize("c0"), "The a an CAT, sat!") == "cat sat"


def test_json_replies(spark):
    good = '```json\n{"entities": ["a b", "x", "a b"], "relations": [["a", "b"], ["c"]]}\n```'
    found = one(spark, json_repair.reply_graph(F.col("c0")), good)
    assert found.entities == ["a b"] and [tuple(r) for r in found.relations] == [("a", "b")]
    assert json_repair.parse_object('x {"a": "b\\q"} y') == '{"a":"b\\\\q"}'
    assert json_repair.parse_object('{"a": 1 "b": 2}') == '{"a":1,"b":2}'
    assert json_repair.parse_object('[{"a": 1}]') == '{"items":[{"a":1}],"repaired":true}'
    assert json_repair.parse_object("no") is None and json_repair.parse_object(None) is None
    assert one(spark, json_repair.reply_object("c0"), '{"a": ["x" "y"]}') == '{"a":["x","y"]}'


def test_listed_replies(spark):
    lines = "```\n- a b\n2. 混凝土\n* a b\nx\n" + "y" * 60 + "\n```"
    assert one(spark, json_repair.reply_lines(F.col("c0")), lines) == ["a b", "混凝土"]
    assert [tuple(p) for p in one(spark, json_repair.reply_pairs(F.col("c0")), "- a | b\nc|\nd | e | f\nplain")] == [("a", "b"), ("d", "e")]
    numbered = '{"entities": ["0a", "1b", "2c", "M3"]}'
    assert one(spark, json_repair.reply_graph(F.col("c0")), numbered).entities == ["0a", "1b", "2c", "M3"]
    assert one(spark, json_repair.reply_graph(F.col("c0"), text=F.lit("Shear stud")), "no json").entities == ["Shear", "stud", "shear stud"]
    assert one(spark, json_repair.reply_graph(F.col("c0"), text=F.lit("混凝土")), '{"entities": []}').entities == ["混凝土"]
    assert one(spark, json_repair.reply_object("c0"), '{"b": 1.50, "a": "x\\n"}') == '{"b":1.50,"a":"x\\n"}' or one(spark, json_repair.reply_object("c0"), '{"b": 1.50, "a": "x\\n"}') == '{"b":1.5,"a":"x\\n"}'


def test_many_terms_of_a_long_text(spark):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17000))
    found = one(spark, X.extract_terms("c0", 64), text)
    assert len(found) == len({t.lower() for t in found}) == 64 and found[:2] == ["wordaaa", "wordbaa"]


def test_phrases_begin_words(spark):
    assert one(spark, X.proper_phrases("c0"), "钢Beam Éclat The Shear Stud of Steel. aBolt") == ["The Shear Stud of Steel."]
