import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.llm import format_dups, forms, leaks, mixture, near_dups, pieces, quality, same_look, terms

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BASE = "碾压机具离预制钢柱脚的净距取五组与九层的较大值，设计代表全程值守。采用级碎石的高支模防火隔墙，含泥量测定结果存疑时应暂缓锚固。夯实顺序宜由幕墙立柱向内嵌管道支架推进。"


def frame(spark, rows, parts=3):
    """Texts with extra columns whose names the operators use inside."""
    full = [(i, t, 1, "x", 2) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, rid int, content string, salt int").repartition(parts)


def review(spark, tables):
    return spark.read.parquet(f"{tables}/review_example.parquet")


def texts_of(df, least=40):
    return [(r.doc_id, r.text, c) for r in df.select("doc_id", "text").collect() if r.text is not None and len(c := forms.content(r.text)) >= least]


def test_same_look_against_all_pairs(spark, tables):
    df = review(spark, tables)
    by = collections.defaultdict(list)
    for i, t, _ in texts_of(df):
        by[forms.consistent(t)].append((i, t))
    want = {(min(a, b), max(a, b)) for g in by.values() for a, x in g for b, y in g if a < b and x != y}
    got = [(r.doc_id_a, r.doc_id_b) for r in same_look.lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_same_look_classes(spark, tables):
    df = review(spark, tables)
    by = collections.defaultdict(list)
    for i, t, _ in texts_of(df):
        by[forms.consistent(t)].append((i, t))
    want = {i: (min(g)[0], len({t for _, t in g})) for g in by.values() for i, _ in g}
    assert {r.doc_id: (r.class_id, r.spellings) for r in same_look.lookalike_classes(df).collect()} == want
    assert same_look.lookalike_classes(df.limit(0)).count() == 0


def test_cut_texts_by_sql(spark, tables):
    import duckdb

    from rillgraph.llm import catalogue

    c = duckdb.connect()
    c.execute(f"create view review_example as select * from '{tables}/review_example.parquet'")
    assert sorted(map(tuple, catalogue.p5_found(spark, tables).collect())) == sorted(c.execute(catalogue.SQL["p5_found"]).fetchall())


def test_same_look_edges(spark):
    df = frame(spark, [(0, BASE), (1, BASE), (2, BASE.replace("，", ",")), (3, None), (4, ""), (None, BASE), (5, "短，"), (6, "短,")])
    assert {(r.doc_id_a, r.doc_id_b) for r in same_look.lookalike_pairs(df).collect()} == {(0, 2), (1, 2)}
    assert same_look.lookalike_pairs(df.limit(0)).count() == 0
    assert [r[0] for r in df.where("doc_id in (3, 5)").orderBy("doc_id").select(same_look.consistent_form("text")).collect()] == [None, "短,"]
    cases = spark.createDataFrame([("a", "x，", "x,"), ("a", "x，", "x,"), ("b", "x", "x"), ("c", None, "x"), ("d", "x", "y")], "qid string, review_sentence string, correct_sentence string")
    assert [r.qid for r in same_look.lookalike_cases(cases).collect()] == ["a"]


def test_short_texts_of_long_content(spark):
    """30 stored characters whose content string has 60."""
    df = frame(spark, [(0, "㎏" * 30), (1, "kg" * 30), (2, "短" * 30)])
    assert {(r.doc_id_a, r.doc_id_b) for r in same_look.lookalike_pairs(df).collect()} == {(0, 1)}
    assert {r.doc_id: r.copies for r in format_dups.records(df).collect()} == {0: 2}


def jaccard(a, b):
    g, h = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(g & h) / len(g | h)


@pytest.mark.parametrize("hot", [None, 3])
def test_near_dups_against_all_pairs(spark, tables, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(near_dups, "HOT", hot)
    df = review(spark, tables)
    rows = texts_of(df)
    want = {(min(a, b), max(a, b)) for k, (a, _, x) in enumerate(rows) for b, _, y in rows[k + 1 :] if x != y and 0.7 <= len(x) / len(y) * 2 and jaccard(x, y) >= 0.7}
    texts = near_dups.classes(near_dups.stored(df))
    pairs = near_dups.class_pairs(texts, hot=hot or near_dups.HOT)
    first = {r.rid: r.content for r in texts.collect()}
    got = {frozenset((first[r.a], first[r.b])) for r in pairs.collect()}
    contents = {i: c for i, _, c in rows}
    assert got == {frozenset((contents[a], contents[b])) for a, b in want} and want
    if not hot:
        found = [(r.doc_id_a, r.doc_id_b) for r in near_dups.found(df).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_groups(spark, tables):
    df = review(spark, tables)
    contents = {i: c for i, _, c in texts_of(df)}
    parent = {i: i for i in contents}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, c in sorted(contents.items()):
        parent[i] = first.setdefault(c, i)
    links = collections.Counter()
    pairs = {frozenset((first[contents[r.doc_id_a]], first[contents[r.doc_id_b]])) for r in near_dups.found(df).collect()}
    for a, b in map(sorted, pairs):
        links.update((a, b))
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: (r.class_id, r.group_id, r.links) for r in near_dups.groups(df).collect()}
    assert got == {i: (first[c], top(i), links[first[c]]) for i, c in contents.items()}


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.rid: r.label for r in near_dups.components(chain).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert near_dups.components(chain.limit(0)).count() == 0


def test_near_dups_edges(spark):
    other = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    df = frame(spark, [(0, BASE), (1, BASE), (2, BASE.replace("五组", "六组")), (3, None), (4, ""), (None, BASE), (5, other), (6, BASE.replace("，", " , "))])
    assert {(r.doc_id_a, r.doc_id_b) for r in near_dups.found(df).collect()} == {(0, 2), (1, 2), (2, 6)}
    assert near_dups.found(df.limit(0)).count() == 0


def test_near_dups_shared_paragraph(spark):
    """Many texts that share a paragraph, none similar enough: the shared signatures are split, not paired."""
    rng = random.Random(3)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    shared = word(60)
    rows = [(i, shared + word(60)) for i in range(300)]
    rows.append((300, rows[7][1].replace(rows[7][1][70:72], "甲乙")))
    texts = near_dups.classes(near_dups.stored(frame(spark, rows)))
    first = {r.rid: r.first_doc_id for r in texts.collect()}
    assert [{first[r.a], first[r.b]} for r in near_dups.class_pairs(texts, hot=20).collect()] == [{7, 300}]


def test_near_dups_of_crowded_boilerplate(spark, monkeypatch):
    """Texts that share boilerplate: what stays crowded is filtered before pairs are made, and no match is lost."""
    monkeypatch.setattr(near_dups, "BLOCK", 50, raising=False)
    rng = random.Random(8)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    shared = word(70)
    rows = [(i, shared + word(50)) for i in range(400)]
    rows += [(400 + i, rows[i][1][:-8] + word(8)) for i in range(60)]
    texts = near_dups.classes(near_dups.stored(frame(spark, rows)))
    first = {r.rid: r.first_doc_id for r in texts.collect()}
    assert {frozenset((first[r.a], first[r.b])) for r in near_dups.class_pairs(texts, hot=20).collect()} == {frozenset((i, 400 + i)) for i in range(60)}
    crowded = texts.select("rid", F.lit(1).cast("bigint").alias("above"))
    twice = crowded.union(crowded.select("rid", F.lit(2).cast("bigint")))
    crowds = near_dups._crowds(twice)
    got = [(r.a, r.b) for r in near_dups._in_blocks(twice, crowds, texts, 0.7).collect()]
    assert crowds.count() == 1 and len(got) == len(set(got)) < 20_000  # of 105,570
    assert {frozenset((first[a], first[b])) for a, b in got} >= {frozenset((i, 400 + i)) for i in range(60)}


def test_near_dups_where_all_texts_are_alike(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        cut = rng.randrange(10, 70)
        rows.append((i, BASE[:cut] + chr(0x5000 + i) + BASE[cut:]))
    rows += [(60 + i, "".join(chr(0x6000 + rng.randrange(4000)) for _ in range(60))) for i in range(40)]
    contents = {i: forms.content(t) for i, t in rows}
    want = {(a, b) for a in contents for b in contents if a < b and jaccard(contents[a], contents[b]) >= 0.7}
    got = [(r.doc_id_a, r.doc_id_b) for r in near_dups.found(frame(spark, rows)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 1000


@pytest.mark.parametrize("length, rare, share", [(200, 6, 4), (150, 5, 3), (150, 6, 5), (260, 8, 4), (330, 10, 3)])
def test_near_dups_with_rare_characters_in_a_large_cluster(spark, length, rare, share):
    """A part of the rows has one text, each with rare characters of its own: its telling lines are those that no other row has."""
    rng = random.Random(7)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(n))
    base, texts = word(length), []
    for _ in range(400 // share):
        own = list(base)
        for k in rng.sample(range(length // 4), rare):
            own[4 * k] = chr(0x8000 + rng.randrange(10000))
        texts.append("".join(own))
    texts += [word(rng.randrange(length // 2, 2 * length)) for _ in range(400 - len(texts))]
    # the cluster's share is the same in a collection of 300,000 texts, where unrelated lines need more bits
    bits = near_dups.rarity(spark.createDataFrame([(t,) for t in texts], "content string"), len(texts)).astype(int)
    bits = np.where(bits >= 8 * 7, 8 * 18, bits).astype(np.uint8)
    number, signature = near_dups.signatures(texts, near_dups.Bands(0.7, 300_000, bits))
    held = [set(signature[number == i].tolist()) for i in range(400 // share)]
    pairs = [(i, j) for i in range(len(held)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.7]
    assert len(pairs) > 20 and all(held[i] & held[j] for i, j in pairs)


def test_verification_and_sketch():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 60))) for _ in range(200)]
    pairs = list(zip(texts, texts[1:]))
    both, n, m = near_dups.shared_features(pairs)
    sizes, bits = near_dups.sketch(texts)
    for k, (a, b) in enumerate(pairs):
        g, h = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
        assert (both[k], n[k], m[k]) == (len(g & h), len(g), len(h))
        apart = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(bits[k], bits[k + 1]))
        assert apart <= len(g ^ h)


def test_format_dups(spark, tables):
    df = review(spark, tables)
    by = collections.defaultdict(list)
    for i, _, c in texts_of(df):
        by[c].append(i)
    want = {(min(g), i) for g in by.values() for i in g if i != min(g)}
    got = [(r.first_doc_id, r.doc_id) for r in format_dups.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {r.doc_id: r.copies for r in format_dups.records(df).collect()} == {min(g): len(g) for g in by.values()}


def test_format_dups_edges(spark, monkeypatch):
    df = frame(spark, [(i, BASE) for i in range(50)] + [(60, BASE + "甲"), (61, None), (62, ""), (None, BASE)], 5)
    assert {r.doc_id: r.copies for r in format_dups.records(df).collect()} == {0: 50, 60: 1}
    assert format_dups.records(df.limit(0)).count() == 0 and format_dups.found(df.limit(0)).count() == 0
    # many segments in several groups
    monkeypatch.setattr(format_dups, "SEGMENT_BITS", 1 << 5)
    monkeypatch.setattr(format_dups, "GROUP", 3)
    assert {r.doc_id: r.copies for r in format_dups.records(df).collect()} == {0: 50, 60: 1}


def test_share_of_singletons_let_through_is_the_same_at_every_size(spark, monkeypatch):
    """Random hashes in place of texts: few singletons pass whether the filter has one segment or hundreds, and no repeat is missed."""
    monkeypatch.setattr(format_dups, "SEGMENT_BITS", 1 << 13)
    hashes = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"))
    for n in (500, 100_000):
        keys = hashes(n).union(hashes(n // 10)).repartition(6)
        monkeypatch.setattr(format_dups, "content_keys", lambda *_, keys=keys: keys)
        marked = format_dups.marked_keys(keys)
        passed = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("maybe_repeated").alias("maybe"), F.min("maybe_repeated").alias("all")).collect()
        assert all(r["all"] for r in passed if r.n == 2) and len(passed) == n
        assert sum(r.maybe for r in passed if r.n == 1) < 0.04 * n


def test_terms(spark, tables):
    df = review(spark, tables).repartition(5)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.text is not None]
    occurrences, records = collections.Counter(), collections.Counter()
    for _, t in rows:
        occurrences.update(found := terms.text_terms(t))
        records.update(set(found))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.text_frequencies(df).collect()}
    mark = lambda n: "rare" if n <= 2 else "common" if n > len(rows) / 10 else None
    assert got == {t: (occurrences[t], records[t], mark(records[t])) for t in occurrences}


def test_terms_edges(spark):
    assert terms.text_terms("Ｃ30 混凝土 é1 2024 m³ kΡa") == ["c30", "é1", "m", "kpa", "混凝", "凝土"]
    df = frame(spark, [(0, "甲乙"), (0, "甲乙"), (None, "甲乙"), (70_000, "甲乙 甲乙"), (1, ""), (2, None)])
    row = terms.text_frequencies(df).where("term = '甲乙'").first()
    assert (row.occurrences, row.records) == (5, 3)
    assert terms.text_frequencies(df.limit(0)).count() == 0
    import numpy as np

    for positions in (np.arange(10, dtype=np.uint16), np.arange(0, 65_536, 3, dtype=np.uint16)):
        assert (terms.unpack(terms.pack(positions)) == positions).all() and len(terms.pack(positions)) <= 8193
    graph = spark.createDataFrame([("k", ["A", "a ", None, " "], 2), ("k", ["old"], 1), ("l", None, 1)], "doc_key string, entities array<string>, loaded_at int")
    assert [(r.term, r.occurrences, r.records, r.mark) for r in terms.entity_frequencies(graph).collect()] == [("a", 2, 1, "rare")]


def nodes_of(text, node):
    yield node
    for child in pieces.children(text, node):
        yield from nodes_of(text, child)


MARKED = ["# 一\n", "## 二\n", "#### 三\n", "第2节 施工\n", "1.2 范围\n", "- 甲\n", "  - 乙\n", "（3）丙\n", "\n", "| a | b |\n", "```\n", "<div>\n", "</div>\n", "甲。乙；", "word ", "\r\n", "x" * 9, "y" * 30, "z" * 37, "w" * 50, "。”", "  more\n"]


def test_pieces_give_the_text_back():
    rng = random.Random(0)
    for _ in range(1500):
        text = "".join(rng.choice(MARKED) for _ in range(rng.randrange(30)))
        tree = pieces.parse(text)
        for node in nodes_of(text, tree):
            inner = pieces.children(text, node)
            assert not inner or [node.start, *(c.end for c in inner)] == [*(c.start for c in inner), node.end]
        found = pieces.pieces(text, 40, 8)
        ends_at = [0, *(start + len(p) for start, p, _ in found)]
        assert all(b - start == min(8, b) for b, (start, *_) in zip(ends_at, found))  # what a piece repeats
        own = [p[b - start :] for b, (start, p, _) in zip(ends_at, found)]
        assert "".join(own) == text and all(len(p) <= 40 for _, p, _ in found)
        assert not text or all(own)
        cut = set(np.cumsum([len(p) for p in own])[:-1].tolist())
        # no node is cut that fits into a piece, and none but words too large are cut anywhere
        assert not any(n.start < c < n.end for n in nodes_of(text, tree) if n.end - n.start <= 32 for c in cut)
        ends = {n.end for n in nodes_of(text, tree)}
        at = 0
        for part, (*_, boundary) in zip(own[:-1], found):
            at += len(part)
            assert (at in ends) == (boundary not in ("none", "overlap"))
        hard = len(max(re.split(r"[\s。！？；.!?;]", text), key=len)) > 40
        assert hard == any(b == "none" for *_, b in found)


def test_pieces_follow_the_tree():
    para = lambda c, n: c * n + "。\n"
    text = "# A\n" + para("甲", 20) + "## B\n" + para("乙", 10) + "## C\n" + para("丙", 10) + "# D\n" + para("丁", 25)
    found = pieces.pieces(text, 40, 0)
    assert [p for _, p, _ in found] == ["# A\n" + para("甲", 20), "## B\n" + para("乙", 10) + "## C\n" + para("丙", 10), "# D\n" + para("丁", 25)]
    assert {b for *_, b in found[:-1]} == {"section"}
    # an item stays with the items below it
    text = "- a\n  - b b b b\n  - c c c c\n- d\n  - e e e e\n  - f f f f\n"
    assert [p for _, p, _ in pieces.pieces(text, 40, 0)] == [text[: text.index("- d")], text[text.index("- d") :]]
    # rows of a table, a block of code
    text = "说明。\n\n" + "| a | b |\n" * 3 + "\n```\nx = 1\n\n# no heading\n```\n"
    assert [p for _, p, _ in pieces.pieces(text, 40, 0)][-1] == "```\nx = 1\n\n# no heading\n```\n"
    assert [b for *_, b in pieces.pieces("甲" * 30 + "。" + "乙" * 30 + "。", 40, 8)] == ["sentence", "end"]
    assert [b for *_, b in pieces.pieces("甲" * 30 + "。" + "乙" * 38 + "。", 40, 8)] == ["sentence", "overlap", "end"]


def test_pieces_of_deeply_nested_text():
    deep = "".join("<div>\n" + " " * i + "- x\n" for i in range(3000)) + "</div>\n" * 3000
    found = pieces.pieces(deep)
    assert "".join(p[b - start :] for b, (start, p, _) in zip([0, *(s + len(p) for s, p, _ in found)], found)) == deep


def test_pieces_table(spark):
    df = frame(spark, [(0, "x" * 2000), (1, None), (2, ""), (3, "𥐻" * 800), (4, ("句子。" * 300))])
    got = collections.Counter((r.doc_id, r.kind) for r in pieces.split(df).collect())
    assert got[0, "hard"] == 3 and got[2, "natural"] == 1 and got[3, "natural"] == 1 and got[4, "natural"] == 2 and 1 not in dict(got)
    assert {(r.doc_id, r.kind) for r in pieces.found(df).collect()} == {(0, "hard"), (4, "natural")}


def test_leaks(spark, tables):
    docs, items = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "eval_item"))
    index = collections.defaultdict(set)
    for r in items.collect():
        c = forms.content(r.text, records=False)
        for k in range(len(c) - 49):
            index[c[k : k + 50]].add(r.item_id)
    want = set()
    for r in docs.where("text is not null").collect():
        c = forms.content(r.text, records=False)
        want |= {(r.doc_id, i) for k in range(len(c) - 49) for i in index.get(c[k : k + 50], ())}
    got = [(r.doc_id, r.item_id) for r in leaks.found(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_leaks_with_an_error(spark, monkeypatch):
    item = "".join(chr(0x4E00 + 11 * i) for i in range(90))
    edited = "甲乙" + item[:30] + "丁" + item[31:52] + "丙"
    docs = frame(spark, [(0, edited), (1, item[:49]), (2, item[20:70]), (3, None), (4, ""), (5, "无关" * 40)])
    items = spark.createDataFrame([(7, item), (8, "短"), (9, None)], "item_id bigint, text string")
    for chars in (leaks.BLOCK_CHARS, 50):  # one block of items, and several
        monkeypatch.setattr(leaks, "BLOCK_CHARS", chars)
        got = {r.doc_id: (r.item_id, r.exact_chars >= 50, r.distance) for r in leaks.leaks(docs, items).collect()}
        assert got[0] == (7, False, 1) and got[2] == (7, True, 0) and set(got) <= {0, 1, 2}
    assert {r.doc_id for r in leaks.found(docs, items).collect()} == {2}
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), items).count() == 0


def test_leaks_with_an_error_anywhere(spark):
    """One error at any place of a passage at any place of an item, against Myers' distance of all passages."""
    rng = random.Random(4)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(40)) for _ in range(n))
    texts, parts = [word(rng.randrange(50, 120)) for _ in range(6)], []
    for _ in range(180):
        item = rng.choice(texts)
        size = min(len(item), rng.randrange(48, 60))
        at = rng.randrange(len(item) - size + 1)
        part = list(item[at : at + size])
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(part))
            part[k : k + rng.randrange(2)] = rng.choice([[], [word(1)]])
        parts.append(word(rng.randrange(4)) + "".join(part) + word(rng.randrange(4)))
    parts.append(texts[0][15:60] + "丁" + texts[0][61:65])
    want = {}
    for d, text in enumerate(parts):
        for i, item in enumerate(texts):
            distance = min(leaks.myers(item[k : k + 50], text) for k in range(len(item) - 49))
            if distance <= 1:
                want[d, i] = distance
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in leaks.leaks(frame(spark, list(enumerate(parts))), items).collect()]
    assert {(d, i): n for d, i, n in got} == want and len(got) == len(want) and 1 in want.values() and len(want) > 100
    assert {(r.doc_id, r.item_id) for r in leaks.found(frame(spark, list(enumerate(parts))), items).collect()} == {k for k, n in want.items() if not n}
    for budget in (2,):
        far = leaks.Pieces(list(enumerate(texts)), 50, budget)
        near = {(d, i): min(leaks.myers(item[k : k + 50], text) for k in range(len(item) - 49)) for d, text in enumerate(parts) for i, item in enumerate(texts)}
        assert {(d, i): n for d, i, _, n in far.leaks(parts)} == {k: n for k, n in near.items() if n <= budget}


def test_myers():
    rng = random.Random(0)
    for _ in range(300):
        p, t = ("".join(rng.choices("abc", k=rng.randrange(n))) for n in (9, 12))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert leaks.myers(p, t) == min(row)


def test_mixture(spark, tables):
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "mix_target"))
    mixed = mixture.mixture(docs, targets, TOKENIZER)
    rows = mixture.reached(mixed, targets).collect()
    assert len(rows) == 8 and sum(r.reached_share for r in rows) == pytest.approx(1)
    for r in rows:
        assert r.reached_share == pytest.approx(r.target_share, abs=0.01) and r.most_copies <= r.max_repeat
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    # the shares of labelled documents from the texts themselves
    encode = mixture.encoding(TOKENIZER).encode_ordinary
    copies = {r.doc_id: r.copies for r in mixed.select("doc_id", "copies").collect()}
    tokens = collections.Counter()
    for r in docs.where("source is not null and length(text) > 0").select("doc_id", "source", "text").collect():
        tokens[r.source] += len(encode(r.text)) * copies.get(r.doc_id, 0)
    assert {r.source: r.labelled_share for r in rows} == pytest.approx({s: n / sum(tokens.values()) for s, n in tokens.items()})


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("source is not null and length(text) > 0")
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    weights = mixture.classifier(docs.where("doc_id % 5 <> 0"), sources)
    held = docs.where("doc_id % 5 = 0").select("source", "text").collect()
    p = mixture.posteriors(mixture.features([r.text for r in held]), weights)
    right = sum(sources[k] == r.source for k, r in zip(p.argmax(1), held)) / len(held)
    most = max(collections.Counter(r.source for r in held).values()) / len(held)
    assert right > most + 0.15 and p.sum(1) == pytest.approx(1, abs=1e-4)
    # probabilities are of use as such: expected and true numbers of each source are near
    assert all(abs(p[:, k].sum() - sum(r.source == s for r in held)) < 0.05 * len(held) for k, s in enumerate(sources))


def test_features_have_the_whole_text():
    a, b = "The site engineer keeps a diary of pours. " * 5 + "Rain at noon.", "The site engineer keeps a diary of pours. " * 5 + "Q: who signs?"
    x = mixture.features([a, b, a, "", "x"])
    assert (x[0] == x[2]).all() and not np.allclose(x[0], x[1]) and not x[3].any()


def test_mixture_edges(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeat int")
    docs = spark.createDataFrame([(i, "words here", "ab"[i % 2]) for i in range(20)] + [(90, None, "a"), (91, "", "b"), (92, "x", "c"), (None, "x", "a")], "doc_id bigint, text string, source string")
    got = {r.source: r for r in mixture.reached(mixture.mixture(docs, targets, TOKENIZER), targets).collect()}
    assert got["a"].reached_share == got["b"].reached_share == 0.5 and got["a"].documents == 10
    assert mixture.mixture(docs.limit(0), targets, TOKENIZER).count() == 0


def kind_of(text):
    return quality.statistics([text])[1][0]


def test_quality_kinds():
    prose = "The cover depth of the edge beam shall not be less than 40 mm. " * 8
    assert kind_of(prose) == "junk"  # one phrase over and over
    varied = " ".join(f"The {a} of the {b} is checked by the crew before the work begins on day {i}." for i, (a, b) in enumerate([("sag", "beam"), ("fall", "floor"), ("tilt", "wall"), ("depth", "pile"), ("strength", "prop"), ("gap", "deck")]))
    assert kind_of(varied) == "prose" and quality.statistics([varied])[2] == [[]]
    wrapped = "\n".join(varied[i : i + 70] for i in range(0, len(varied), 70))
    assert kind_of(wrapped) == "prose"
    assert kind_of("\n".join(f"- spare {x} grout" for x in "abcdefghij")) == "list"
    assert kind_of("\n".join(f"{i},梁{i},合格" for i in range(12))) == "table"
    assert kind_of("\n".join(f"{i}\tbeam\t{i * 3}" for i in range(12))) == "table"
    assert kind_of("钢筋混凝土".encode().decode("latin-1") * 20) == "junk"
    assert kind_of("0000000: 034e 4f55 a117 2a0b\n0000010: e7ea 9776 30e1 ce64") == "junk"
    assert kind_of("\n") == "empty"


BITS = ["The beam shall be level. ", "梁应平直。", "\n", "\r\n", "\u2028", "- item\n", "（3）项\n", "12. thing\n", "a) x\n", "a, b, c\n", "甲，乙，丙\n", "x;y;z\n", "1\t2\t3\n", "| a | b |\n", "a  b   c\n",
        "<p>x</p>\n", "&amp;", "»", "»x", "���", "Ã¥Â", "deadbeef: 00ff 1234 abcd\n", "A" * 55, "aa;bb/cc,dd.ee", "  ", "\u3000\u3000", "\U00020000", "😀", "…”", "word", "号", "İK", "\x1c", "’", "9", "(7) y\n"]


def test_quality_against_line_by_line(spark):
    import plain_quality

    rng = random.Random(11)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(part) * rng.randrange(1, 4) for _ in range(rng.randrange(30))) for part in (rng.sample(BITS, 4) for _ in range(3000))]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        s, kind, reasons = quality.statistics(part)
        for i, text in enumerate(part):
            want = plain_quality.stats(text)
            if want is None:
                assert kind[i] == "empty" and reasons[i] == ["empty"] and all(np.ma.getmaskarray(s[c])[i] for c in s)
            else:
                assert {c: float(s[c][i]) for c in s} == pytest.approx(want), text
                other = 1 - want["prose"]
                assert (kind[i] == "prose") == (other < 0.8 - 1e-9) or abs(other - 0.8) < 1e-9
                assert [r for r in reasons[i] if r.startswith("mostly")] == ([] if kind[i] == "prose" else [f"mostly {kind[i]}"])


def test_published_rules_tell_prose_from_the_rest(spark):
    """The published thresholds alone: nearly all documents that aren't prose fail one, hardly any prose does."""
    rows = quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("kind <> 'empty'").collect()
    failed = [(r.kind == "prose", any(not x.startswith("mostly") for x in r.reasons)) for r in rows]
    assert sum(f for prose, f in failed if not prose) > 0.95 * sum(not prose for prose, _ in failed)
    assert sum(f for prose, f in failed if prose) < 0.01 * sum(prose for prose, _ in failed)


def test_quality_table(spark):
    df = frame(spark, [(0, None), (1, ""), (2, " "), (3, "梁。" * 3)])
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got[0].kind == got[1].kind == got[2].kind == "empty" and got[0].reasons == ["empty"] and got[0].words is None
    assert got[3].words == 3 and got[3].ended_lines == 1 and "few words" in got[3].reasons
    assert quality.found(df).count() == 0 and quality.found(df.limit(0)).count() == 0
    assert [(r.doc_id, r.kind) for r in quality.found(frame(spark, [(7, "- beam\n" * 2 + "- grout pump\n- prop")])).collect()] == [(7, "list")]
