import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillgraph.llm import forms

SAME = [
    ("ＡＢＣ１２．５，（ｘ）", "ABC12.5,(x)"),
    ("Bétolène", "Bétolène"),
    ("Β​e­t﻿a", "Beta"),
    ("асе ΟΗ", "ace OH"),
    ("23℃", "23°C"),
    ("⼯⽅", "工方"),
    ("不不", "不不"),
    ("a 　\r\n b ", "a b"),
    ("е́", "é"),
    ("e‍́", "é"),
    ("5㎡", "5m²"),
    ("Å", "Å"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert forms.consistent(a) == forms.consistent(b) == forms.consistent(forms.consistent(a))


@pytest.mark.parametrize("a, b", [("m²", "m2"), ("e", "é"), ("A", "a"), ("日", "曰"), ("a b", "ab"), ("①", "1"), ("Г", "T")])
def test_different_look(a, b):
    assert forms.consistent(a) != forms.consistent(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_twice_is_once(text):
    once = forms.consistent(text)
    assert forms.consistent(once) == once
    assert once == once.strip() and "  " not in once


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeoузкеά̈ ​中１", max_size=20))
def test_decomposed_is_composed(text):
    assert forms.consistent(unicodedata.normalize("NFD", text)) == forms.consistent(unicodedata.normalize("NFC", text))


def test_nothing():
    assert forms.consistent(None) is None and forms.consistent("") == "" and forms.consistent(" ​\n") == ""


def test_content_string():
    assert forms.content("厚 12.5mm，Ａ-B：≤3%（x）.") == "厚12.5mmab≤3%x"
    assert forms.content("3. a") == "3a" and forms.content("m²_") == "m²"


def test_field_records():
    fields = {"部位": "梁", "材料": "钢 筋", "限值": "≤1.5", "编号": "A-1"}
    want = "".join(sorted(forms.strip_format(k) + forms.strip_format(v) for k, v in fields.items()))
    import json
    import random

    for seed in range(5):
        items = list(fields.items())
        random.Random(seed).shuffle(items)
        for text in (json.dumps(dict(items), ensure_ascii=False, indent=seed % 2), "; ".join(f"{k}:{v}" for k, v in items), " ｜ ".join(f"{k}： {v}" for k, v in items), "\n\n" + "\n".join(f"{k}: {v}" for k, v in items)):
            assert forms.content(text) == want
    assert forms.content("部位:梁; 材料:钢筋; 限值:1") == "部位梁材料钢筋限值1"  # three parts: not a record
    assert forms.content('{"a": {"b": 1}}') == "ab1"  # not flat


def test_long_texts_whole():
    assert len(forms.consistent("ａ" * 100_000)) == 100_000
