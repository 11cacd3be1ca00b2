import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import p5_lookalike as p5

NOTES = "note_id long, title string, content string, updated_at timestamp, content_1 string, extra array<int>"


def form(t):
    return p5.TOKEN.sub(lambda m: p5.by_table(m[0]), p5.normalise(t))


@pytest.mark.parametrize("a,b", [
    ("Ｂａｓｅ", "Base"), ("ﾌﾟﾛｼﾞｪｸﾄ", "プロジェクト"), ("cafe\u0301", "caf\u00e9"), ("up​stairs﻿", "upstairs"), ("a b c　d", "a b c d"),
    ("re‐do", "re-do"), ("62 ㎏", "62 kg"), ("ﬁnal", "final"), ("Hаlf", "Half"), ("Νο. 5", "No. 5"), ("Хор", "Xор"), ("a\r\nb", "a\nb"), ("a\u2028b", "a\nb"),
])
def test_alike(a, b):
    assert a != b and form(a) == form(b)


@pytest.mark.parametrize("a,b", [("Base", "base"), ("cafe", "café"), ("a1", "a2"), ("a.", "a"), ("x²", "x2"), ("…", "..."), ("a–b", "a-b"), ("き", "ぎ")])
def test_not_alike(a, b):
    assert form(a) != form(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(t):
    assert p5.normalise(p5.normalise(t)) == p5.normalise(t)
    assert form(form(t)) == form(t)


def test_alphabet_follows_the_letters_without_a_double():
    assert p5.by_table("лаmпа".replace("m", "м")) == "лампа" and p5.by_table("cоре") == "cope" and p5.by_table("сrаb") == "crab"


def test_trie_prefers_frequent_words_and_counts_edits():
    t = p5.Trie()
    t.add("crab", 3)
    t.add("crib", 9)
    assert t.nearest("сrаb") == "crab" and t.nearest("cr​ab") == "crab" and t.nearest("xxxx") is None
    assert t.nearest("ＣＲＡＢ".lower()) == "crab" and t.nearest("\u200bc\ufe0frab") == "crab"
    assert t.nearest("crob") is None and t.nearest("crob", 1.0) == "crib" and t.nearest("crab", 1.0) == "crab"


def test_pairs(table):
    n = table([
        (1, "Half done", "same", None, "x", [1]), (2, "Hаlf done", "same", None, None, None), (2, "Hаlf done", "same", None, None, None),
        (3, "Half done", None, None, None, None), (4, "half done", " ", None, None, None), (5, None, "", None, None, None), (6, "", "​", None, None, None), (None, "Half done", "q", None, None, None),
    ], NOTES)
    got = {tuple(r) for r in p5.alike_pairs(n).collect()}
    assert got == {("title", 1, 2), ("title", 2, 3)}
    assert p5.alike_pairs(n.limit(0)).count() == 0


def test_canonical_of_long_text(table):
    long = "Вaza и " * 30_000
    r = p5.canonical_fields(table([(1, None, long, None, None, None)], NOTES)).collect()
    assert len(r) == 1 and unicodedata.is_normalized("NFC", r[0]["canonical"]) and len(r[0]["canonical"]) == len(long)


def test_frequency_decides_between_spellings(table):
    """Of the spellings of one reading the most frequent is kept, also where the table would take the other."""
    russian, latin = "\u0445\u043e\u0440", "xop"
    rows = [(i, None, f"{russian} \u043f\u043e\u0451\u0442 {i}", None, None, None) for i in range(5)] + [(9, latin, "cafe\u0301 with a\u200bb", None, None, None), (10, "x\u043ep", "caf\u00e9 with ab", None, None, None)]
    got = {(r["field_name"], r["note_id"]): r["canonical"] for r in p5.canonical_fields(table(rows, NOTES)).collect()}
    assert got["title", 9] == got["title", 10] == russian and p5.by_table(russian) == latin
    assert got["content", 9] == got["content", 10] == "caf\u00e9 with ab" and got["content", 3].startswith(russian)
    assert ("title", 9, 10) in {tuple(r) for r in p5.alike_pairs(table(rows, NOTES)).collect()}


def test_copies_are_linked_to_the_other_class(table):
    rows = [(i, "Half", None, None, None, None) for i in range(1, 5)] + [(i, "H\u0430lf", None, None, None, None) for i in range(5, 9)]
    got = {tuple(r)[1:] for r in p5.alike_pairs(table(rows, NOTES)).collect()}
    assert got == {(i, 5) for i in range(1, 5)} | {(1, i) for i in range(5, 9)}
