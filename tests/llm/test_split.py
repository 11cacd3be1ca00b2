import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import p2_split as p2
from notelake.llm.shingles import code_points


def size(t):
    return int(p2._Sizes(code_points(t).astype("int64")).of(0, len(t)))


def check(t, c=p2.SplitConfig()):
    p = p2.split(t, c)
    if size(t) <= c.limit:
        assert p == []
        return p
    assert p[0][0] == 0 and p[-1][2] == len(t)
    for (a, b, e), nxt in zip(p, [*p[1:], None], strict=True):
        assert b <= a < e and size(t[b:e]) <= c.limit and size(t[b:a]) <= c.overlap
        assert nxt is None or nxt[0] == e
    return p


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é字。. \ń👨‍", min_size=0, max_size=400))
def test_tiles_within_the_limit(t):
    check(t, p2.SplitConfig(limit=20, overlap=5, least=6))


@pytest.mark.parametrize("t", ["a" * 9000, "字" * 3000, "́" * 6000, " " * 5000 + "x" * 4000, "é" * 4000, "x" * 1600, "x" * 1601])
def test_extremes(t):
    check(t)


def prose(rng, n):
    return " ".join(" ".join(rng.choice(["lamp", "kettle", "borrowed", "violin", "orchard", "night"]) for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(n))


def test_cuts_at_boundaries_and_edits_stay_local():
    rng = random.Random(2)
    t = prose(rng, 900)
    p = check(t)
    assert sum(t[e - 1] in " ." for _, _, e in p[:-1]) > 0.9 * (len(p) - 1)
    k = len(t) // 2
    u = t[:k] + " An inserted remark. " + t[k:]
    before, after = {t[a:e] for a, _, e in p}, {u[a:e] for a, _, e in check(u)}
    assert len(before - after) <= 4


def test_rows(table):
    items = table([("note", "1", "x" * 1700), ("note", "2", None), ("chunk", "c", "short"), ("chunk", None, "y" * 5000), ("chunk", "e", "")], "item_kind string, item_id string, content string")
    rows = p2.pieces(items).orderBy("piece_index").collect()
    assert {r["item_id"] for r in rows} == {"1"} and rows[0]["start_pos"] == 0 and all(r["size"] <= 400 for r in rows)
    text = "x" * 1700
    assert all(text[r["start_pos"]:r["end_pos"]] == r["piece"] for r in rows)
    assert p2.pieces(items.limit(0)).count() == 0


def test_long_sentences_overlap_at_words():
    t = " ".join("lamp" + " kettle" * 89 + "." for _ in range(20))
    p = check(t)
    assert len(p) > 2 and all(b < a and t[b - 1] == " " for a, b, _ in p[1:])
