import random

import numpy as np
import pytest

from notelake.llm import p7_leaks as p7
from notelake.llm.fm_index import FMIndex, suffix_array

BOX = "struct<x0:int,y0:int,x1:int,y1:int,conf:float>"
DOCS = f"doc_id long, text string, lines array<{BOX}>, item_id long, x0 int"
ITEMS = "item_id long, text string, doc_id long"


@pytest.mark.parametrize("symbols,n", [(2, 300), (4, 3000), (30, 2000), (1, 200)])
def test_index_equals_scanning(symbols, n):
    rng = np.random.default_rng(n)
    t = rng.integers(1, 1 + symbols, n).astype(np.uint8)
    full = np.append(t, 0)
    assert suffix_array(full).tolist() == sorted(range(len(full)), key=lambda i: full[i:].tobytes())
    fm = FMIndex(t, sample=5)
    w = 5
    pat = np.concatenate([np.stack([t[i:i + w] for i in range(0, n - w, 7)]), np.full((1, w), 31)])
    lo, hi = fm.search(pat)
    for p, a, b in zip(pat, lo, hi, strict=True):
        want = [i for i in range(n - w + 1) if (t[i:i + w] == p).all()]
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


WORDS = "anvil basket candle drawer engine feather garden hammer island jacket kettle ladder mirror needle orchard pencil quarry ribbon saddle table umbrella violin window yarn".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


def wrap(words, width=40, hyphen="-"):
    lines, cur = [], ""
    for w in words.split():
        if cur and len(cur) + 1 + len(w) > width:
            room = width - len(cur) - 2
            if room > 2 and len(w) > room + 2:
                lines.append(cur + " " + w[:room] + hyphen)
                cur = w[room:]
                continue
            lines.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}".strip()
    return lines + [cur]


def test_leaks(table):
    rng = random.Random(11)
    items = [passage(rng, 40) for _ in range(8)]
    ja = "二番目の毛布は葦巡浜、三番目は鷺積原に属し、どちらもうるさいやかんに及ばない壊れやすい暦"
    fill = lambda n: passage(rng, n)
    part = lambda t, n: " ".join(t.split()[:n])
    docs = {
        1: "\n".join(wrap(f"{fill(50)} {items[0].upper()} {fill(50)}")),
        2: "\n".join(wrap(f"{fill(50)} {part(items[1], 24)} {fill(50)}", hyphen="¬")),
        3: f"{fill(50)} {part(items[2], 13)} {fill(50)}",
        4: "\n".join(wrap(items[3][:130])) + "\nWANTED, soap,\napply box 42\n" + "\n".join(wrap(items[3][130:])),
        5: " ".join(sorted(items[4].split())),
        6: items[5].replace("d", "cl", 2).replace("n", "ri", 1).replace("e", "c", 3),
        7: fill(200),
        9: "紙面" + ja[:20] + "\n" + ja[20:] + "終わり",
    }
    left, right = wrap(f"{items[6]}"), wrap(fill(40))
    k = min(len(left), len(right))
    text, boxes = [], []
    for i in range(k):
        for x, col in ((100, left), (1100, right)):
            text.append(col[i])
            boxes.append((x, 100 + 40 * i, x + 600, 130 + 40 * i, 0.9))
    text += left[k:]
    boxes += [(100, 100 + 40 * (k + i), 700, 130 + 40 * (k + i), 0.9) for i in range(len(left) - k)]
    rows = [(d, t, None, 1, 1) for d, t in docs.items()] + [(8, "\n".join(text), boxes, 1, 1), (10, None, None, 1, 1), (11, "", None, 1, 1), (None, items[0], None, 1, 1), (1, docs[1], None, 1, 1), (12, "short", [(1, None, 2, 3, None)], 1, 1)]
    ev = [(i, t, 0) for i, t in enumerate(items)] + [(50, ja, 0), (51, "", 0), (52, None, 0), (None, "x", 0)]
    got = {(r["doc_id"], r["item_id"]) for r in p7.leaks(table(rows, DOCS), table(ev, ITEMS)).collect()}
    assert got == {(1, 0), (2, 1), (4, 3), (6, 5), (8, 6), (9, 50)}
    assert p7.leaks(table([], DOCS), table(ev, ITEMS)).count() == 0
    assert p7.leaks(table(rows, DOCS), table([], ITEMS)).count() == 0


def test_spans_cover_the_passage(table):
    rng = random.Random(2)
    item, before = passage(rng, 30), passage(rng, 30)
    text = f"{before} {item} {passage(rng, 30)}"
    r = p7.leaks(table([(1, text, None, 1, 1)], DOCS), table([(1, item, 1)], ITEMS)).first()
    a, b = min(r["span_starts"]), max(r["span_ends"])
    assert abs(a - len(before) - 1) <= 2 and abs(b - a - len(item)) <= 4


def test_page_longer_than_a_shard():
    import pandas as pd

    rng = random.Random(4)
    c = p7.LeakConfig(shard_symbols=20_000)
    item = passage(rng, 40)
    text = passage(rng, 6000) + " " + item + " " + passage(rng, 3000)
    pages = pd.DataFrame({"doc_id": [5, 6], "text": [text, passage(rng, 50)], "x0": [None, None], "x1": [None, None], "y0": [None, None]})
    found = list(p7.find_leaks(pages, [p7.Item(1, item, c.window)], c))
    assert {f[:2] for f in found} == {(5, 1)} and abs(found[0][4][0][0] - text.index(item)) <= 2


def test_items_that_share_their_windows(table):
    rng = random.Random(8)
    item, shared, other = passage(rng, 40), passage(rng, 36), passage(rng, 40)
    ends = [passage(rng, 24) for _ in range(5)]
    half = " ".join(shared.split()[:34])
    docs = [(1, f"{passage(rng, 50)} {item} {passage(rng, 50)}", None, 1, 1), (2, f"{passage(rng, 50)} {half} {passage(rng, 50)}", None, 1, 1), (3, passage(rng, 150), None, 1, 1), (4, other, None, 1, 1)]
    ev = [(i, item, 0) for i in range(6)] + [(10 + i, f"{shared} {e}", 0) for i, e in enumerate(ends)] + [(20, other, 0)]
    got = {(r["doc_id"], r["item_id"]) for r in p7.leaks(table(docs, DOCS), table(ev, ITEMS)).collect()}
    assert got == {(1, i) for i in range(6)} | {(2, 10 + i) for i in range(5)} | {(4, 20)}


def test_parts_of_a_passage_far_apart(table):
    """A passage of which 60 words of 100 stand on the page, with an advert of any length between."""
    letters = random.Random(5)
    unlike = lambda n: " ".join("".join(letters.choice("bcdfgklmnprstvz") + letters.choice("aeiou") for _ in range(4)) for _ in range(n))
    item = unlike(100)
    w = item.split()
    a, b = " ".join(w[20:50]), " ".join(w[50:80])
    for n in (100, 400, 2000):
        docs = [(1, f"{unlike(30)} {a} {unlike(n)} {b} {unlike(30)}", None, 1, 1), (2, f"{unlike(30)} {b} {unlike(n)} {a}", None, 1, 1), (3, f"{unlike(30)} {a} {unlike(n)}", None, 1, 1)]
        got = {(r["doc_id"], r["item_id"]) for r in p7.leaks(table(docs, DOCS), table([(7, item, 1)], ITEMS)).collect()}
        assert got == {(1, 7)}


def test_a_passage_across_the_shards_of_a_page():
    import pandas as pd

    letters = random.Random(6)
    unlike = lambda n: " ".join("".join(letters.choice("bcdfgklmnprstvz") + letters.choice("aeiou") for _ in range(4)) for _ in range(n))
    item, c = unlike(200), p7.LeakConfig(shard_symbols=1_000)
    text = unlike(500) + " " + item + " " + unlike(500)
    pages = pd.DataFrame({"doc_id": [5, 6], "text": [text, unlike(30)], "x0": [None, None], "x1": [None, None], "y0": [None, None]})
    assert [f[:4] for f in p7.find_leaks(pages, [p7.Item(1, item, c.window)], c)] == [(5, 1, 200, 200)]
