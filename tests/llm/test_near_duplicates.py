import random

import numpy as np

from notelake.llm import p6_near_duplicates as p6
from notelake.llm import shingles

NOTES = "note_id long, content string, updated_at timestamp, band int, text_id string"
CHUNKS = "chunk_id string, content string, row long, kind string"


def text(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def edited(rng, t, k):
    t = list(t)
    for _ in range(k):
        i = rng.randrange(len(t))
        t[i] = rng.choice("abcdefghij")
    return "".join(t)


def exact(a, b):
    x, y = ({t[i:i + 8] for i in range(len(t) - 7)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_signature_estimates_jaccard():
    rng = random.Random(1)
    c = p6.NearDuplicateConfig()
    a = text(rng, 400)
    b = edited(rng, a, 40)
    s = p6.circulant_signatures([shingles.shingle_set(t, 8) for t in (a, b)], c)
    assert abs((s[0] == s[1]).mean() - exact(a, b)) < 0.12
    assert abs(shingles.jaccard(*(shingles.shingle_set(t, 8) for t in (a, b))) - exact(a, b)) < 1e-9
    k = p6.sketches(s)
    assert np.array_equal(k[0] == k[1], [bin(int(x ^ y)).count("1") == 0 for x, y in zip(k[0], k[1])])


def test_pairs_equal_brute_force(table):
    rng = random.Random(7)
    base = [text(rng) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows += [(i * 10 + j, edited(rng, t, 3 * j)) for j in range(4)]
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "short text"), (None, base[0])]
    notes = table([(i, t, None, 1, "x") for i, t in rows], NOTES)
    chunks = table([("b", base[0], 1, "k"), ("a", base[0], 1, "k"), ("a", base[0], 2, "k"), ("c", edited(rng, base[0], 2), 1, "k"), (None, base[0], 1, "k")], CHUNKS)
    got = {tuple(r) for r in p6.near_duplicate_pairs(notes, chunks).collect()}
    real = [(i, t) for i, t in rows if i is not None and t and len(t) > 330]
    want = {("note", str(a), str(b)) for a, x in real for b, y in real if a < b and exact(x, y) >= 0.6}
    assert {g for g in got if g[0] == "note"} == want
    assert {g for g in got if g[0] == "chunk"} == {("chunk", "a", "b"), ("chunk", "a", "c"), ("chunk", "b", "c")}
    assert p6.near_duplicate_pairs(notes.limit(0), chunks.limit(0)).count() == 0


def test_many_copies_stay_linear(table):
    rng = random.Random(3)
    t = text(rng)
    notes = table([(i, t, None, 1, "x") for i in range(300)] + [(1000, edited(rng, t, 2), None, 1, "x")], NOTES)
    n = p6.near_duplicate_pairs(notes, table([], CHUNKS)).count()
    assert n == 299 + 300


def test_groups(table):
    rng = random.Random(5)
    t = text(rng)
    a, b = edited(rng, t, 4), edited(rng, t, 4)
    notes = table([(1, t, None, 1, "x"), (2, a, None, 1, "x"), (3, b, None, 1, "x"), (4, text(rng), None, 1, "x"), (5, t, None, 1, "x")], NOTES)
    g = {r["item_id"]: (r["group_id"], r["n_links"]) for r in p6.near_duplicate_groups(notes, table([], CHUNKS)).collect()}
    assert g["1"] == g["5"] and len({g[i][0] for i in "1235"}) == 1 and g["4"][0] != g["1"][0] and g["4"][1] == 0


def test_components_of_a_chain(table):
    links = table([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    ids = table([(i,) for i in [*range(1, 41), 100, 101, 200]], "id long")
    got = {r["id"]: r["group_id"] for r in p6.components(links, ids).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100 and got[200] == 200
