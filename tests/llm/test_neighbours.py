import numpy as np
import pytest

from notelake.llm import p3_neighbours as p3

SCHEMA = "id string, embedding array<float>, vec int, cls string"


def brute(rows, k=5):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = np.round(x @ x.T, 9)
    out = set()
    for a, i in enumerate(ids):
        for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]:
            out.add((i, ids[b]))
    return out


@pytest.mark.parametrize("config,least", [(p3.NeighbourConfig(), 0.97), (p3.NeighbourConfig(shard=150, queries=120, probes=5, margin=0.6), 0.93), (p3.NeighbourConfig(shard=90, flat=2, probes=5, margin=0.6), 0.9)])
def test_against_brute_force(table, config, least):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    x = centres[rng.integers(0, 8, 700)] + 0.8 * rng.normal(size=(700, 64))
    rows = [(f"v{i:04d}", r.astype(np.float32).tolist()) for i, r in enumerate(x)]
    rows += [("copy", rows[0][1]), ("double", [2 * v for v in rows[1][1]]), ("null", None), ("short", [1.0]), ("nan", [float("nan")] * 64), ("hole", [None] * 64), ("zero", [0.0] * 64), (None, rows[0][1]), rows[5]]
    df = table([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = {(r["id"], r["other_id"]) for r in p3.neighbours(df, config).collect()}
    want = brute(rows)
    assert len(got & want) / len(want) >= least
    assert ("copy", "v0000") in got and ("v0000", "copy") in got
    assert len(got) == 5 * len({a for a, _ in want})


def test_copies_tie_by_id(table):
    v = [1.0] + [0.0] * 63
    df = table([(f"c{i}", v, 1, "x") for i in range(9)], SCHEMA)
    got = {}
    for r in p3.neighbours(df).collect():
        got.setdefault(r["id"], []).append(r["other_id"])
    assert sorted(got["c0"]) == ["c1", "c2", "c3", "c4", "c5"] and sorted(got["c8"]) == ["c0", "c1", "c2", "c3", "c4"]


def test_few_and_none(table):
    assert p3.neighbours(table([], SCHEMA)).count() == 0
    assert p3.neighbours(table([("a", [1.0] * 64, 1, "x")], SCHEMA)).count() == 0
    two = p3.neighbours(table([("a", [1.0] * 64, 1, "x"), ("b", [1.0] * 63 + [0.0], 1, "x")], SCHEMA)).collect()
    assert {(r["id"], r["other_id"]) for r in two} == {("a", "b"), ("b", "a")}


def test_a_hot_class_is_held_once(table):
    v = [1.0] + [0.0] * 63
    w = [0.9, 0.1] + [0.0] * 62
    rows = [(f"c{i:03d}", v, 1, "x") for i in range(300)] + [("d", w, 1, "x"), ("d", w, 1, "x"), ("d", None, 1, "x")]
    got = {(r["id"], r["other_id"]) for r in p3.neighbours(table(rows, SCHEMA)).collect()}
    assert len(got) == 301 * 5 and {b for a, b in got if a == "d"} == {f"c{i:03d}" for i in range(5)}


def test_recall_asks_all_stated_queries(table):
    rng = np.random.default_rng(4)
    df = table([(f"v{i}", r.tolist(), 1, "x") for i, r in enumerate(rng.normal(size=(300, 64)).astype(np.float32))], SCHEMA)
    r = p3.recall(df, every=3).collect()[0]
    assert 70 <= r["n_queries"] <= 130 and r["recall"] >= 0.95
