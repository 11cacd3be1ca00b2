import os

import pytest

from notelake.llm import p8_mixture as p8

DOCS = "doc_id long, text string, source string, n_tokens long, target_share double"
TARGETS = "source string, target_share double, max_repeats int, source_key string"
pytestmark = pytest.mark.skipif(not os.path.exists(p8.MixConfig().tokenizer), reason="vocabulary files are not installed")


def docs(table):
    rows = [(i, f"page {i} of the large paper with some words " * 3, "Big Paper", 0, 0.0) for i in range(400)]
    rows += [(1000 + i, f"small sheet {i} with words " * 4, ["Small_Sheet", "small sheet ", "SMALL SHEET"][i % 3], 0, 0.0) for i in range(10)]
    rows += [(2000, "no target here", "Other", 0, 0.0), (2001, "null source", None, 0, 0.0), (2002, None, "Big Paper", 0, 0.0), (2003, "", "Big Paper", 0, 0.0), (None, "x", "Big Paper", 0, 0.0), (0, rows[0][1], "Big Paper", 0, 0.0)]
    return table(rows, DOCS)


def test_shares_caps_and_budget(table):
    targets = table([("Big Paper", 0.9, 1, "k"), ("Small Sheet", 0.1, 3, "k"), ("Unprinted", 0.05, 3, "k"), ("Other", 0.0, 3, "k"), (None, 0.3, 1, "k")], TARGETS)
    c = p8.MixConfig(budget_tokens=5000, bucket_rows=30)
    sel = p8.mix(docs(table), targets, c)
    rows = sel.collect()
    assert sum(r["n_tokens"] for r in rows) <= 5000 and sum(r["n_tokens"] for r in rows) > 4900
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    assert max(r["repeat_no"] for r in rows if r["source"] == "Big Paper") == 1 and max(r["repeat_no"] for r in rows) <= 3
    s = {r["source"]: r for r in p8.shares(sel, targets).collect()}
    assert abs(s["Big Paper"]["actual_share"] - 0.9) < 0.02 and abs(s["Small Sheet"]["actual_share"] - 0.1) < 0.02 and s["Unprinted"]["tokens"] == 0
    first = min(r["repeat_no"] for r in rows if r["source"] == "Small Sheet")
    assert first == 1


def test_buckets_do_not_change_the_selection(table):
    targets = table([("Big Paper", 0.5, 2, "k"), ("Small Sheet", 0.5, 2, "k")], TARGETS)
    pick = lambda n: {(r["doc_id"], r["repeat_no"]) for r in p8.mix(docs(table), targets, p8.MixConfig(budget_tokens=3000, bucket_rows=n)).collect()}
    assert pick(10) == pick(100_000)


def test_a_source_that_runs_out_frees_its_share(table):
    targets = table([("Big Paper", 0.5, 2, "k"), ("Small Sheet", 0.5, 1, "k")], TARGETS)
    s = {r["source"]: r for r in p8.shares(p8.mix(docs(table), targets, p8.MixConfig(budget_tokens=4000)), targets).collect()}
    assert s["Small Sheet"]["most_repeats"] == 1 and s["Small Sheet"]["n_pages"] == 10 and s["Big Paper"]["actual_share"] > 0.8


def test_default_budget_and_empty_tables(table):
    targets = table([("Big Paper", 0.9, 1, "k"), ("Small Sheet", 0.1, 3, "k")], TARGETS)
    s = {r["source"]: r["actual_share"] for r in p8.shares(p8.mix(docs(table), targets), targets).collect()}
    assert abs(s["Big Paper"] - 0.9) < 0.05
    assert p8.mix(docs(table).limit(0), targets).count() == 0
    assert p8.mix(docs(table), targets.limit(0)).count() == 0
    assert all(r["actual_share"] == 0 for r in p8.shares(p8.mix(docs(table).limit(0), targets), targets).collect())
