import datetime as dt

import pytest
from pyspark.sql import functions as F

from notelake import runtime
from notelake.operators import rag, search, store
from notelake.sources import schemas, tables
from notelake.streaming import changes

T0 = dt.datetime(2024, 1, 1)
def now():
    return F.timestamp_seconds(F.lit(1_800_000_000))


def notes(spark, *rows):
    return tables.memory_notes(spark, [(i, t, c, T0, T0, f) for i, t, c, f in rows])


def ids(df, column="note_id"):
    return sorted(r[column] for r in df.collect())


def test_update_flags_only_new_content(spark):
    n = notes(spark, (1, "a", "x", False), (2, "b", None, False), (3, "c", "z", True))
    ch = spark.createDataFrame([(1, "A", "x"), (2, "b", "new")], "note_id long, new_title string, new_content string")
    r = {x["note_id"]: x for x in store.update(n, ch, now()).collect()}
    assert r[1]["title"] == "A" and not r[1]["needs_reindexing"] and r[1]["updated_at"] != T0
    assert r[2]["needs_reindexing"] and r[3]["needs_reindexing"] and r[3]["updated_at"] == T0


def test_create_delete_reindex(spark):
    n = store.create(notes(spark, (1, "a", "one", False)), spark.createDataFrame([(2, "b", "two")], "note_id long, title string, content string"), now())
    assert {r["note_id"]: r["needs_reindexing"] for r in n.collect()} == {1: False, 2: True}
    c = store.chunk_notes(notes(spark, (1, "a", "one", False), (2, "b", "old", False), (4, "e", " ", False), (5, "n", None, False)))
    assert ids(c) == [1, 2]
    n2, c2 = store.reindex(n, c)
    assert {(r["note_id"], r["content"]) for r in c2.collect()} == {(1, "one"), (2, "two")} and not any(r["needs_reindexing"] for r in n2.collect())
    again = store.chunk_notes(n.where("note_id = 1"))
    assert again.first()["chunk_id"] == c.where("note_id = 1").first()["chunk_id"]  # a new title keeps the chunks' ids
    n3, c3 = store.delete(n2, c2, spark.createDataFrame([(2,)], "note_id long"))
    assert ids(n3) == [1] and ids(c3) == [1]


def test_latest_state(spark):
    rows = [(1, "t", "c", T0, None, True), (1, "t", "c", T0, T0, True), (1, "t", "c", T0, dt.datetime(2024, 5, 1), False), (None, "x", "y", T0, T0, False)]
    got = store.latest_notes(tables.memory_notes(spark, rows)).collect()
    assert len(got) == 1 and got[0]["updated_at"] == dt.datetime(2024, 5, 1)


@pytest.fixture()
def world(spark):
    n = notes(spark, (1, "one", "", False), (2, "", "", False))
    v = spark.createDataFrame(
        [("a1", 1, "far", [0.9, 0.1]), ("a2", 1, "best", [1.0, 0.0]), ("b1", 2, "other", [0.5, 0.5]), ("gone", 9, "orphan", [0.95, 0.0]), ("free", None, "no note", [0.99, 0.0])],
        "id string, note_id long, content string, vec array<float>",
    )
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<float>")
    return n, v, q


def test_hits_lose_orphans_after_the_cut(world):
    n, v, q = world
    hits = search.top_chunks(v, n, q, 3, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in hits] == ["a2"]
    assert search.top_chunks(v, n, q, 0, 2).count() == 0


def test_notes_keep_their_best_chunk(world):
    n, v, q = world
    got = search.search_notes(v, n, q, 10, 2).orderBy("place").collect()
    assert [(r["note_id"], r["excerpt"]) for r in got] == [(1, "best"), (2, "other")]
    assert search.search_notes(v, n, q, 0, 2).count() == 0 and search.search_notes(v, n, q, -3, 2).count() == 0


def test_many_chunks_of_one_note_crowd_out_others(spark):
    n = notes(spark, (1, "a", "", False), (2, "b", "", False))
    rows = [(f"a{i:02d}", 1, "x", [1.0, 0.0]) for i in range(60)] + [("b", 2, "y", [0.5, 0.0])]
    v = spark.createDataFrame(rows, "id string, note_id long, content string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<float>")
    assert search.search_notes(v, n, q, 10, 2).count() == 1


def hits(spark, *sizes):
    return spark.createDataFrame([("q", i, "t" if i > 1 else "", "字" * s) for i, s in enumerate(sizes, 1)], "query_id string, rank int, title string, content string")


@pytest.mark.parametrize("sizes,kept", [([600] * 5, 2), ([2000], 1), ([1000, 600, 100], 1), ([], 0)])
def test_budget(spark, sizes, kept):
    assert rag.select_sources(hits(spark, *sizes)).count() == kept


def test_prompt_and_answers(spark):
    q = spark.createDataFrame([("q", "  what? "), ("blank", " \n"), ("none", "why")], "query_id string, text string")
    s = rag.select_sources(hits(spark, 2, 3))
    p = rag.prompts(search.asked(q), s).first()["prompt"].split("\n")
    assert p[1] == "[1] ノート「無題」: 字字" and p[2] == "[2] ノート「t」: 字字字" and p[3] == "" and p[4] == "質問: what?"
    a = {r["query_id"]: r for r in rag.answers(q, hits(spark, 2, 3), None, "off").collect()}
    assert a["q"]["text"] is None and a["q"]["unavailable_reason"] == "off" and a["q"]["n_sources"] == 2
    assert a["blank"]["n_sources"] == 0 and a["blank"]["unavailable_reason"] is None and a["none"]["n_sources"] == 0
    b = {r["query_id"]: r for r in rag.answers(q, hits(spark, 2, 3), rag.echo_generator).collect()}
    assert b["q"]["text"].startswith("echo:") and b["none"]["text"] is None


def test_json_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"notes":[{"id":"n1","title":"t","content":"c"}],"queries":[{"id":"q1","text":"x","relevant":{"n1":2}},{"id":"q2","text":"y","relevant":{}}]}')
    e = tables.read_eval_set(spark, str(tmp_path / "e.json"))
    assert [tuple(r) for r in tables.qrels(e).collect()] == [("q1", "n1", 2)] and tables.eval_queries(e).count() == 2 and tables.eval_notes(e).count() == 1
    (tmp_path / "r.json").write_text('{"model_id":"m","dimension":2,"normalized":true,"generated_at":"now","validation":null,"cases":[{"id":"c","text":"t","token_ids":[1],"embedding":[0.12345678,1.0]}]}')
    tables.write_reference(tables.read_reference(spark, str(tmp_path / "r.json")), str(tmp_path / "out"))
    got = tables.reference_cases(tables.read_reference(spark, str(tmp_path / "out"))).first()
    assert got["embedding"] == pytest.approx([0.123457, 1.0])


def test_stream_of_changes(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    notes(spark, (1, "a", "x", True), (2, "b", "y", True)).coalesce(1).write.parquet(src)
    changes.run_available(changes.read_changes(spark, src, 10), dst, str(tmp_path / "cp"))
    tables.memory_notes(spark, [(1, "a", "newer", T0, dt.datetime(2025, 1, 1), True)]).coalesce(1).write.mode("append").parquet(src)
    changes.run_available(changes.read_changes(spark, src, 10), dst, str(tmp_path / "cp"))
    assert {(r["note_id"], r["content"]) for r in spark.read.parquet(f"{dst}/v=1").collect()} == {(1, "newer"), (2, "y")}


def test_json_sink_and_source(spark, tmp_path):
    rows = [("m", 2, True, "t", (0.9, None, "cpu"), [("a", "x", [1], [0.12345678, 1.0]), ("b", None, None, None)]), ("n", 2, None, None, None, [])]
    r = spark.createDataFrame(rows, schemas.REFERENCE)
    tables.write_reference(r, str(tmp_path / "out"))
    back = tables.read_reference(spark, str(tmp_path / "out"), lines=True)
    got = {x["id"]: x for x in tables.reference_cases(back).collect()}
    assert abs(got["a"]["embedding"][0] - 0.123457) < 1e-7 and got["b"]["embedding"] is None and back.count() == 2


def test_widths_follow_the_size(spark):
    small = spark.range(10)
    assert runtime.width_for(small) == runtime.slots(spark)
    assert runtime.width_for(small, each=16) == 5 and runtime.spread(small).rdd.getNumPartitions() == runtime.slots(spark)


def test_a_cut_table_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0], None), (None, None, "x")], "a long, b array<double>, c string")
    back = runtime.cut(df)
    assert back.schema == df.schema and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
