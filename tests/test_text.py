import random

import pytest
from pyspark.sql import functions as F

from notelake.functions import packing
from notelake.functions.text import ChunkConfig, chunk, hard_split, paragraphs, score_text, sentences, title_or_default
from notelake.functions.text_size import size_of


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def size(t):
    cjk = other = 0
    for ch in t:
        cp = ord(ch)
        if 0x3000 <= cp <= 0x30FF and cp != 0x3040 - 1 or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0xFF00 <= cp <= 0xFFEF:
            cjk += 1
        elif not (ch.isspace() and ch not in "\x1c\x1d\x1e\x1f"):
            other += 1
    return cjk + -(-other // 4)


@pytest.mark.parametrize("text,expected", [
    ("東京都庭園案内地図帳", 10), ("abcdefghij", 3), ("", 0), ("　", 1), ("가나다라마", 2), ("\U00020000", 1), (None, None), (" \t\n ", 0),
])
def test_size(spark, text, expected):
    assert one(spark, text, size_of) == expected


@pytest.mark.parametrize("text,expected", [
    ("a\r\nb\u0085c d", ["a", "b", "c", "d"]), ("　x \n\n\t y", ["x", "y"]), ("  ", []), ("", []),
])
def test_paragraphs(spark, text, expected):
    assert one(spark, text, paragraphs) == expected


def test_sentences(spark):
    assert one(spark, "Eins. Zwei! 三。四", sentences) == ["Eins.", "Zwei!", "三。", "四"]


@pytest.mark.parametrize("text", ["字" * 200, "é" * 90 + "x", "👨‍👩‍👧" * 40, "a" * 1000, "", "á" * 300])
def test_hard_split_joins_to_the_text(spark, text):
    pieces = one(spark, text, lambda c: hard_split(c, 50))
    assert "".join(pieces) == text
    assert all(size(p) <= 50 for p in pieces)


def chunks(spark, text, target, most, overlap):
    return one(spark, text, lambda c: chunk(c, ChunkConfig(target, most, overlap)))


def loop_pack(units, target, most, overlap):
    out, cur, tok = [], [], 0
    for u in units:
        n = size(u)
        if cur and tok + n > target:
            out.append("\n".join(cur))
            keep, kept = [], 0
            for x in reversed(cur):
                if kept + size(x) > overlap:
                    break
                keep.insert(0, x)
                kept += size(x)
            if kept + n > most:
                keep, kept = [], 0
            cur, tok = keep, kept
        cur.append(u)
        tok += n
    if cur:
        out.append("\n".join(cur))
    return out


def test_chunk_blank_and_short(spark):
    assert chunks(spark, "", 300, 400, 50) == []
    assert chunks(spark, " \n\t ", 300, 400, 50) == []
    assert chunks(spark, "one\n\ntwo\nthree", 300, 400, 50) == ["one\ntwo\nthree"]


def test_chunk_packs_lines(spark):
    lines = [f"line number {i:03d}xx" for i in range(10)]  # 4 tokens each
    assert [size(x) for x in lines] == [4] * 10
    assert chunks(spark, "\n".join(lines), 30, 50, 0) == ["\n".join(lines[:7]), "\n".join(lines[7:])]


def test_whole_last_chunk_in_the_overlap(spark):
    a, b = "a" * 200, "b" * 1160
    assert chunks(spark, f"{a}\n{b}", 300, 400, 50) == [a, f"{a}\n{b}"]


def test_overlap_is_dropped_where_it_does_not_fit(spark):
    a, b = "a" * 80, "b" * 1560
    assert chunks(spark, f"{a}\n{b}", 300, 400, 50) == [a, b]


def test_chunks_equal_a_loop(spark):
    rng = random.Random(4)
    texts = ["\n".join("w" * rng.randint(1, 150) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk(F.col("t"), ChunkConfig(60, 80, 20)).alias("c")).collect()
    for r in rows:
        assert r["c"] == loop_pack(texts[r["i"]].split("\n"), 60, 80, 20)


def test_long_paragraph_is_cut_by_sentences_then_graphemes(spark):
    got = chunks(spark, "字" * 200, 30, 50, 10)
    assert len(got) == 4 and "".join(got) == "字" * 200
    four = " ".join(f"Sentence number {i} has some eighty letters of text in it so that it is long enough." for i in range(4))
    got = chunks(spark, four, 30, 50, 0)
    assert len(got) >= 2 and all(size(x) <= 50 for x in got)


def test_title_and_score(spark):
    assert [one(spark, t, title_or_default) for t in (None, "", "a")] == ["無題", "無題", "a"]
    assert spark.range(1).select(score_text(F.lit(0.8249))).first()[0] == "0.82"


@pytest.mark.parametrize("text", ["Eins. Zwei! 三。四", " x \n\n\t y.\u2028z　", "a\r\nb\x85c", "", "!!! ?", "　字　字 。end"])
def test_packing_agrees_with_the_expressions(spark, text):
    assert packing.paragraphs(text) == one(spark, text, paragraphs)
    assert packing.size(text) == one(spark, text, size_of) == size(text)
    for p in packing.paragraphs(text):
        assert packing.sentences(p) == one(spark, p, sentences)


def test_packing_is_linear():
    import time

    began = time.time()
    long = "\n".join("word " * 5 for _ in range(200_000))
    assert sum(c.count("word") for c in packing.chunks(long, 300, 400, 0)) == 1_000_000
    assert "".join(packing.hard_split("字a" * 300_000, 400)) == "字a" * 300_000
    assert time.time() - began < 60


def test_chunks_of_null(spark):
    assert one(spark, None, chunk) is None and one(spark, None, lambda c: hard_split(c, 5)) is None
