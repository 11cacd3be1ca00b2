"""Problem 1: personal data in running text, found by a character-level BiLSTM with CRF transitions.

The tagger (see tagger.py; trained by p1_training.py, its weights are p1_weights.npz) labels every character of a text;
overlapping windows are blended and one path is decoded over the whole text. Of what it tags, the ends are moved to those
of words, marks around, titles and possessives are left out, and what can't be of its kind (a phone without digits) is
dropped; no pattern adds a mention. Mentions come out as rows, or replaced by typed placeholders in the otherwise
unchanged text.

Null, empty and blank texts hold nothing and come out as they are. Texts above 200,000 code points are read in parts that
overlap by 2,000. Repeated rows of a note count once; further columns don't matter; empty tables give empty results.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from notelake import runtime
from notelake.llm.tables import distinct_notes
from notelake.llm.tagger import Tagger

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
# Titles and honorifics, no part of a name.
_TITLE = re.compile(r"^(?:(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle)\b\.?[ 　]+)+")
_HONORIFIC = re.compile(r"[ 　]?(?:さん|様|氏|先生|くん|ちゃん)$")
#: A part of a long text, and what it shares with the next.
PART, SHARED = 200_000, 2_000
#: Windows of decoding, longer than those of training: less text is read twice.
WINDOW, STRIDE = 256, 216


def weights() -> bytes:
    data = pkgutil.get_data("notelake.llm", "p1_weights.npz")
    if data is None:
        raise FileNotFoundError("p1_weights.npz: run notelake.llm.p1_training")
    return data


@lru_cache(maxsize=1)
def _tagger(data: bytes) -> Tagger:
    t = Tagger.load(data)
    t.c = replace(t.c, window=WINDOW, stride=STRIDE)
    return t


def _runs_on(a: str, b: str) -> bool:
    """Whether a word or a number goes on from sign a to sign b."""
    plain = lambda c: c.isalnum() and (c < "\u0250" or "０" <= c <= "９")
    return plain(a) and plain(b)


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """Ends of a tagged mention moved to those of its words, without marks around and titles; None if it can't be of its kind."""
    while end < len(text) and _runs_on(text[end - 1], text[end]):
        end += 1
    while start and _runs_on(text[start - 1], text[start]):
        start -= 1
    piece = text[start:end]
    lead = len(piece) - len(piece.lstrip(" \t\r\n　,.:;、。：！!?？-–—」「\"“”„<>«»・*/" + ("(（" if kind not in ("phone", "address") else "")))
    start, piece = start + lead, piece[lead:].rstrip(" \t\r\n　,:;、。：！!?？「」\"“”„<>«»/(（" + ("" if kind in ("phone", "email") else ")）"))
    if kind == "name":
        title = _TITLE.match(piece)
        start, piece = (start + title.end(), piece[title.end():]) if title else (start, piece)
        piece = _HONORIFIC.sub("", re.sub(r"['’]s?$", "", piece))
        if piece.endswith(".") and not re.search(r"\b[A-Z]\.$", piece):
            piece = piece[:-1]
        if len(piece) < 2 or any(c.isdigit() or c in "\r\n@" for c in piece) or (piece.isascii() and not re.search(r"[A-Z][A-Za-z]", piece)):
            return None
        return start, start + len(piece)
    if kind != "address":
        piece = re.split(r"[;；,、。]", piece)[0].rstrip()  # no such number or address goes on after these
    piece = piece.rstrip(".")
    for left, right in ("()", "（）"):
        if piece.startswith(left) and right not in piece:
            start, piece = start + 1, piece[1:]
        elif right in piece and left not in piece:
            if start and text[start - 1] == left:
                start, piece = start - 1, left + piece
            elif piece.endswith(right):
                piece = piece[:-1]
    digits = sum(c.isdigit() for c in piece)
    possible = {
        "email": bool(re.search(r"@|＠|\bat\b", piece)), "phone": digits >= 6, "id_number": digits >= 4 and len(piece) >= 6,
        "address": digits > 0 and bool(re.search(r"[\s,、市区町]", piece)),
    }
    return (start, start + len(piece)) if piece and possible[kind] else None


def mentions_of(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Checked mentions (start, end, kind) of each text, in order, without overlaps.

    A text longer than a part is read in parts that overlap; a mention is taken from the part in which its middle lies deeper.
    """
    parts: list[tuple[int, int, int]] = []
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + PART)
            parts.append((k, at, end))
            at = end - SHARED if end < len(t) else end
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    first = 0
    while first < len(parts):
        last, total = first, 0
        while last < len(parts) and (last == first or total + parts[last][2] - parts[last][1] <= PART):
            total += parts[last][2] - parts[last][1]
            last += 1
        for (k, at, end), spans in zip(parts[first:last], tagger.spans([texts[k][a:b] for k, a, b in parts[first:last]]), strict=True):
            low, high = at + SHARED // 2 if at else 0, end - SHARED // 2 if end < len(texts[k]) else end + 1
            found[k] += [(a + at, b + at, kind) for a, b, kind in spans if low <= at + (a + b) // 2 < high]
        first = last
    out = []
    for t, spans in zip(texts, found, strict=True):
        clean, last = [], 0
        for a, b, kind in sorted(spans):
            ends = checked(t, a, b, kind)
            if ends and ends[0] >= last:
                clean.append((*ends, kind))
                last = ends[1]
        out.append(clean)
    return out


def redact(text: str, mentions: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in mentions:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def _apply(notes: DataFrame, schema: str, rows) -> DataFrame:
    spark = notes.sparkSession
    runtime.ship(spark)
    sent = spark.sparkContext.broadcast(weights())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(sent.value)
        for f in frames:
            f = f.assign(n=f["content"].str.len()).sort_values("n", kind="stable")
            yield rows(f["note_id"].tolist(), f["content"].tolist(), mentions_of(f["content"].tolist(), tagger))

    return runtime.spread(notes.where("content is not null").select("note_id", "content")).mapInPandas(run, schema)


def mentions(notes: DataFrame) -> DataFrame:
    """notes(note_id, content) -> (note_id, kind, start_pos, end_pos, found_text)."""

    def rows(ids, texts, found):
        r = [(i, kind, a, b, t[a:b]) for i, t, m in zip(ids, texts, found, strict=True) for a, b, kind in m]
        return pd.DataFrame(r, columns=["note_id", "kind", "start_pos", "end_pos", "found_text"])

    return _apply(notes, "note_id long, kind string, start_pos long, end_pos long, found_text string", rows)


def redacted(notes: DataFrame) -> DataFrame:
    """notes(note_id, content) -> (note_id, content, n_replaced); notes without content are left out."""

    def rows(ids, texts, found):
        return pd.DataFrame({"note_id": ids, "content": [redact(t, m) for t, m in zip(texts, found, strict=True)], "n_replaced": [len(m) for m in found]})

    return _apply(notes, "note_id long, content string, n_replaced int", rows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(distinct_notes(runtime.read(spark, sf_dir, "notes"))).select("note_id", "kind", "found_text").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(distinct_notes(runtime.read(spark, sf_dir, "notes")))
