"""Packing of texts into chunks, a batch of texts at a time; every step is linear in the text.

Paragraphs are units; those too large fall into sentences, and sentences too large into pieces of graphemes. Units are
packed up to a target, each chunk begun with the longest tail of the last one that fits the overlap.
"""

from __future__ import annotations

import re

import regex

from notelake.functions.text_size import CJK_RANGES

# White space and line ends of the size estimate.
LINE_ENDS = "\n\x0b\f\r\x85\u2028\u2029"
BLANKS = " \t\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
_LINES = re.compile(f"[{LINE_ENDS}]")
_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]+")
_BLANK = re.compile(f"[{BLANKS}{LINE_ENDS}]+")
_SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[ \t\n\x0b\f\r]*|[^.!?。！？]+\Z")
_GRAPHEME = regex.compile(r"\X")


def counts(text: str) -> tuple[int, int]:
    """(CJK, other visible) code points."""
    rest = _CJK.sub("", text)
    return len(text) - len(rest), len(_BLANK.sub("", rest))


def size(text: str) -> int:
    cjk, other = counts(text)
    return cjk + -(-other // 4)


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(BLANKS) for x in _LINES.split(text)) if p]


def sentences(paragraph: str) -> list[str]:
    return [s for s in (x.strip(BLANKS) for x in _SENTENCE.findall(paragraph)) if s]


def hard_split(text: str, most: int) -> list[str]:
    """Pieces of whole graphemes of at most the size (a larger grapheme alone); joined they are the text."""
    out, begin, at, cjk, other = [], 0, 0, 0, 0
    for g in text if text.isascii() and "\r" not in text else _GRAPHEME.findall(text):
        c, o = counts(g)
        if at > begin and cjk + c + -(-(other + o) // 4) > most:
            out.append(text[begin:at])
            begin, cjk, other = at, 0, 0
        at, cjk, other = at + len(g), cjk + c, other + o
    return out + [text[begin:]] if text else []


def units(text: str, most: int) -> list[tuple[str, int]]:
    """(text, size) of the units."""
    out = []
    for p in paragraphs(text):
        n = size(p)
        if n <= most:
            out.append((p, n))
            continue
        for s in sentences(p):
            n = size(s)
            out += [(s, n)] if n <= most else [(x, size(x)) for x in hard_split(s, most)]
    return out


def packed(sizes: list[int], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the units of each chunk."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > target:
            out.append((begin, i))
            tail, kept = i, 0
            while tail > begin and kept + sizes[tail - 1] <= overlap:
                tail -= 1
                kept += sizes[tail]
            begin, total = (tail, kept) if kept + n <= most else (i, 0)
        total += n
    return out + [(begin, len(sizes))] if sizes else []


def chunks(text: str, target: int, most: int, overlap: int) -> list[str]:
    u = units(text, most)
    return ["\n".join(t for t, _ in u[a:b]) for a, b in packed([n for _, n in u], target, most, overlap)]
