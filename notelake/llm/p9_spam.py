"""Problem 9: keyword-stuffed and link-list pages by an n-gram model over function words and word classes.

A page becomes a sequence of classes: function words by language and kind, addresses, tags, and content words by how
lately the page used them; a word that crowds its surroundings is a keyword, unless it labels records (mostly near
varying numbers, or first on its line: timetables, prices, results), whose words, like numbers and marks, are no part of the
sequence. A trigram model of classes is trained on the corpus's prose pages (counted over all of them). Windows whose mean
surprisal is abnormally high or low against the windows of prose are spam windows, whatever made them so; a page is
spam if they hold more than half of its printed signs. Nothing but the model decides.

Null, empty and blank pages are no spam. Without any prose page nothing is flagged. Repeated pages are each
reported; further columns don't matter; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import runtime


@dataclass(frozen=True)
class SpamConfig:
    window: int = 24             # tokens per window
    near: int = 6                # content words back that make a repetition fresh
    prose_function: float = 0.22  # share of function words from which a page trains the model
    prose_fresh: float = 0.12     # share of fresh repetitions up to which it does
    high: float = 1.6            # standard deviations above prose from which a window's perplexity is abnormal
    low: float = 4.0             # and below it
    margin: float = 0.6          # bits by which an abnormal window differs from prose at least
    clip: float = 7.0            # bits that one class counts at most, so that a single address is no abnormal window
    crowd: int = 4               # occurrences among the 80 content words around that make a word a keyword
    label: float = 0.7           # share of its occurrences by a number or at line starts that makes a word a label
    most: float = 0.5            # share of a page's signs in such windows that makes it spam


# Function words by language and kind.
FUNCTION_WORDS = {
    "en": {
        "article": "the a an this that these those some any each every no",
        "preposition": "of in on at by for from with to into near next over under after before during since until about without between",
        "conjunction": "and or but so because while when if unless whenever although as than that whether",
        "pronoun": "i you he she it we they me him her us them my your his its our their who which what nobody everybody one",
        "auxiliary": "is are was were be been being has have had do does did can could will would shall should may must not",
    },
    "de": {
        "article": "der die das den dem des ein eine einen einem einer eines kein keine jede jeder jedes",
        "preposition": "in im an am auf aus bei von vom zu zum zur mit nach neben über unter vor seit ohne für um durch",
        "conjunction": "und oder aber denn weil obwohl damit während bis sobald als wenn daß dass ob so wie",
        "pronoun": "ich du er sie es wir ihr mich mir uns sein ihre wer was niemand alle welche welcher welches",
        "auxiliary": "ist sind war waren sei wird werden wurde hat haben hatte kann muß muss soll nicht",
    },
    "fr": {
        "article": "le la les l un une des du de d ce cette ces chaque aucun aucune",
        "preposition": "à au aux en dans sur sous par pour près avec sans avant après depuis entre vers chez",
        "conjunction": "et ou mais car donc si quand comme que qu parce pendant lorsque puisque dès",
        "pronoun": "je tu il elle nous vous ils elles me te se lui leur notre votre son sa ses qui quoi personne tout",
        "auxiliary": "est sont était étaient être a ont avait avoir fait ne pas",
    },
    "ja": {
        "particle": "の は が を に で と も へ や か から まで より など って ね よ",
        "ending": "です ます した して する だった だ では ない という ことに と思う",
    },
}
#: Classes up to the first that is a word are no part of the sequence.
CLASSES = ["<s>", "number", "label", "stop", "comma", "divider", "mark", "address", "tag", "keyword", "new", "far", "near", "fresh", "phrase", "kana"]
CLASSES += [f"{lang}:{kind}" for lang, kinds in FUNCTION_WORDS.items() for kind in kinds]
_ID = {c: i for i, c in enumerate(CLASSES)}
K = len(CLASSES)
_FUNCTION: dict[str, int] = {}
for _lang, _kinds in FUNCTION_WORDS.items():
    for _kind, _words in _kinds.items():
        for _w in _words.split():
            _FUNCTION.setdefault(_w, _ID[f"{_lang}:{_kind}"])
_FIRST_WORD, _FIRST_FUNCTION = _ID["address"], _ID["en:article"]
_MARKS = {**dict.fromkeys(".!?。！？…", _ID["stop"]), **dict.fromkeys(",、，", _ID["comma"]), **dict.fromkeys(";|·>:/•", _ID["divider"])}

#: Marks of word breaks at line ends.
_BREAK = re.compile(r"[-¬=­]\s*\n\s*")
_ADDRESS = r"(?P<address>(?:https?://|www\.)\S+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,8}/\S*)|(?P<tag>[#＃]\w+)|"
_PLAIN = (
    r"(?P<number>\d[\d.,:½¼¾/]*\w*)|(?P<kana>[ぁ-ゟ]+)"
    r"|(?P<word>[゠-ヿ]+|[㐀-鿿々]+|[^\W\d_ぁ-ヿ㐀-鿿]+(?:[-'’][^\W\d_ぁ-ヿ㐀-鿿]+)*)|(?P<line>\n)|(?P<mark>[^\w\s])"
)
_TOKEN = re.compile(_ADDRESS + _PLAIN)
_SPLIT, _SPLIT_PLAIN = (re.compile(re.sub(r"\(\?P<\w+>", "(?:", p)) for p in (_ADDRESS + _PLAIN, _PLAIN))
#: A text without any of these has no address and no tag, so the plain pattern finds the same tokens.
_LINKED = re.compile(r"[/#＃]|www\.")


_CONTENT, _LINE = -1, -2
_KNOWN: dict[str, int] = {}


def _class_of(tok: str) -> int:
    """Class of a token by its form; _CONTENT for content words, whose class depends on the page."""
    kind = _TOKEN.match(tok).lastgroup
    if kind == "line":
        k = _LINE
    elif kind == "word":
        k = _FUNCTION.get(tok, _CONTENT)
    elif kind == "kana":
        k = _FUNCTION.get(tok, _ID["kana"])
    elif kind == "mark":
        k = _MARKS.get(tok, _ID["mark"])
    else:
        k = _ID[kind]
    if len(_KNOWN) > 300_000:
        _KNOWN.clear()
    _KNOWN[tok] = k
    return k


def classify(text: str, c: SpamConfig) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Class and printed length of every token of a page's sequence, the signs of all its tokens, and whether it is prose.

    A keyword is a content word crowding its surroundings, unless it is the label or unit of a record:
    mostly near a number (times, prices, weather), or mostly first on its line.
    """
    classes: list[int] = []
    lengths: list[int] = []
    at: dict[str, list[int]] = {}
    order: list[int] = []
    first_on_line: list[bool] = []
    number_at: list[tuple[int, str]] = []
    n_content, last_gap, new_line = 0, 0, True
    fresh, phrase, near, far, new = (_ID[k] for k in ("fresh", "phrase", "near", "far", "new"))
    joined = _BREAK.sub("", text.lower())
    split = _SPLIT if _LINKED.search(joined) else _SPLIT_PLAIN
    number = _ID["number"]
    for tok in split.findall(joined):
        k = _KNOWN.get(tok)
        if k is None:
            k = _class_of(tok)
        if k == _CONTENT:
            seen = at.setdefault(tok, [])
            gap = n_content - order[seen[-1]] if seen else 10_000
            if gap <= c.near:
                # A whole phrase that returns (a refrain) repeats word after word at one distance.
                k = phrase if gap == last_gap and gap > 3 else fresh
            elif gap <= 40:
                k = phrase if gap == last_gap else near
            else:
                k = far if gap < 10_000 else new
            seen.append(len(classes))
            last_gap = gap
            n_content += 1
        elif k == _LINE:
            new_line = True
            continue
        elif k == number:
            number_at.append((len(classes), tok))
        classes.append(k)
        lengths.append(len(tok))
        order.append(n_content - 1)
        first_on_line.append(new_line)
        new_line = False
    seq = np.array(classes, np.uint8)
    prose = is_prose(seq, c)
    # Records have varying numbers; one number that makes up most of a page's ("24h") is stuffing too.
    varying = seq == number
    for usual, times in Counter(x for _, x in number_at).most_common(1):
        if times > max(3, len(number_at) // 2):
            varying[[i for i, x in number_at if x == usual]] = False
    near_number = np.convolve(varying, np.ones(7, np.int64), "same")[:len(seq)] > 0 if len(seq) >= 7 else varying
    content = np.array(order, np.int64)
    first = np.array(first_on_line, bool)
    for seen in at.values():
        if len(seen) < c.crowd:
            continue
        p = np.array(seen)
        where = content[p]
        crowded = p[np.searchsorted(where, where + 40, "right") - np.searchsorted(where, where - 40, "left") >= c.crowd]
        seq[crowded] = _ID["label" if near_number[p].mean() >= c.label or first[p].mean() >= c.label else "keyword"]
    signs = np.minimum(np.array(lengths, np.int64), 255).astype(np.uint8)
    words = seq >= _FIRST_WORD
    return seq[words], signs[words], int(signs.sum(dtype=np.int64)), prose


def is_prose(classes: np.ndarray, c: SpamConfig) -> bool:
    words = classes >= _ID["new"]
    n = max(1, int(words.sum()))
    function = int((classes >= _FIRST_FUNCTION).sum()) + int((classes == _ID["kana"]).sum())
    if np.isin(classes, (_ID["address"], _ID["tag"])).any():
        return False  # an article's closing links would teach the model that links follow links
    return len(classes) >= 2 * c.window and function / n >= c.prose_function and int((classes == _ID["fresh"]).sum()) / n <= c.prose_fresh


def _codes(classes: np.ndarray) -> np.ndarray:
    x = np.concatenate([[0, 0], classes]).astype(np.int64)
    return (x[:-2] * K + x[1:-1]) * K + x[2:]


def surprisal_table(counts: np.ndarray, clip: float) -> np.ndarray:
    """Bits, at most `clip`, per class after two classes, from trigram counts of shape (K ** 3,): interpolated, each order backed by the lower."""
    tri = counts.reshape(K, K, K).astype(float)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * K)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.minimum(-np.log2(p3), clip).astype(np.float32).ravel()


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    """Mean of the window around each token (shorter at the ends)."""
    n = len(values)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    lo = np.maximum(np.arange(n) - width // 2, 0)
    hi = np.minimum(lo + width, n)
    lo = np.maximum(hi - width, 0)
    return (total[hi] - total[lo]) / (hi - lo)


def spam_share(classes: np.ndarray, lengths: np.ndarray, n_signs: int, bits: np.ndarray, usual: tuple[float, float, float], c: SpamConfig) -> tuple[float, float]:
    """(share of the page's signs in windows of abnormal perplexity, mean surprisal). usual: prose's mean, what is high and what low above it.

    On a page of fewer tokens than a window means vary more, so more is usual.
    """
    if not len(classes):
        return 0.0, 0.0
    s = bits[_codes(classes)]
    s[:2] = usual[0]  # nothing goes before them that could make them abnormal
    over = (_windows(s, c.window) - usual[0]) * min(1.0, len(s) / c.window) ** 0.5
    spam = (over > usual[1]) | (over < usual[2])
    return float((lengths.astype(float) * spam).sum() / max(n_signs, 1)), float(s.mean())


def scores(documents: DataFrame, c: SpamConfig = SpamConfig()) -> DataFrame:
    """(doc_id, spam_share, perplexity, keyword_share, is_spam) of every page with a sign on it; keyword_share explains only."""
    spark = documents.sparkSession
    runtime.ship(spark)

    def classified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [classify(t, c) for t in f["text"]]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "classes": [x[0].tobytes() for x in done], "lengths": [x[1].tobytes() for x in done],
                "n_signs": [x[2] for x in done], "prose": [x[3] for x in done],
            })

    pages = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    seqs = runtime.cut(runtime.spread(pages).mapInPandas(classified, "doc_id long, classes binary, lengths binary, n_signs long, prose boolean").where("n_signs > 0"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K ** 3, np.int64)
        for f in frames:
            for b in f["classes"]:
                total += np.bincount(_codes(np.frombuffer(b, np.uint8)), minlength=K ** 3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    # At most one row per trigram of classes, whatever the corpus: a table of fixed size for the driver.
    grams = seqs.where("prose").select("classes").mapInPandas(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(K ** 3, np.int64)
    for r in grams:
        counts[r["code"]] = r["n"]
    bits = spark.sparkContext.broadcast(surprisal_table(counts, c.clip))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, 0.0, 0.0
        for f in frames:
            for b in f["classes"]:
                w = _windows(bits.value[_codes(np.frombuffer(b, np.uint8))], c.window)[c.window // 2::c.window]
                n, s, q = n + len(w), s + float(w.sum()), q + float((w * w).sum())
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q]})

    r = seqs.where("prose").select("classes").mapInPandas(spread, "n long, s double, q double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    usual = (0.0, float("inf"), float("-inf"))
    if r["n"]:
        mean = r["s"] / r["n"]
        sd = max(r["q"] / r["n"] - mean * mean, 0.0) ** 0.5
        usual = (mean, max(c.high * sd, c.margin), -max(c.low * sd, c.margin))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            classes = [np.frombuffer(b, np.uint8) for b in f["classes"]]
            got = [spam_share(x, np.frombuffer(b, np.uint8), n, bits.value, usual, c) for x, b, n in zip(classes, f["lengths"], f["n_signs"], strict=True)]
            keywords = [float(np.isin(x, (_ID["keyword"], _ID["address"], _ID["tag"])).mean()) if len(x) else 0.0 for x in classes]
            yield pd.DataFrame({"doc_id": f["doc_id"], "spam_share": [x for x, _ in got], "perplexity": [2.0 ** x for _, x in got], "keyword_share": keywords})

    result = seqs.select("doc_id", "classes", "lengths", "n_signs").mapInPandas(scored, "doc_id long, spam_share double, perplexity double, keyword_share double")
    return result.withColumn("is_spam", F.col("spam_share") > c.most)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(runtime.read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("is_spam").select("doc_id").distinct()
