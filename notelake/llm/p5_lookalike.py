"""Problem 5: one form for text that looks the same.

Tokens are read as they stand, with whatever invisible signs, combining marks, wide or foreign letters they hold. Those that
hold any, and those whose reading is spelled in several ways in the corpus, are looked up in tries of the corpus
vocabulary (its spellings in one alphabet, with their numbers) by a weighted edit automaton, for which look-alikes,
widths, compositions and ignorables cost nothing: of the words reached the most frequent is the canonical spelling, for
the word itself too. Tokens that reach no word take the spelling of a table: the alphabet of their letters
without a look-alike, or Latin if all have one. The signs between tokens are normalised by a character table (width,
composition, ligatures and squared signs, blanks, hyphens, invisible code points).

Only words whose skeleton (Latin letters for look-alikes) is asked for or contested can be reached at cost zero, or be respelled, so
only they enter the tries; a trie holds those of one shard of skeletons, so no word list is ever held whole.

Nulls give null, empty and blank texts give the normalised (empty or blank) text and never form pairs;
repeated rows and further columns don't matter; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import runtime
from notelake.llm.tables import distinct_notes

# Letters of other alphabets with the shape of a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХасеорхуіјѕԁһԛԝ", "ABESIJKMHOPCTYXaceopxyijsdhqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ", "ABEZHIKMNOPTYXvocj", strict=True))
# Hyphens that read as the ASCII one, and line ends that read as a line feed.
HYPHENS = "\u2010\u2011\u2012\u2212\uFE63\uFF0D"
LINE_ENDS = "\u0085\u2028\u2029\x0b\x0c"
# Compatibility kinds that only restyle a sign; superscripts, circles and fractions are kept.
RESTYLED = {"<wide>", "<narrow>", "<square>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>"}

LOOKALIKE = CYRILLIC | GREEK
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}
#: Invisible code points that are no format signs by category.
FILLERS = (0x034F, 0x115F, 0x1160, 0x3164)


def _ignorable(cp: int) -> bool:
    return cp in FILLERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or unicodedata.category(chr(cp)) == "Cf"


def _ranges(test) -> str:
    """Inside of a character class of the code points that pass."""
    out, begin = [], None
    for cp in [*range(0x3000), *range(0xA600, 0xAC00), *range(0xFB00, 0x11000), *range(0xE0000, 0xE0200)]:
        if test(cp):
            if begin is None or cp != last + 1:
                begin = cp
                out.append([cp, cp])
            out[-1][1] = last = cp
        else:
            begin = None
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in out)


_JOINED = _ranges(lambda cp: unicodedata.category(chr(cp))[0] == "M" or _ignorable(cp))
#: Letters with what may stand invisibly among them.
TOKEN = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_JOINED}])*")
LOOKALIKES = re.compile("[" + "".join(LOOKALIKE) + "]")
#: Latin letters that another alphabet has in the same shape.
SHARED = "".join(sorted(set(LOOKALIKE.values())))


class _CharTable(dict):
    """str.translate table, filled as code points come up."""

    def __missing__(self, cp: int):
        ch, out = chr(cp), None
        cat = unicodedata.category(ch)
        if ch in HYPHENS:
            out = "-"
        elif ch in LINE_ENDS:
            out = "\n"
        elif cat == "Zs":
            out = " "
        elif _ignorable(cp):
            out = ""
        elif ch != "…":
            d = unicodedata.decomposition(ch)
            if d.startswith("<") and d.split(" ", 1)[0] in RESTYLED:
                out = unicodedata.normalize("NFKC", ch)
        self[cp] = out = ch if out is None else out
        return out


_TABLE = _CharTable()


def normalise(text: str) -> str:
    """The table's form: everything but the choice of alphabet for look-alike letters."""
    if text.isascii() and "\r" not in text:
        return text
    t = text.replace("\r\n", "\n").replace("\r", "\n").translate(_TABLE)
    return unicodedata.normalize("NFC", t)


def fold(token: str) -> str:
    """Latin skeleton; equal for tokens that read the same."""
    return "".join(LOOKALIKE.get(c, c) for c in token)


def by_table(token: str) -> str:
    """Spelling by the alphabet of the letters that have no look-alike; Latin if there are none."""
    base = fold(token)
    for ch in base:
        if ch.isascii() and ch not in TO_CYRILLIC and ch not in TO_GREEK:
            return base
    script = {unicodedata.name(c, "?").split(" ", 1)[0] for c in base if not c.isascii()}
    if "CYRILLIC" in script:
        return "".join(TO_CYRILLIC.get(c, c) for c in base)
    if "GREEK" in script:
        return "".join(TO_GREEK.get(c, c) for c in base)
    return base


def in_one_alphabet(token: str) -> bool:
    """Whether a token's letters are of one of the alphabets that share shapes: fit for the vocabulary."""
    kinds = {unicodedata.name(c, "?").split(" ", 1)[0] for c in token} & {"LATIN", "CYRILLIC", "GREEK"}
    return len(kinds) <= 1


def _decomposed(token: str) -> str:
    """Without width and composition; invisible signs stay, for the automaton."""
    return unicodedata.normalize("NFD", "".join(c if _ignorable(ord(c)) else c.translate(_TABLE) for c in token))


class Trie:
    """Vocabulary trie over decomposed words; nodes are dicts, the key None holds the (count, word)s that end there."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for ch in _decomposed(word):
            node = node.setdefault(ch, {})
        node.setdefault(None, []).append((count, word))

    def nearest(self, token: str, budget: float = 0.0) -> str | None:
        """Cheapest word within the edit budget, of these the most frequent, then the smaller; look-alikes and ignorables are free."""
        states = [(0.0, self.root)]
        for ch in _decomposed(token):
            base = LOOKALIKE.get(ch, ch)
            if _ignorable(ord(ch)):
                continue
            nxt = {}
            for cost, node in states:
                steps = [(cost + 1.0, node)] if cost + 1.0 <= budget else []
                for c, child in node.items():
                    if c is not None:
                        step = cost if c == ch or LOOKALIKE.get(c, c) == base else cost + 1.0
                        if step <= budget:
                            steps.append((step, child))
                for x, n in steps:
                    if id(n) not in nxt or nxt[id(n)][0] > x:
                        nxt[id(n)] = (x, n)
            states = list(nxt.values())
            if not states:
                return None
        ends = [(cost, -count, word) for cost, n in states for count, word in n.get(None, [])]
        return min(ends)[2] if ends else None


def suspects(text: str, norm: str) -> list[str]:
    """Distinct tokens that hold look-alikes of Latin letters, or aren't in their normal form; norm: the text's normal form."""
    clean = norm == text
    if text.isascii() or (clean and not LOOKALIKES.search(text)):
        return []
    return sorted({t for t in TOKEN.findall(text) if not t.isascii() and (LOOKALIKES.search(t) or (not clean and normalise(t) != t))})


def spellings(base: DataFrame, shard_words: int = 200_000) -> DataFrame:
    """base(norm, suspects ARRAY<STRUCT<token, skeleton>>) -> (token, spelling): every asked or contested token and its canonical spelling."""
    alike = F.translate(F.col("token"), "".join(LOOKALIKE), "".join(LOOKALIKE.values()))
    asked = base.select(F.explode("suspects").alias("s")).select("s.token", "s.skeleton").distinct()
    words = runtime.cut(
        base.select(F.explode(F.regexp_extract_all("norm", F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n")).withColumn("skeleton", alike)
    )
    contested = words.groupBy("skeleton").agg(F.count("*").alias("k")).where("k > 1").select("skeleton")
    wanted = asked.select("skeleton").union(contested).distinct()
    vocabulary = words.join(wanted, "skeleton", "left_semi").select("skeleton", "token", "n")
    both = runtime.cut(vocabulary.unionByName(asked.select("skeleton", "token", F.lit(None).cast("long").alias("n"))))
    shards = max(runtime.slots(base.sparkSession), -(-both.count() // shard_words))

    def look_up(f: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        counted = f["n"].notna()
        for w, c in zip(f.loc[counted, "token"], f.loc[counted, "n"], strict=True):
            if in_one_alphabet(w):
                trie.add(w, int(c))
        tokens = sorted(set(f["token"]))
        return pd.DataFrame({"token": tokens, "spelling": [trie.nearest(t) or by_table(normalise(t)) for t in tokens]})

    return both.withColumn("shard", F.pmod(F.xxhash64("skeleton"), F.lit(shards))).groupBy("shard").applyInPandas(look_up, "token string, spelling string")


def canonical_texts(texts: DataFrame) -> DataFrame:
    """texts(text_key, text) -> (text_key, canonical). text_key is unique."""
    spark = texts.sparkSession
    runtime.ship(spark)
    key = dict(texts.dtypes)["text_key"]

    def normed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            norm = [None if x is None else normalise(x) for x in f["text"]]
            yield pd.DataFrame({
                "text_key": f["text_key"], "text": f["text"], "norm": norm,
                "suspects": [[] if x is None else [{"token": t, "skeleton": fold(normalise(t))} for t in suspects(x, y)] for x, y in zip(f["text"], norm, strict=True)],
            })

    base = runtime.cut(runtime.spread(texts.select("text_key", "text")).mapInPandas(normed, f"text_key {key}, text string, norm string, suspects array<struct<token:string,skeleton:string>>"))
    changed = runtime.cut(spellings(base.select("norm", "suspects")).where("token <> spelling"))
    # Tokens of a text that may change: its suspects, and Latin words of which every letter has a look-alike.
    latin = F.regexp_extract_all("norm", F.lit(rf"(?<![\p{{L}}\p{{M}}])([{SHARED}]+)(?![\p{{L}}\p{{M}}])"), F.lit(1))
    may = base.select("text_key", F.explode(F.array_union(F.transform("suspects", lambda x: x["token"]), latin)).alias("token"))
    per_text = may.join(changed, "token").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("spellings"))

    def respell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t, m in zip(f["text"], f["spellings"], strict=True):
                m = dict(m)
                out.append(normalise(TOKEN.sub(lambda x, m=m: m.get(x[0], x[0]), t)))
            yield pd.DataFrame({"text_key": f["text_key"], "canonical": out})

    joined = runtime.cut(per_text)
    dirty = base.join(joined, "text_key").select("text_key", "text", "spellings").mapInPandas(respell, f"text_key {key}, canonical string")
    clean = base.join(joined.select("text_key"), "text_key", "left_anti").select("text_key", F.col("norm").alias("canonical"))
    return clean.unionByName(dirty)


def fields_of(notes: DataFrame) -> DataFrame:
    """(field_name, note_id, text) of titles and contents of distinct notes, nulls left out."""
    d = distinct_notes(notes)
    return d.select(F.explode(F.array(
        F.struct(F.lit("title").alias("field_name"), "note_id", F.col("title").alias("text")),
        F.struct(F.lit("content").alias("field_name"), "note_id", F.col("content").alias("text")),
    )).alias("f")).select("f.*").where("text is not null")


def _key(column: str):
    """Half of a digest: 16 bytes that name a text."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def canonical_fields(notes: DataFrame) -> DataFrame:
    """(field_name, note_id, text, canonical): titles and contents of all distinct notes in one form."""
    f = fields_of(notes).withColumn("text_key", _key("text"))
    texts = f.groupBy("text_key").agg(F.first("text").alias("text"))
    return f.join(canonical_texts(texts), "text_key").select("field_name", "note_id", "text", "canonical")


def alike_pairs(notes: DataFrame) -> DataFrame:
    """(field_name, note_id_a, note_id_b), a < b: fields that read the same and are different code points.

    Notes are grouped into classes of equal text, classes into readings; only classes of one reading
    that differ are joined, so equal texts, however many, never meet. Each note of a class is linked to the smallest note of
    the other class, so many copies on both sides don't make all their pairs.
    """
    f = fields_of(notes).where(F.trim(F.regexp_replace("text", r"[\s\p{Z}\p{Cf}]+", "")) != "").withColumn("text_key", _key("text"))
    texts = f.groupBy("text_key").agg(F.first("text").alias("text"))
    reading = runtime.cut(canonical_texts(texts).select("text_key", _key("canonical").alias("reading")))
    several = reading.groupBy("reading").agg(F.count("*").alias("n")).where("n > 1").select("reading")
    classes = runtime.cut(reading.join(several, "reading"))
    member = runtime.cut(f.select("field_name", "note_id", "text_key").join(classes, "text_key"))
    first = member.groupBy("reading", "field_name", "text_key").agg(F.min("note_id").alias("other_id")).withColumnRenamed("text_key", "other_key")
    links = member.join(first, ["reading", "field_name"]).where((F.col("text_key") != F.col("other_key")) & (F.col("note_id") != F.col("other_id")))
    return links.select("field_name", F.least("note_id", "other_id").alias("note_id_a"), F.greatest("note_id", "other_id").alias("note_id_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(runtime.read(spark, sf_dir, "notes"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every canonical field; the text itself comes from canonical_fields()."""
    return canonical_fields(runtime.read(spark, sf_dir, "notes")).select(
        "field_name", "note_id", F.length("canonical").alias("n_chars"), F.sha2("canonical", 256).alias("canonical_sha"),
    )
