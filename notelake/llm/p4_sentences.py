"""Problem 4: sentence boundaries across languages and scripts, in SQL expressions only.

Terminators that end nothing (in decimals, addresses, file names, initials, abbreviations, ordinals,
list numbers, trailing-off dots) are masked by private-use placeholders, one code point for one. The masked
text is tiled by one regular expression with the terminators of all scripts; quoted speech and
brackets count as one unit. The placeholders of each sentence are then turned back into what they stand for.

Thai statements are closed by a blank between Thai letters. Null, empty and blank texts have no sentences. A line without a terminator is one sentence. Repeated
rows of a note count once; further columns don't matter; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake import runtime
from notelake.llm.tables import distinct_notes

#: Marks a terminator that ends no sentence, in front of it, until all are found; then both become its placeholder.
MARK = "\ue000"
#: Stands for a blank that closes a statement in Thai, which has no terminators.
CLOSE = "\ue001"
NL = r"\n\x0B\f\r\x{85}\x{2028}\x{2029}"
TERM = ".!?。！？．｡…؟۔।॥" + CLOSE
BLANK = r"[\p{Zs}\t]"

# Abbreviations that never end a sentence, whatever follows.
NEVER_LAST = (
    "Mr Mrs Ms Dr Prof St Mt vs approx e.g i.e Messrs Capt Sgt Gen Col Hon cf viz ver "
    "Nr Vgl vgl bzw ca z.B d.h Hr Fr Abb Bd Str "
    "M MM Mme Mmes Mlle env Env chap "
    "т.е см ул им проф рис стр "
    "د أ डॉ श्री"
).split()
# Abbreviations that may end a sentence; they do so before a capital, a quote or the line's end.
MAYBE_LAST = (
    "etc a.m p.m lb lbs oz ft in kg ext al Inc Ltd Co Corp Jr Sr dept ed "
    "usw u.a evtl ggf Tel o.ä "
    "т.д т.п др пр г руб"
).split()
# Abbreviations only before a number.
BEFORE_NUMBER = "No Nos no fig figs Fig vol vols Vol ch p pp P S Nr Art art sec Sec n".split()
# Months after a German ordinal.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Aug Sept Okt Nov Dez Jahrhundert".split()
# Words by which a sentence goes on after quoted speech.
GOES_ON = "said says asked replied answered cried shouted whispered wrote added and but or while then as he she they dit demanda répondit ajouta sagte fragte rief schrieb und aber сказал сказала спросил спросила".split()


def _abbr(words: list[str]) -> str:
    """After a dot, that it follows any of words; their inner dots may be marked and spaced."""
    alts = []
    for w in sorted(words, key=len, reverse=True):
        alts.append(rf"{MARK}?\.{BLANK}?".join(w.split(".")))
    return rf"(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(alts)})\.)"


#: Placeholders by terminator, one code point for one, so that positions stay.
PLACEHOLDERS = dict(zip(".?!…．", "\ue002\ue003\ue004\ue005\ue006", strict=True))

_RUN = r"\p{Lu}\p{N}_.\-"
#: Inside addresses, which may be of any length: each match goes on where the last one ended.
IN_LINK = r"((?:://|\G(?!\A))[^\s。！？.?!]*+)([.?!])(?=[\p{L}\p{N}])"
IN_DOMAIN = r"((?:[@＠]|\G(?!\A))[\p{L}\p{N}_\-]*+)(\.)(?=[\p{L}\p{N}])"
IN_MAILBOX = rf"((?:(?<![{_RUN}{MARK}])(?=[{_RUN}{MARK}]++[@＠])|\G(?!\A))[{_RUN.replace('.', '')}]*+)(\.)(?=[{_RUN}])"
#: After a list number or letter at the begin of a line.
LIST_MARK = rf"((?:\A|[{NL}])[\p{{Zs}}\t]*+(?:\p{{N}}{{1,4}}|[A-Za-z]))([.．])(?={BLANK})"

#: Terminators that end no sentence, by themselves or by what is beside them, in one pattern that is tried at terminators only.
_DOTS = (
    r"(?<=\p{N}\.)(?=\p{N})",
    r"(?<=[\p{L}\p{N}_\-/]\.)(?=[\p{Ll}\p{N}_])",
    rf"(?={BLANK}{{0,2}}\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?<!\p{{N}}\p{{Zs}})\p{{Lu}}\.)",
    rf"(?<=\p{{N}}\.)(?={BLANK}+(?:{'|'.join(MONTHS)}|\p{{Ll}}))",
    r"(?=[,;:])",
    _abbr(["z", "d", "u", "o", "т"]) + rf"(?={BLANK}?(?:B|h|a|ä|е|д|п)\.)",
    _abbr(NEVER_LAST),
    _abbr(BEFORE_NUMBER) + rf"(?={BLANK}*\p{{N}})",
    _abbr(MAYBE_LAST) + rf"(?={BLANK}*[^\p{{Zs}}\t{NL}\p{{Lu}}“\"«„(])",
    rf"(?<=\.\.)(?={BLANK}*[^\p{{Zs}}\t{NL}\p{{Lu}}.])",
    rf"(?=[.{MARK}])",
)
ONE_OF = (
    rf"(?=[.?…])(?<!{MARK})(?:\.(?:{'|'.join(_DOTS)})|\?(?=[\p{{L}}\p{{N}}_]++=)"
    # Dots that trail off: the sentence goes on unless a capital or another terminator follows.
    rf"|…(?:(?={BLANK}*[^\p{{Zs}}\t{NL}\p{{Lu}}{TERM}”\"»」』)）])|(?=[…{MARK}])))"
)

_QUOTE = rf"(?:“[^”{NL}]*+”|«[^»{NL}]*+»|「[^」{NL}]*+」|『[^』{NL}]*+』|„[^“{NL}]*+“|\"[^\"{NL}]*+\")"
_BRACKET = rf"(?:\([^(){NL}]*+\)|（[^（）{NL}]*+）|\[[^\[\]{NL}]*+\])"
_OPENERS = "“«「『„\"(（["
_CLOSERS = r"[)\]}\"”’»」』）】]"
#: A quote that closes a statement within a sentence, before a new sentence.
_QUOTE_END = rf"{_QUOTE}(?<=[.!?][”»“\"])(?={BLANK}+[\p{{Lu}}“«\"])"
#: A quote that is a sentence of its own, at a sentence's start.
_QUOTE_ALONE = rf"{BLANK}*+{_QUOTE}(?<=[.!?][”»“\"])(?={BLANK}*+(?:$|[{NL}])|{BLANK}++(?!(?:{'|'.join(GOES_ON)})(?![\p{{L}}\p{{M}}])|[,—–-]))"
_BRACKET_ALONE = rf"{BLANK}*+{_BRACKET}(?<=[{TERM}][)）\]])"

#: Tiles any text: line ends, a quote or bracket that stands alone, or units up to the terminators.
SENTENCE = (
    rf"[{NL}]++|{_QUOTE_ALONE}|{_BRACKET_ALONE}"
    # Letters and blanks first: these classes are one look-up, the one of all but the marks is many.
    rf"|(?:[A-Za-z0-9 ,;:'-]++|[\p{{L}}\p{{M}}\p{{N}}]++|[^{TERM}{_OPENERS.replace('[', chr(92) + '[')}{NL}]++|(?!{_QUOTE_END})(?:{_QUOTE}|{_BRACKET})|(?!{_QUOTE}|{_BRACKET})[{_OPENERS.replace('[', chr(92) + '[')}])*+"
    rf"(?:{_QUOTE_END}|[{TERM}]++{_CLOSERS}*+)?+"
)


#: Blanks between Thai letters; those beside numbers and other scripts close nothing.
THAI_CLOSE = rf"([\x{{E00}}-\x{{E7F}}]){BLANK}({BLANK}*+)(?=[\x{{E00}}-\x{{E7F}}])"
#: What a sentence has not around it: white space, and the sign of a closing blank.
AROUND = " \t\n\x0b\f\r\x85\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000" + CLOSE


def masked(text: Column) -> Column:
    """The text with placeholders for terminators that end no sentence, as long as before."""
    mark = f"$1{MARK}$2"
    t = F.when(text.contains("://"), F.regexp_replace(text, IN_LINK, mark)).otherwise(text)
    t = F.when(t.contains("@") | t.contains("＠"), F.regexp_replace(F.regexp_replace(t, IN_DOMAIN, mark), IN_MAILBOX, mark)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, LIST_MARK, mark), ONE_OF, f"{MARK}$0")
    for sign, placeholder in PLACEHOLDERS.items():
        t = F.replace(t, F.lit(MARK + sign), F.lit(placeholder))
    return F.regexp_replace(t, THAI_CLOSE, f"$1{CLOSE}$2")


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos, sentence): one row per sentence, in code points. key is unique."""
    pieces = F.regexp_extract_all(masked(F.col(text)), F.lit(SENTENCE), F.lit(0))
    # Placeholders are turned back in each sentence; only a text that has such code points itself goes along with them.
    own = F.when(F.col(text).rlike(f"[{MARK}-{PLACEHOLDERS['．']}]"), F.col(text))
    tiled = (
        texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .select(key, own.alias("_own"), pieces.alias("_p"))
        .select(key, "_own", F.posexplode("_p").alias("_i", "_s"))
    )
    before = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length("_s") - F.length(F.ltrim("_s", F.lit(AROUND)))
    body = F.trim("_s", F.lit(AROUND))
    at = (
        tiled.withColumn("_at", F.coalesce(F.sum(F.length("_s")).over(before), F.lit(0)))
        .select(key, "_own", (F.col("_at") + lead).alias("_at"), body.alias("_s")).where(F.length("_s") > 0)
    )
    restored = F.translate("_s", "".join(PLACEHOLDERS.values()), "".join(PLACEHOLDERS))
    return at.select(
        key, F.col("_at").cast("long").alias("start_pos"), (F.col("_at") + F.length("_s")).cast("long").alias("end_pos"),
        F.when(F.col("_own").isNull(), restored).otherwise(F.substring(F.col("_own"), F.col("_at").cast("int") + 1, F.length("_s"))).alias("sentence"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = distinct_notes(runtime.read(spark, sf_dir, "notes"))
    return sentences(notes, "note_id", "content").drop("sentence")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every note with its text."""
    notes = distinct_notes(runtime.read(spark, sf_dir, "notes"))
    return sentences(notes, "note_id", "content")
