"""The project's size estimate of a text: CJK code points, plus a quarter of the other visible ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges counted one per code point, and the code points that count nothing.
CJK_RANGES = (
    (0x3000, 0x303F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF),
)
BLANK_CLASS = "\\p{Zs}\\t\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}"
NEWLINE_CLASS = "\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}"


def cjk_class() -> str:
    """Inside of a character class, for Java and RE2."""
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)


def size_of(text: Column) -> Column:
    """cjk + ceil(other / 4) as INT; null for null. U+3000 is CJK, so it counts one."""
    no_cjk = F.regexp_replace(text, f"[{cjk_class()}]+", "")
    visible = F.regexp_replace(no_cjk, f"[{BLANK_CLASS}]+", "")
    cjk = F.length(text) - F.length(no_cjk)
    return (cjk + F.floor((F.length(visible) + F.lit(3)) / F.lit(4))).cast("int")
