"""Queries of this package and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from notelake.functions.text_size import CJK_RANGES

_MODULES = {
    "p1_personal": ["p1_found", "p1_redacted"],
    "p2_split": ["p2_found", "p2_pieces"],
    "p3_neighbours": ["p3_found", "p3_recall"],
    "p4_sentences": ["p4_found", "p4_sentences"],
    "p5_lookalike": ["p5_found", "p5_canonical"],
    "p6_near_duplicates": ["p6_found", "p6_groups"],
    "p7_leaks": ["p7_found", "p7_spans"],
    "p8_mixture": ["p8_selection", "p8_shares"],
    "p9_spam": ["p9_found", "p9_scores"],
}


def _lazy(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"notelake.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _lazy(m, n) for m, names in _MODULES.items() for n in names}


def _size_sql(t: str) -> str:
    cjk = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
    no_cjk = f"regexp_replace({t}, '[{cjk}]+', '', 'g')"
    visible = f"regexp_replace({no_cjk}, '[\\p{{Zs}}\\t\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]+', '', 'g')"
    return f"(length({t}) - length({no_cjk}) + (length({visible}) + 3) // 4)"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express over whole tables; the others are tested against brute force."""
    return {
        "p2_found": f"""WITH n AS (SELECT note_id, content FROM notes WHERE note_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note_id
  ORDER BY coalesce(updated_at, TIMESTAMPTZ '0001-01-01 00:00:00+00') DESC, content DESC NULLS LAST, title DESC NULLS LAST) = 1),
c AS (SELECT chunk_id, max(content) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1)
SELECT 'note' AS item_kind, note_id::VARCHAR AS item_id FROM n WHERE {_size_sql('content')} > 400
UNION ALL SELECT 'chunk', chunk_id FROM c WHERE {_size_sql('content')} > 400""",
    }
