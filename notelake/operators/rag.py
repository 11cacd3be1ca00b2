"""Evidence for answers: sources within a budget, the prompt, and the answer or why there is none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import title_or_default
from notelake.functions.text_size import size_of
from notelake.operators.search import asked

INSTRUCTIONS = (
    "Answer from the numbered excerpts only, in the language of the question. "
    "Name the numbers of the excerpts used. If they hold no answer, say so."
)


@dataclass(frozen=True)
class PromptTemplate:
    """Lines of a prompt; the defaults are the format's fixed values."""

    header: str = "以下はノートからの抜粋です。"
    source: str = "[%d] ノート「%s」: %s"
    question: str = "質問: %s"


Generator = Callable[[Column, Column], Column]


def select_sources(hits: DataFrame, budget: int = 1500) -> DataFrame:
    """Hits in rank order while their sizes add up within the budget; the first is always kept, later ones aren't pulled up."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("query_id").orderBy("rank")
    sized = hits.withColumn("tokens", size_of(F.col("content"))).withColumn("total_tokens", F.sum("tokens").over(upto)).withColumn("source_no", F.row_number().over(first))
    return sized.where((F.col("total_tokens") <= budget) | (F.col("source_no") == 1))


def used_hits(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """The hits that were selected, in their own order of rank."""
    return hits.join(selected.select("query_id", "rank"), ["query_id", "rank"], "left_semi")


def prompts(questions: DataFrame, sources: DataFrame, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """(query_id, prompt) of questions that have sources."""
    line = F.format_string(template.source, F.col("s.source_no").cast("int"), F.col("s.title"), F.col("s.content"))
    lines = (
        sources.select("query_id", F.struct("source_no", title_or_default(F.col("title")).alias("title"), "content").alias("s"))
        .select("query_id", F.col("s.source_no").alias("n"), line.alias("line"))
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    )
    body = F.concat(F.array(F.lit(template.header)), F.transform("l", lambda x: x["line"]), F.array(F.lit(""), F.format_string(template.question, F.col("text"))))
    return questions.join(lines, "query_id").select("query_id", F.array_join(body, "\n").alias("prompt"))


def answers(questions: DataFrame, hits: DataFrame, generator: Generator | None, unavailable_reason: str | None = None, budget: int = 1500, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """(query_id, text, unavailable_reason, n_sources): one row per question.

    Blank questions and those without hits have no text, reason or sources. Without a generator the reason is given beside the sources.
    """
    live = asked(questions)
    sources = select_sources(hits, budget)
    counted = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    rows = questions.select("query_id").distinct().join(prompts(live, sources, template), "query_id", "left").join(counted, "query_id", "left")
    has = F.col("prompt").isNotNull()
    if generator is None:
        text, reason = F.lit(None).cast("string"), F.when(has, F.lit(unavailable_reason or "no generator"))
    else:
        text, reason = F.when(has, generator(F.lit(INSTRUCTIONS), F.col("prompt"))), F.lit(None).cast("string")
    return rows.select("query_id", text.alias("text"), reason.alias("unavailable_reason"), F.when(has, F.col("n_sources")).otherwise(F.lit(0)).alias("n_sources"))


def echo_generator(instructions: Column, prompt: Column) -> Column:
    """Deterministic stand-in: the digest of what a model would read."""
    return F.concat(F.lit("echo:"), F.md5(F.concat(instructions, F.lit("\n"), prompt)))
