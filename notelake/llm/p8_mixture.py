"""Problem 8: mixing sources to target weights by weighted fair queueing.

Every page is measured in tokens of a public tokenizer, whose file the driver sends to all nodes. The pages of a source are put in a shuffled order, epoch
after epoch up to the source's cap of repeats; a copy's virtual finish time is the source's tokens up to it divided
by the source's target share. All copies are sorted by it across the cluster and cut off where the budget is full.
A source that runs out frees its share for the others in proportion to their targets; the shares reached are reported.

Running sums never go through one task per source: sums of hash buckets give each bucket its offset, so a source
that holds a third of all rows is spread like any other.

Sources are matched without case, surrounding blanks and underscores. Pages without a source, of a source without
a target (or with a share or cap of zero or null), without an id or without text are not used; targets without pages
get a share of 0. Of repeated rows of one page one is used. Empty tables give an empty selection.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake import runtime


@dataclass(frozen=True)
class MixConfig:
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    #: Split pattern that the vocabulary was made for (fixed value, published with the tokenizer).
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    budget_tokens: int | None = None   # total size; by default as large as `starved` allows
    starved: float = 0.15              # share of target weight whose sources may run out before the default budget is full
    bucket_rows: int = 20_000          # pages of a source per hash bucket, about
    seed: int = 7


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """Spelling by which sources are matched."""
    return F.lower(F.trim(F.regexp_replace(source, r"[\s_]+", " ")))


def token_counts(documents: DataFrame, c: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, source_key, n_tokens) of pages with an id and text; one row per page."""
    spark = documents.sparkSession
    runtime.ship(spark)
    name = runtime.send_file(spark, c.tokenizer)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(runtime.sent_file(name), c.pattern)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source_key": f["source_key"], "n_tokens": [len(enc.encode_ordinary(t)) for t in f["text"]]})

    pages = documents.where("doc_id is not null and text is not null").select("doc_id", source_key(F.col("source")).alias("source_key"), "text")
    counted = runtime.spread(pages).mapInPandas(count, "doc_id long, source_key string, n_tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source_key")).alias("s")).select("doc_id", "s.source_key", "s.n_tokens")


def default_budget(goals: DataFrame, per_source: DataFrame, c: MixConfig) -> int:
    """Largest total at which the sources that have run out hold at most `starved` of the target weight.

    A source runs out at the virtual time cap / share. The table has one row per target.
    """
    caps = (
        goals.join(per_source, "source_key", "left").withColumn("cap", F.coalesce("tokens", F.lit(0)) * F.col("max_repeats"))
        .withColumn("out_at", F.col("cap") / F.col("target_share"))
    )
    weight = caps.agg(F.sum("target_share").alias("all_weight"))
    upto = Window.orderBy("out_at", "source_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = caps.crossJoin(F.broadcast(weight)).withColumn("gone", F.sum("target_share").over(upto) / F.col("all_weight"))
    end = ranked.where(F.col("gone") > c.starved).agg(F.min("out_at")).first()[0]
    if end is None:
        return 0
    return int(caps.agg(F.sum(F.least(F.col("cap").cast("double"), F.col("target_share") * F.lit(float(end))))).first()[0] or 0)


def mix(documents: DataFrame, targets: DataFrame, c: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, source, repeat_no, n_tokens, virtual_finish) of the copies that make up the mixture."""
    goals = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .withColumn("source_key", source_key(F.col("source"))).groupBy("source_key")
        .agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    pages = runtime.cut(token_counts(documents, c).where("n_tokens > 0").join(goals, "source_key"))
    per_source = runtime.cut(pages.groupBy("source_key").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("tokens")))
    budget = c.budget_tokens if c.budget_tokens is not None else default_budget(goals, per_source, c)

    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_pages") / F.lit(c.bucket_rows))).cast("long")
    copies = (
        pages.join(per_source, "source_key")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
        .withColumn("place", F.xxhash64(F.col("doc_id"), F.col("repeat_no"), F.lit(c.seed)))
        # Buckets follow the order of places: the sign-shifted hash divided into equal stretches.
        .withColumn("bucket", F.floor((F.shiftright("place", 32) + F.lit(2 ** 31)) * buckets / F.lit(2 ** 32)))
        .select("doc_id", "source_key", "source", "target_share", "repeat_no", "n_tokens", "place", "bucket")
    )
    key = ["source_key", "repeat_no", "bucket"]
    sums = copies.groupBy(*key).agg(F.sum("n_tokens").alias("t"))
    earlier = Window.partitionBy("source_key").orderBy("repeat_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0))).drop("t")
    within = Window.partitionBy(*key).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = (
        copies.join(offsets, key)
        .withColumn("virtual_finish", (F.col("before") + F.sum("n_tokens").over(within)) / F.col("target_share"))
        .select("doc_id", "source", "repeat_no", "n_tokens", "virtual_finish")
    )
    # Range sort over the cluster; the written table fixes which part of the range each row is in.
    parts = runtime.slots(documents.sparkSession)
    ranged = runtime.cut(timed.repartitionByRange(parts, "virtual_finish", "doc_id", "repeat_no").withColumn("part", F.spark_partition_id()))
    part_sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    # One row per part of the range, as many as shuffle partitions.
    starts = part_sums.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    run = Window.partitionBy("part").orderBy("virtual_finish", "doc_id", "repeat_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(starts), "part").where(F.col("before") < budget)
        .withColumn("total", F.col("before") + F.sum("n_tokens").over(run))
        .where(F.col("total") <= budget)
        .select("doc_id", "source", "repeat_no", "n_tokens", "virtual_finish")
    )


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, n_pages, most_repeats) of every target."""
    got = selection.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_pages"), F.max("repeat_no").alias("most_repeats"),
    )
    total = got.agg(F.sum("tokens").alias("total"))
    named = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("k")).agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share")).drop("k")
    return named.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = runtime.read(spark, sf_dir, "mix_targets")
    return shares(p8_selection(spark, sf_dir), targets)
