"""Retrieval quality: recall, nDCG, agreement of indexes, by language, and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(queries: DataFrame, qrels: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): labelled notes (any grade) within the first k; 1 without labels. ranked(query_id, note_id, rank)."""
    top = ranked.where(F.col("rank") <= k).select("query_id", "note_id").distinct().withColumn("hit", F.lit(1))
    per = qrels.join(top, ["query_id", "note_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def ndcg_at(queries: DataFrame, qrels: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): gains 2^grade - 1; 1 where the ideal is 0."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + F.lit(1.0))
    got = ranked.where(F.col("rank") <= k).join(qrels, ["query_id", "note_id"]).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    best = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "note_id"))).where(F.col("rank") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    j = queries.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left")
    return j.select("query_id", F.when(F.coalesce("idcg", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def language_of(query_id):
    return F.when(query_id.startswith("q-en-"), "EN").otherwise("JA")


def summary(queries: DataFrame, qrels: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(lang, n_queries, recall, ndcg): macro averages by language, and over all."""
    per = recall_at(queries, qrels, ranked, k).join(ndcg_at(queries, qrels, ranked, k), "query_id").withColumn("lang", language_of(F.col("query_id")))
    both = per.withColumn("lang", F.explode(F.array("lang", F.lit("ALL"))))
    return both.groupBy("lang").agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))


def failures(queries: DataFrame, qrels: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, top3) of queries that miss a label."""
    top = ranked.where("rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "note_id"))).alias("t"))
    missed = recall_at(queries, qrels, ranked, k).where("recall < 1")
    return missed.join(top, "query_id", "left").select("query_id", "recall", F.coalesce(F.array_join(F.transform("t", lambda x: x["note_id"]), ","), F.lit("")).alias("top3"))


def index_recall(truth: DataFrame, found: DataFrame, empty: float = 1.0) -> DataFrame:
    """(query_id, recall) of found(query_id, id) against truth(query_id, id); `empty` for queries without truth (1 for recall, 0 for agreement)."""
    hit = truth.join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    per = hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    asked = truth.select("query_id").union(found.select("query_id")).distinct()
    return asked.join(per, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(empty)).alias("recall"))


def graph_mb(live, links):
    return (4 * links + 16 * live) / F.lit(1e6)
