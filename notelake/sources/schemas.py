"""Explicit schemas of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NOTES = T.StructType([
    T.StructField("note_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("needs_reindexing", T.BooleanType()),
])
CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("note_id", T.LongType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("content", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
EVAL_SET = T.StructType([
    T.StructField("notes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "content")]))),
    T.StructField("queries", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("relevant", T.MapType(T.StringType(), T.IntegerType())),
    ]))),
])
REFERENCE = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("dimension", T.IntegerType()), T.StructField("normalized", T.BooleanType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("validation", T.StructType([
        T.StructField("min_cosine_vs_coreml_fp16", T.DoubleType()), T.StructField("padding_invariance_cosine", T.DoubleType()), T.StructField("compute_units", T.StringType()),
    ])),
    T.StructField("cases", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]))),
])
HNSW_NODES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("node", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType()))),
])
