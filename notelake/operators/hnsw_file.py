"""The binary index file: writing from, and reading into, rows (node, id, level, vec, links per layer).

Layout, little-endian: magic, version, dimension, m, node count, top level (u32), entry point (i32); then per node
16 id bytes, level (u32), the vector's float32 bits, and per layer a count (u32) and that many node numbers (i32).
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from notelake import runtime
from notelake.operators.hnsw import HNSW, HNSWConfig
from notelake.sources.schemas import HNSW_NODES

# Fixed values of the format.
MAGIC, VERSION = 0x484E5357, 1
HEADER = struct.Struct("<6Ii")

INDEX = "shard long, ids array<string>, data binary"


class CorruptFile(ValueError):
    pass


def encode(index: HNSW, ids: list[str], m: int) -> bytes:
    """Bytes of an index; ids are UUIDs by node."""
    layers = index.layers[::-1]  # lowest first
    n = len(index.x)
    level = np.zeros(n, int)
    for k, members in enumerate(index.members[::-1]):
        level[members] = k
    top = int(level.max(initial=0))
    entry = int(index.order[0]) if n else -1
    parts = [HEADER.pack(MAGIC, VERSION, index.x.shape[1] if n else 0, m, n, top, entry)]
    for node in range(n):
        parts += [uuid.UUID(ids[node]).bytes, struct.pack("<I", level[node]), index.x[node].astype("<f4").tobytes()]
        for k in range(level[node] + 1):
            links = layers[k][node]
            links = links[links >= 0].astype("<i4")
            parts += [struct.pack("<I", len(links)), links.tobytes()]
    return b"".join(parts)


def decode(data: bytes) -> list[tuple[int, str, int, list[float], list[list[int]]]]:
    """Rows of a file. Short or inconsistent files raise CorruptFile: also links to nodes that aren't on the layer."""
    view, at = memoryview(data), 0

    def take(n: int) -> memoryview:
        nonlocal at
        if n < 0 or at + n > len(view):
            raise CorruptFile("the file is cut off")
        at += n
        return view[at - n:at]

    magic, version, dim, _, count, top, entry = HEADER.unpack(take(HEADER.size))
    if magic != MAGIC or version != VERSION:
        raise CorruptFile("not an index file of this version")
    if (count == 0) != (entry == -1) or entry >= count or entry < -1 or top > 64:
        raise CorruptFile("bad entry point or level")
    rows, seen = [], set()
    for node in range(count):
        key = str(uuid.UUID(bytes=bytes(take(16))))
        if key in seen:
            raise CorruptFile("an id stands twice")
        seen.add(key)
        (level,) = struct.unpack("<I", take(4))
        if level > top:
            raise CorruptFile("a node is above the top level")
        vec = np.frombuffer(take(4 * dim), "<f4").tolist()
        links = []
        for _ in range(level + 1):
            (n,) = struct.unpack("<I", take(4))
            links.append(np.frombuffer(take(4 * n), "<i4").tolist())
        rows.append((node, key, level, vec, links))
    if at != len(view):
        raise CorruptFile("bytes beyond the last node")
    for _, _, _, _, links in rows:
        for k, layer in enumerate(links):
            if any(not 0 <= x < count or rows[x][2] < k for x in layer):
                raise CorruptFile("a link leads nowhere")
    return rows


def load(data: bytes, config: HNSWConfig = HNSWConfig()) -> HNSW:
    """The index of a file, fit for searching."""
    rows = decode(data)
    level = np.array([r[2] for r in rows], int)
    layers = []
    for k in range(int(level.max(initial=0)), -1, -1):
        width = max([1, *(len(r[4][k]) for r in rows if r[2] >= k)])
        links = np.full((len(rows), width), -1, np.int32)
        for node, r in enumerate(rows):
            if r[2] >= k:
                links[node, : len(r[4][k])] = r[4][k]
        layers.append(links)
    return HNSW.of_layers(np.array([r[3] for r in rows], np.float32), level, layers, config)


def build(vectors: DataFrame, shard_rows: int, config: HNSWConfig) -> DataFrame:
    """vectors(id STRING, vec unit) -> a kept index (shard, ids, data): a file's bytes per hash shard, in the shared folder.

    Ids that are no UUIDs are named by one in the file, and stand beside it.
    """
    from pyspark.sql import functions as F

    runtime.ship(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_rows))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable").drop_duplicates("id")
        ids = f["id"].tolist()
        index = HNSW(np.stack(f["vec"].to_numpy()).astype(np.float32), config)
        return pd.DataFrame({"shard": [int(f["shard"].iloc[0])], "ids": [ids], "data": [encode(index, [name_of(i) for i in ids], config.m)]})

    rows = vectors.where("id is not null").select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    return runtime.cut(rows.groupBy("shard").applyInPandas(one, INDEX))


def name_of(key: str) -> str:
    """The id itself if it is a UUID, else one made from it."""
    try:
        return str(uuid.UUID(key)) if len(key) == 36 else str(uuid.uuid5(uuid.NAMESPACE_OID, key))
    except ValueError:
        return str(uuid.uuid5(uuid.NAMESPACE_OID, key))


def search(index: DataFrame, sent, k: int, config: HNSWConfig = HNSWConfig()) -> DataFrame:
    """(query_id, id, score): the k nearest of each shard of a kept index for the queries of sent.value (ids, unit vectors)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = sent.value
        for f in frames:
            for ids, data in zip(f["ids"], f["data"], strict=True):
                found, scores = load(data, config).search(q.astype(np.float32), k)
                r, j = np.nonzero(found >= 0)
                yield pd.DataFrame({"query_id": names[r], "id": np.asarray(ids, object)[found[r, j]], "score": np.round(scores[r, j].astype(float), 12)})

    return index.select("ids", "data").mapInPandas(rows, "query_id string, id string, score double")


def nodes_of(index: DataFrame) -> DataFrame:
    """Rows of the nodes of a kept index; path is the shard."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, data in zip(f["shard"], f["data"], strict=True):
                yield pd.DataFrame([(str(shard), *r) for r in decode(data)], columns=["path", "node", "id", "level", "vec", "links"])

    return index.select("shard", "data").mapInPandas(rows, HNSW_NODES)


def write(path: str, data: bytes) -> None:
    """Whole or not at all."""
    part = Path(f"{path}.{os.getpid()}.part")
    part.write_bytes(data)
    part.replace(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all index files below path."""
    runtime.ship(spark)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in decode(data)], columns=["path", "node", "id", "level", "vec", "links"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, HNSW_NODES)


def stats(nodes: DataFrame, deleted: int = 0) -> DataFrame:
    """(live_count, tombstone_count, total_links, approximate_bytes): 4 a number, 16 an id, 4 a link."""
    from pyspark.sql import functions as F

    links = F.aggregate(F.transform("links", F.size), F.lit(0), lambda a, x: a + x)
    return nodes.agg(F.count("*").alias("live_count"), F.sum(links).alias("total_links"), F.sum(4 * F.size("vec") + 16 + 4 * links).alias("approximate_bytes")).select(
        "live_count", F.lit(deleted).cast("long").alias("tombstone_count"), "total_links", "approximate_bytes",
    )
