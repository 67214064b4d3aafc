"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, a bounded sample, order every vector: its permutation is the PREFIX nearest pivots. The
index is cut to shards of about SHARD vectors; within one, each pivot's inverted file holds its place in
every vector's prefix (the place after the last where it is absent: prefixes name half of all pivots, so
files are dense). A query reads the files of its own pivots only and sums up how far places differ
(Spearman's footrule; what absent pivots add follows from the same sums). The
SHARE of each shard that is least far is reranked by the inner product, in double precision; the best of
all shards are the result. Queries meet shards in blocks of about BLOCK; no task holds more than one of
each. SHARE applies alike at every size, so recall does not fall as tables grow.

Cases: vectors that are null, empty, zero, hold null or non-finite components or have another length than
the pivots' commonest take no part; each row of a repeated vec_id is a query and a candidate of its own, so the
others are among its neighbours; ties go to the smaller vec_id; null vec_id takes no part; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.scratch import stash

PIVOTS = 256
PREFIX = 128
SHARE = 0.1
LEAST = 256
SHARD = 8192
BLOCK = 2048


def valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    near = -(vectors @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :m].astype(np.int16)


def search_shard(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, own: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, q_own: np.ndarray, pivots: int, top: int, share: float = SHARE, least: int = LEAST):
    """Rows (row number of the query, vector, score): the best of one shard, whose rows are in order of id."""
    n, m = own.shape
    kind = np.int16 if m * (m + 1) < 1 << 15 else np.int32
    files = np.full((pivots, n), m + 1, kind)
    files[own.T, np.arange(n)] = np.arange(1, m + 1, dtype=kind)[:, None]
    places = np.arange(1, m + 1, dtype=kind)[:, None]
    wanted = min(n, max(least, top + 1, int(np.ceil(share * n))))
    out = []
    for q, vector, prefix in zip(q_rows, queries, q_own):
        # Footrule: over the query's pivots, how far places differ; over the rest, how far a vector's stand before the last.
        read = files[prefix]
        far = read.sum(axis=0, dtype=kind).astype(np.int64)
        read -= places
        far += np.abs(read, out=read).sum(axis=0, dtype=kind)
        key = far * n + np.arange(n)
        near = np.argpartition(key, wanted - 1)[:wanted] if wanted < n else np.arange(n)
        near = near[rows[near] != q]
        scores = (vectors[near] * vector).sum(axis=1)
        best = np.lexsort((ids[near], -scores))[:top]
        out.append((np.full(len(best), q), ids[near][best], scores[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def search(vectors: DataFrame, every: int = 20, top: int = 20, n_pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its nearest found."""
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    # Written with its numbers: a row keeps its own, so that only it is no candidate of its query.
    rows = stash(valid(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], empty)
    d = common[0]["d"]
    rows = rows.filter(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = np.unique(np.array([r["v"] for r in sample]), axis=0)
    m = max(1, min(prefix, len(pivots)))
    total = rows.count()
    asked = rows.filter(F.col("vec_id") % every == 0)
    shards, blocks = -(-total // SHARD), max(1, -(-asked.count() // BLOCK))

    def pack(key: str):
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["vec_id", "row"], kind="stable")
            own = np.stack(group["v"].to_numpy()).astype(np.float64)
            return pd.DataFrame({key: [group[key].iloc[0]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "rows": [group["row"].to_numpy(np.int64).tobytes()], "vectors": [own.tobytes()], "own": [prefixes(own, pivots, m).tobytes()]})

        return one

    blob = "ids binary, rows binary, vectors binary, own binary"
    packed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards))).groupBy("shard").applyInPandas(pack("shard"), f"shard bigint, {blob}")
    index = stash(packed, "index").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    ask = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(blocks))).groupBy("block").applyInPandas(pack("block"), f"block bigint, {blob}")
    ask = ask.select("block", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"), F.col("own").alias("q_own"))
    pairs = index.join(ask, "block").repartition(max(1, shards * blocks), "shard", "block")

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            for r in frame.itertuples(index=False):
                ids, own_rows, q_ids, q_rows = (np.frombuffer(x, np.int64) for x in (r.ids, r.rows, r.q_ids, r.q_rows))
                matrix = lambda raw, kind, n: np.frombuffer(raw, kind).reshape(n, -1)
                q, v, s = search_shard(
                    ids, own_rows, matrix(r.vectors, np.float64, len(ids)), matrix(r.own, np.int16, len(ids)),
                    q_rows, matrix(r.q_vectors, np.float64, len(q_ids)), matrix(r.q_own, np.int16, len(q_ids)), len(pivots), top,
                )
                id_of = dict(zip(q_rows.tolist(), q_ids.tolist()))
                yield pd.DataFrame({"query": q, "query_id": np.array([id_of[x] for x in q.tolist()], np.int64), "vec_id": v, "score": s})

    found = pairs.mapInPandas(run, "query bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
