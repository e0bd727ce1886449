"""Approximate nearest neighbours by multi-index hashing (operator 6).

Vectors are centred and turned by a rotation learned with iterative
quantization (ITQ) on a bounded sample; the signs are a 64-bit code. Each index
shard sorts its codes by each of four 16-bit substrings. A code within Hamming
radius r of a query agrees with it in some substring to radius r // 4 or less
(for the first r % 4 + 1 substrings; one less for the others), so probing the
substrings retrieves every code within the radius, whatever the data. What is
retrieved is ranked by the exact inner product of the original vectors.

The radius is learned too: the smallest that keeps the wanted share of true
neighbours on the sample. Queries are dealt in blocks and every block meets
every shard, so no task holds more than a shard and a block. Queries that find
fewer neighbours than asked for are searched again without a radius.

Defined results: vectors that are null, zero, of another length than the most
common one, or hold a null, NaN or infinite component take no part. Equal
scores are ranked by smaller id. Rows of equal ids are separate candidates, but a
query's own id never is. Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, PARTS = 64, 4
#: Rows that the rotation and the radius are fitted on.
SAMPLE = 4096
#: Share of true neighbours on the sample that the radius must keep.
WANTED = 0.97
SHARD, BLOCK = 8192, 4096


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8")[:, 0]


def learn(vectors: np.ndarray, k: int = 20, wanted: float = WANTED, turns: int = 30, seed: int = 0) -> Codes:
    """Rotation by ITQ and the radius that keeps ``wanted`` of the true neighbours."""
    rng = np.random.default_rng(seed)
    mean = vectors.mean(axis=0)
    x = vectors - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:BITS].T
    if axes.shape[1] < BITS:  # fewer dimensions than bits: further random directions of the same space
        axes = np.hstack([axes, np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0][:, rng.integers(0, x.shape[1], BITS - axes.shape[1])]])
    v = x @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(turns):
        u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ w).T
    found = Codes(mean, axes @ turn, BITS)
    codes = found.of(vectors)
    far = np.bitwise_count(codes[:, None] ^ codes[None, :]) if len(codes) <= SAMPLE else None
    near = vectors @ vectors.T
    np.fill_diagonal(near, -np.inf)
    top = np.argpartition(-near, min(k, len(near) - 1) - 1, axis=1)[:, : min(k, len(near) - 1)] if len(near) > 1 else np.zeros((0, 0), int)
    if top.size:
        distances = np.sort(np.take_along_axis(far, top, axis=1).ravel())
        found.radius = int(distances[min(len(distances) - 1, int(np.ceil(wanted * len(distances))))])
    return found


class Index:
    """The substring tables of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view("<u2").reshape(-1, PARTS)
        self.order = [np.argsort(self.parts[:, s], kind="stable") for s in range(PARTS)]
        self.values = [np.unique(self.parts[o, s], return_index=True) for s, o in enumerate(self.order)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``, found through the substrings."""
        mine = np.array([code], "<u8").view("<u2")
        got = []
        for s in range(PARTS):
            reach = radius // PARTS - (s > radius % PARTS)
            if reach < 0:
                continue
            values, starts = self.values[s]
            hit = np.flatnonzero(np.bitwise_count(values ^ mine[s]) <= reach)
            first, last = starts[hit], np.r_[starts, len(self.codes)][hit + 1]
            sizes = last - first
            if len(sizes):
                got.append(self.order[s][np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)])
        if not got:
            return np.zeros(0, np.int64)
        seen = np.zeros(len(self.codes), bool)
        seen[np.concatenate(got)] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           codes: Codes | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row where ``is_query`` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.coalesce(usable(F.col("v")), F.lit(False)) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return nothing
    rows = rows.where(F.size("v") == sizes[0]["d"])
    if codes is None:
        fitted = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        codes = learn(fitted.flatten().to_numpy().reshape(-1, sizes[0]["d"]), k)
    n, queries = sizes[0]["count"], rows.where("q").count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-queries // block))
    deal = lambda salt, parts: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = rows.select("id", "v", deal(1, shards).alias("shard"), every(blocks).alias("block"))
    shared = spark.sparkContext.broadcast(vars(codes))

    def searcher(radius: int | None):
        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                ids, asked = (t.column("id").to_numpy() for t in (left, right))
                x, q = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
                model = Codes(**shared.value)
                table, reach = Index(model.of(x)), model.radius if radius is None else radius
                for i, code in enumerate(model.of(q)):
                    found = table.within(code, reach)
                    found = found[ids[found] != asked[i]]
                    if len(found):
                        score = (x[found] * q[i]).sum(axis=1)
                        best = np.lexsort((ids[found], -score))[:k] if len(found) <= 4 * k else None
                        if best is None:
                            least = np.partition(score, len(score) - k)[len(score) - k]
                            some = np.flatnonzero(score >= least)
                            best = some[np.lexsort((ids[found][some], -score[some]))][:k]
                        out.append((np.full(len(best), asked[i]), ids[found][best], score[best]))
            columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
            return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float))})

        return one

    def nearest(asked: DataFrame, radius: int | None = None) -> DataFrame:
        blocked = asked.select("id", "v", deal(2, blocks).alias("block"), every(shards).alias("shard"))
        met = index.groupBy("shard", "block").cogroup(blocked.groupBy("shard", "block")).applyInArrow(
            searcher(radius), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # of several vectors under one id the same one is searched in every run
    asked = rows.where("q").groupBy("id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("one")).select("id", "one.v")
    found = stored(nearest(asked), "neighbours")
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = stored(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"), "short-queries")
    if n - 1 > 0 and short.limit(1).count():
        again = nearest(short, BITS)
        return found.join(short.select("id"), F.col("query_id") == F.col("id"), "left_anti").unionByName(again)
    return found
