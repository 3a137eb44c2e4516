"""Exact top-k search: tiles of query and candidate blocks, selection per tile, merging as a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, prepare, written

#: Vectors of a candidate block and of a query block; lists merged by one step of the tree.
CANDIDATES, QUERIES, FAN = 4096, 2048, 16
_BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("data", pa.binary())])
_BLOCK_DDL = "dim int, block long, ids array<long>, kind string, data binary"


def _narrow(rows: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    top = np.abs(rows).max(initial=0)
    return rows.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8")


def _pack(most: int):
    """Rows (vec_id, v) as blocks of at most `most` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        base, n = TaskContext.get().partitionId() << 32, 0

        def block(dim):
            nonlocal n
            ids, rows = zip(*held.pop(dim), strict=True)
            n += 1
            data = _narrow(np.array(rows, np.float64))
            row = (dim, base + n, list(ids), data.dtype.str, data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                held.setdefault(len(v), []).append((vec_id, v))
                if len(held[len(v)]) >= most:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def _tile(k: int):
    """Of each query of a tile the k best candidates by (score descending, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):  # a row is a tile
            for row in batch.to_pylist():
                q, c = (np.frombuffer(row[f"{x}_data"], row[f"{x}_kind"]).reshape(len(row[f"{x}_ids"]), row["dim"]).astype(np.float64) for x in "qc")
                q_ids, c_ids = np.array(row["q_ids"]), np.array(row["c_ids"])
                order = np.argsort(c_ids, kind="stable")
                c, c_ids = c[order], c_ids[order]
                out_q, out_v, out_s = [], [], []
                for i in range(0, len(q), 256):
                    score = q[i : i + 256] @ c.T
                    score[q_ids[i : i + 256, None] == c_ids[None, :]] = -np.inf
                    least = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
                    for j, s in enumerate(score):
                        better = np.flatnonzero((s >= least[j]) & (s > -np.inf))
                        better = better[np.argsort(-s[better], kind="stable")[:k]]
                        out_q.append(np.full(len(better), q_ids[i + j]))
                        out_v.append(c_ids[better])
                        out_s.append(s[better])
                found = [np.concatenate(x).astype(np.int64) for x in (out_q, out_v, out_s)]
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(np.full(len(found[0]), row["node"])), pa.array(-found[2]), pa.array(found[1])], names=["query_id", "node", "neg", "vec_id"])

    return run


def top_k(vectors: DataFrame, k: int = 5, scale: float = 256.0, every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k rows, other
    than itself, of highest inner product; ties go to the smaller vec_id; fewer rows, if there are fewer.

    vectors: vec_id, embedding. Each component x counts as floor(scale * x), so products are integers
    (exact below 2**53). Vectors that are null, empty, or hold a null, NaN or infinite component take no
    part, nor do rows of null vec_id. Rows that repeat a vec_id are one: the least vector stays. Vectors of
    different dimension never meet. Tiles are pairs of one query block and one candidate block, both of
    bounded size; each tile passes on at most k rows for each of its queries."""
    spark = vectors.sparkSession
    prepare(spark)
    number = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & (F.size("embedding") > 0)
    clean = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound)
    clean = clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", number.alias("v"))
    clean = written(clean, "vectors")

    asked = clean.where(F.col("vec_id") % every == 0)
    q = written(asked.coalesce(max(1, math.ceil(asked.count() / queries))).mapInArrow(_pack(queries), _BLOCK_DDL), "queries")
    c = written(clean.coalesce(max(1, math.ceil(clean.count() / candidates))).mapInArrow(_pack(candidates), _BLOCK_DDL), "candidates")

    # Every candidate block meets every query block of its dimension: rows here are blocks, keyed by number.
    slots = max(1, q.select("block").distinct().count())
    numbered = q.selectExpr("dim", "block", "ids as q_ids", "kind as q_kind", "data as q_data", f"pmod(xxhash64(block), {slots}) as slot")
    spread = c.selectExpr("dim", "block as node", "ids as c_ids", "kind as c_kind", "data as c_data").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    tiles = spread.join(numbered.drop("block"), ["dim", "slot"])
    lists = tiles.select("dim", "node", "q_ids", "q_kind", "q_data", "c_ids", "c_kind", "c_data").mapInArrow(_tile(k), "query_id long, node long, neg long, vec_id long")
    lists = written(lists.groupBy("query_id", "node").agg(F.array_sort(F.collect_list(F.struct("neg", "vec_id"))).alias("best")), "lists")

    # The tree: number the blocks, then merge FAN lists of a query at a time until one is left.
    size = max(1, c.count())
    node = F.pmod(F.xxhash64("node"), F.lit(size))
    while True:
        size = math.ceil(size / FAN)
        lists = lists.groupBy("query_id", (F.floor(node / FAN)).alias("node")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        node = F.col("node")
        if size == 1:
            break
    got = lists.select("query_id", F.posexplode("best").alias("at", "hit"))
    return got.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
