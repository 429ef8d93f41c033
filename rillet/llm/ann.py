"""Nearest neighbours by inner product as a block matrix join over int8 tiles.

Queries are dealt into blocks, candidates into stripes, by a hash of the id.  Every query block meets
every stripe (the query set is a stated one; candidates are not repeated unless the queries need
several blocks), streaming through it tile by tile: the int8 product of the two matrices with, for
each pair, a bound on what quantisation can change.  A pair survives if its upper bound reaches both
the query's k-th largest lower bound in the tile and the k-th best score so far; survivors are
recomputed in double precision on the original vectors and enter the query's heap of k.  The stripes'
heaps are merged at the end.  The bound holds for every pair, so the result is exact.  A task holds a
query block and a tile, whatever the number of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillet.llm.common import column_of, lean, read

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 2048
STRIPES = 12


def usable(vec: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    c = F.col(vec).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale, length of the quantised row and length of the error, each by row."""
    top = np.abs(x).max(1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(x / scale[:, None]).clip(-127, 127)
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component on, so the same for equal rows wherever they stand."""
    out = np.zeros(len(b))
    for j in range(b.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile(queries: np.ndarray, qid: np.ndarray, cands: np.ndarray, cid: np.ndarray, heaps: list[list[tuple[float, int]]], k: int) -> None:
    """Bring each query's heap, the k best (score, -id) so far, up to date with a tile of candidates."""
    q8, qs, qn, qe = quantise(queries)
    c8, cs, cn, ce = quantise(cands)
    # int8 products below 2**24 in all are exact in float32, whose matrix product is fast.
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    c8 = c8.astype(kind)
    true_norm = np.linalg.norm(cands, axis=1)
    for a in range(0, len(queries), 256):
        near = (q8[a : a + 256].astype(kind) @ c8.T).astype(np.float64) * qs[a : a + 256, None] * cs[None, :]
        bound = (qe[a : a + 256, None] * true_norm[None, :] + qn[a : a + 256, None] * ce[None, :]) * (1 + 1e-9) + 1e-12 * (qn[a : a + 256, None] * cn[None, :])
        for i in range(len(near)):
            heap, mine = heaps[a + i], qid[a + i]
            low, high = near[i] - bound[i], near[i] + bound[i]
            low = np.where(cid == mine, -np.inf, low)
            cut = np.partition(low, -k)[-k] if len(low) > k else -np.inf
            if len(heap) == k:
                cut = max(cut, heap[0][0])
            alive = np.flatnonzero((high >= cut) & (cid != mine))
            s = exact(np.broadcast_to(queries[a + i], (len(alive), queries.shape[1])), cands[alive])
            for pair in zip(s.tolist(), (-cid[alive]).tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, pair)
                elif pair > heap[0]:
                    heapq.heapreplace(heap, pair)


def _stripes(k: int, rows: int):
    """Stream groups (d, r, c), each its queries first and then its candidates, tile after tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        queries: list[np.ndarray] = []
        qids: list[np.ndarray] = []
        cands: list[np.ndarray] = []
        cids: list[np.ndarray] = []
        heaps: list[list[tuple[float, int]]] = []

        def work() -> None:
            if cands and queries:
                if not heaps:
                    heaps.extend([] for _ in range(sum(map(len, qids))))
                tile(np.concatenate(queries), np.concatenate(qids), np.concatenate(cands), np.concatenate(cids), heaps, k)
            cands.clear()
            cids.clear()

        def results() -> pa.RecordBatch:
            ids = np.concatenate(qids).tolist() if qids else []
            out = [(q, -i, s) for q, heap in zip(ids, heaps, strict=bool(heaps)) for s, i in heap]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            d, r, c, side, ids = (column_of(batch, n).to_numpy() for n in ("d", "r", "c", "side", "id"))
            v = column_of(batch, "v")
            start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (side[1:] != side[:-1])]))
            for a, b in zip(start, [*start[1:], len(d)], strict=True):
                key = (d[a], r[a], c[a])
                if key != now:
                    work()
                    if qids:
                        yield results()
                    now = key
                    queries.clear()
                    qids.clear()
                    heaps.clear()
                x = v.slice(a, b - a).flatten().to_numpy().reshape(b - a, d[a])
                if side[a] == 0:
                    queries.append(x)
                    qids.append(ids[a:b])
                    continue
                for i in range(0, len(x), rows):
                    cands.append(x[i : i + rows])
                    cids.append(ids[a + i : min(b, a + i + rows)])
                    if sum(map(len, cids)) >= rows:
                        work()
        work()
        if qids:
            yield results()

    return run


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, stripes: int = STRIPES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product for each query row.

    A query's own id is no candidate.  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, take no part; vectors of another length than the query's are no
    candidates.  Repeated ids count as rows of their own.  Fewer candidates than k are all returned.
    """
    good = vectors.where(F.col(vec_id).isNotNull() & usable(vec)).select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.size(vec).alias("d"), is_query.alias("q"))
    counts = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)).alias("q")).first()
    rows, cols = max(1, -(-counts["q"] // query_block)), max(1, min(stripes, -(-counts["n"] // candidate_block)))
    block = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = good.where("q").withColumn("r", block("r", rows)).withColumn("c", every(cols)).withColumn("side", F.lit(0))
    cands = good.withColumn("c", block("c", cols)).withColumn("r", every(rows)).withColumn("side", F.lit(1))
    both = queries.unionByName(cands).select("d", "r", "c", "side", "id", "v")
    heaps = both.repartition("d", "r", "c").sortWithinPartitions("d", "r", "c", "side").mapInArrow(lean(_stripes(k, candidate_block)), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings for each row whose vec_id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pair)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""
