"""Resharding by minimum-cost flow: equal bytes in the new shards, fewest bytes moved.

Old shards supply their bytes, new shards take a target each, and a byte costs nothing where it stays
and one where it moves.  The flow says how many bytes of each old shard stay.  It is carried out in
blocks, the rows of an old shard with one hash of the text; a text of over an eighth of a target is a block
of its own, so equal texts share a block and move together.  Only a text of over a whole target, which no
shard can hold, is split, by row.  An old shard keeps blocks, large ones first, until it holds what stays;
so no more bytes move than in the flow, and it keeps less than its smallest moved block too many.  Moved
blocks go to the shard with most room, large ones first.  The driver sees block sizes alone: at most BLOCKS
of each old shard, 8 of a new one, and PARTS parts of a target of split texts.

The shards that gain or lose a row are then written anew, as files of consecutive slots.
"""

from __future__ import annotations

import uuid
from collections import deque

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillet.llm.common import read, shared_dir, spare

#: Blocks of each old shard, shares of a target from which a text is a block of its own, and parts of a target into which a larger text is split.
BLOCKS = 256
HEAVY = 8
PARTS = 64
#: Bytes of a new file, about.
FILE_BYTES = 256 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Cheapest shipment of all supply: successive shortest augmenting paths on the bipartite graph."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than the supply")
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    edges: list[list[int]] = []  # to, residual capacity, cost
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def add(a: int, b: int, cap: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, cap, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, c in enumerate(capacity):
        add(m + j, sink, c, 0)
    at = {}
    for i in range(m):
        for j in range(n):
            at[i, j] = len(edges)
            add(i, m + j, supply[i], cost[i][j])
    while True:
        dist, back, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                b, cap, price = edges[e]
                if cap > 0 and dist[a] + price < dist.get(b, 1 << 62):
                    dist[b], back[b] = dist[a] + price, e
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if sink not in dist:
            break
        path, b = [], sink
        while b != source:
            path.append(back[b])
            b = edges[back[b] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return {k: edges[e ^ 1][1] for k, e in at.items() if edges[e ^ 1][1]}


def assign(blocks: list[tuple[tuple, int, int]], n_old: int, targets: list[int]) -> dict[tuple, int]:
    """New shard of each block (key, old shard, bytes): at most a block above its target, and no more bytes moved than the flow moves."""
    n_new = len(targets)
    supply, mine = [0] * n_old, [[] for _ in range(n_old)]
    for key, old, size in blocks:
        supply[old] += size
        mine[old].append((size, key))
    flow = min_cost_flow(supply, targets, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    shard: dict[tuple, int] = {}
    room = list(targets)
    moved: list[tuple[int, tuple]] = []
    for old, own in enumerate(mine):
        stays, kept, rest = flow.get((old, old), 0), 0, []
        for size, key in sorted(own, reverse=True):
            if kept + size <= stays:
                shard[key] = old
                kept += size
            else:
                rest.append((size, key))
        if kept < stays:
            size, key = rest.pop()
            shard[key] = old
            kept += size
        if old < n_new:
            room[old] -= kept
        moved += rest
    for size, key in sorted(moved, reverse=True):
        j = max(range(n_new), key=lambda j: (room[j], -j))
        shard[key] = j
        room[j] -= size
    return shard


@dataclass
class Plan:
    """docs with their places: frame holds the columns of docs and those named here."""

    frame: DataFrame
    columns: list[str]
    size: str
    crc: str
    old: str
    shard: str
    slot: str


def plan(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, *, doc_id: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> Plan:
    """Every row of docs with its size, checksum, old and new shard and slot; sizes of the new shards are near weights (equal).

    size is the UTF-8 bytes of the text (null: none) plus 8.  slot counts a shard's rows from 0 without
    gaps.  Null and repeated ids and texts are rows like any other; the rows are never joined by id.
    """
    size, crc, old, th, block, part, shard, file, slot, first, heavy = names = spare(docs.columns, "size", "crc", "old", "th", "block", "part", "shard", "file", "slot", "first", "heavy")
    raw = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn(size, (F.octet_length(raw) + 8).cast("bigint")).withColumn(crc, F.crc32(raw.cast("binary"))).withColumn(old, old_shard.cast("int")).withColumn(th, F.xxhash64(raw, F.lit("block")))
    own = F.xxhash64(F.col(doc_id).cast("string"), th)
    total = base.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    weights = weights or [1.0] * n_new
    targets = [int(total * w / sum(weights)) + 1 for w in weights]
    least = min(targets)
    # At most HEAVY of a shard; a part of its own for each PARTS-th of the target that a text beyond a target fills.
    large = base.groupBy(old, th).agg(F.sum(size).alias("s")).where(F.col("s") * HEAVY > least).orderBy(old, th).collect()
    spark = docs.sparkSession
    apart = spark.createDataFrame([(r[0], r[1], BLOCKS + i, -(-r[2] * PARTS // least) if r[2] > least else 1) for i, r in enumerate(large)], f"{old} int, {th} bigint, {heavy} int, {part}_n int")
    base = base.join(F.broadcast(apart), [old, th], "left")
    base = base.withColumn(block, F.coalesce(heavy, F.pmod(F.col(th), F.lit(BLOCKS)).cast("int"))).withColumn(part, F.pmod(own, F.coalesce(F.col(f"{part}_n"), F.lit(1))).cast("int"))
    sizes = base.groupBy(old, block, part).agg(F.sum(size).alias("s")).collect()
    to = assign([(tuple(r[:3]), r[0], r[3]) for r in sizes], n_old, targets)
    places = spark.createDataFrame([(*k, v) for k, v in to.items()], f"{old} int, {block} int, {part} int, {shard} int")
    files = max(1, -(-max(targets) // FILE_BYTES))
    base = base.join(F.broadcast(places), [old, block, part]).withColumn(file, F.pmod(F.xxhash64(own, F.lit("file")), F.lit(files)).cast("int"))
    # One row for FILE_BYTES of text: what stands before each file in its shard.
    counts = base.groupBy(shard, file).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(shard, file, (F.sum("n").over(Window.partitionBy(shard).orderBy(file)) - F.col("n")).alias(first))
    within = Window.partitionBy(shard, file).orderBy(F.col(doc_id), th)
    placed = base.withColumn(slot, F.row_number().over(within) - 1).join(F.broadcast(before), [shard, file])
    placed = placed.withColumn(slot, (F.col(first) + F.col(slot)).cast("bigint"))
    return Plan(placed.select(*docs.columns, size, crc, old, shard, slot), docs.columns, names[0], names[1], names[2], shard, slot)


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, *, doc_id: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row, by plan()."""
    p = plan(docs, old_shard, n_old, n_new, doc_id=doc_id, text=text, weights=weights)
    return p.frame.select(F.col(doc_id).alias("doc_id"), F.col(p.size).alias("size"), F.col(p.crc).alias("text_crc32"), F.col(p.old).alias("old_shard"), F.col(p.shard).alias("shard"), F.col(p.slot).alias("slot"))


def rewrite(p: Plan, path: str) -> list[int]:
    """Write anew, one folder a shard, the shards that gain or lose a row; returns their numbers.  Rows lie in order of slots."""
    moved = p.frame.where(F.col(p.shard) != F.col(p.old))
    both = moved.select(F.array(p.shard, p.old).alias("s")).select(F.explode("s").alias("s")).distinct()
    changed = sorted(r["s"] for r in both.collect())
    p.frame.where(F.col(p.shard).isin(changed)).select(*p.columns, p.old, p.slot, p.shard).write.option("compression", "zstd").partitionBy(p.shard).parquet(path)
    return changed


N_OLD, N_NEW = 16, 24


def op8_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by hash of the text to 24 of near equal bytes: the new files, read again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.coalesce("text", F.lit(""))
    p = plan(docs, F.pmod(F.xxhash64(raw), F.lit(N_OLD)), N_OLD, N_NEW)
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:12]}"
    changed = rewrite(p, path)
    columns = ["doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(p.shard).alias("shard"), F.col(p.slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col(p.old).alias("old_shard")]
    # Shards that did not change keep their files.
    rows = p.frame.where(~F.col(p.shard).isin(changed)).select(*columns)
    return spark.read.schema(p.frame.select(*docs.columns, p.old, p.slot, p.shard).schema).parquet(path).select(*columns).unionByName(rows) if changed else rows
