"""Near-duplicate documents by SimHash, matched over the anchors of a covering code.

Fingerprint: majority vote over the XXH64 (seed 42) of all 3-word shingles.  Two fingerprints link at
`threshold` (2) or fewer differing bits.

Matching: 46 of the 64 bits form two words of the binary Golay code of length 23, whose code words
cover their space within radius 3; the anchors are the pairs of code words.  A distinct fingerprint
is replicated to every anchor whose distance in each half exceeds the radius by no more than the
threshold in all.  If x and y differ in two bits, y is a replica at the anchor that covers x (its
home), so comparing replicas with residents at each anchor finds every link.  There are 2**24 anchors
and about 61 replicas of a fingerprint, however many documents there are.

A group of one anchor is compared pair by pair while that is little work, and beyond it by grouping
the fingerprints' neighbours at one bit, which is linear.  A group too large for a worker's memory
takes the same step as a Spark aggregation.  Copies share one fingerprint and are handled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from rillet.llm.common import column_of, components, lean, read, small_batches, spare, written

N = 23
RADIUS = 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
THRESHOLD = 2
#: Pairs up to which an anchor's members are compared one by one, and members that a worker holds of one anchor.
PAIRS = 4096
HELD = 2_000_000


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 4096):
        votes += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, *, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words; no words give 0."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate([[0], ends[:-shingle]]).tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(first, last, strict=True)], dtype="<u8")
    return majority(h)


def fingerprints(docs: DataFrame, *, text: str = "text", column: str = "fp") -> DataFrame:
    """docs with the signed 64-bit fingerprint of each row; one pass, no shuffle."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.LongType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            fp = np.array([fingerprint(t) for t in column_of(batch, text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names), pa.array(fp)], names=[*names, column])

    return docs.select(*names).mapInArrow(lean(run), schema)


def _syndromes() -> np.ndarray:
    """Remainder modulo the generator of every word of N bits."""
    bit = np.zeros(N, dtype=np.int64)
    for i in range(N):
        x = 1 << i
        for j in range(N - 1, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        bit[i] = x
    out = np.zeros(1, dtype=np.int64)
    for i in range(N):
        out = np.concatenate([out, out ^ bit[i]])
    return out


class Anchors:
    """The error patterns of each syndrome by how far their weight exceeds the covering radius."""

    def __init__(self, threshold: int = THRESHOLD) -> None:
        self.threshold = threshold
        syndromes = _syndromes()
        masks = np.array([sum(1 << i for i in c) for w in range(RADIUS + threshold + 1) for c in combinations(range(N), w)], dtype=np.int64)
        weight = np.bitwise_count(masks).astype(np.int64)
        by = syndromes[masks]
        order = np.lexsort((weight, by))
        by, masks, weight = by[order], masks[order], weight[order]
        start = np.searchsorted(by, np.arange(1 << 11))
        place = np.arange(len(by)) - start[by]
        self.syndrome = syndromes.astype(np.int16)
        self.mask = np.zeros((1 << 11, place.max() + 1), dtype=np.int64)
        self.excess = np.full((1 << 11, place.max() + 1), 99, dtype=np.int64)
        self.mask[by, place] = masks
        self.excess[by, place] = np.maximum(weight - RADIUS, 0)

    def replicas(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, index of the fingerprint, and whether the anchor is its home."""
        low, high = fp & ((1 << N) - 1), fp >> N & ((1 << N) - 1)
        sl, sh = self.syndrome[low].astype(np.int64), self.syndrome[high].astype(np.int64)
        over = self.excess[sl][:, :, None] + self.excess[sh][:, None, :]
        row, i, j = np.nonzero(over <= self.threshold)
        anchor = (low[row] ^ self.mask[sl[row], i]) << N | (high[row] ^ self.mask[sh[row], j])
        return anchor, row, over[row, i, j] == 0


def _replicate(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(threshold)
        for batch in batches:
            fp = column_of(batch, "fp").to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 2000):
                anchor, row, home = anchors.replicas(fp[a : a + 2000])
                yield pa.record_batch([pa.array(anchor), pa.array(fp[a : a + 2000][row]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


_FLIPS = np.array([0, *(1 << i for i in range(64))], dtype=np.uint64)


def _linear_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a group's pairs at 2 or fewer bits join: all that share a neighbour at one bit meet its first."""
    u = fp.view(np.uint64)
    parts = max(1, len(u) * 65 // 4_000_000)
    out_a, out_b = [], []
    for part in range(parts):
        keys, owners = [], []
        for flip in _FLIPS:
            z = u ^ flip
            mine = np.flatnonzero((z * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part) if parts > 1 else np.arange(len(u))
            keys.append(z[mine])
            owners.append(mine)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = owner[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        link = np.unique(np.stack([first, owner], 1)[first != owner], axis=0)
        out_a.append(fp[link[:, 0]])
        out_b.append(fp[link[:, 1]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare(threshold: int):
    def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(head, len(anchor)))
        residents = np.add.reduceat(home.astype(np.int64), head)
        big = (residents * size > PAIRS) & (threshold == 2)
        out = [(fp[h : h + s], None) for h, s in zip(head[big], size[big], strict=True)]
        out = [_linear_links(np.unique(x)) for x, _ in out]
        group = np.repeat(np.arange(len(head)), size)
        live = home & ~big[group]
        at = np.flatnonzero(live)
        for a in range(0, len(at), 20_000):
            own = at[a : a + 20_000]
            n = size[group[own]]
            left = np.repeat(own, n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head[group[own]], n)
            x, y = fp[left], fp[right]
            ok = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold)
            out.append((x[ok], y[ok]))
        return tuple(np.concatenate(k) for k in zip(*out, strict=True)) if out else (fp[:0], fp[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "over"]
        held: list[tuple[np.ndarray, ...]] = []
        rows, beyond = 0, None
        for batch in batches:
            anchor, fp = (column_of(batch, c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp"))
            home = column_of(batch, "home").to_numpy(zero_copy_only=False)
            if beyond is not None:
                mine = anchor == beyond
                if mine.any():
                    yield pa.record_batch([pa.array(fp[mine]), pa.array(anchor[mine]), pa.array(np.ones(mine.sum(), bool))], names=names)
                    anchor, fp, home = anchor[~mine], fp[~mine], home[~mine]
                if not len(anchor):
                    continue
                beyond = None
            held.append((anchor, fp, home))
            rows += len(anchor)
            if rows < 200_000:
                continue
            anchor, fp, home = (np.concatenate(k) for k in zip(*held, strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                a, b = links(anchor[:cut], fp[:cut], home[:cut])
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], names=names)
            anchor, fp, home = anchor[cut:], fp[cut:], home[cut:]
            held, rows = [(anchor, fp, home)], len(anchor)
            if rows > HELD:
                yield pa.record_batch([pa.array(fp), pa.array(anchor), pa.array(np.ones(rows, bool))], names=names)
                held, rows, beyond = [], 0, anchor[0]
        if rows:
            a, b = links(*(np.concatenate(k) for k in zip(*held, strict=True)))
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], names=names)

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    replicas = distinct.select("fp").mapInArrow(lean(_replicate(threshold)), "anchor bigint, fp bigint, home boolean")
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor")
    found = written(dealt.mapInArrow(lean(_compare(threshold)), "a bigint, b bigint, over boolean"), "simhash-links")
    near = found.where("not over").select("a", "b")
    flips = F.array(*[F.lit(int(x)) for x in _FLIPS.view(np.int64)])
    keyed = found.where("over").select(F.col("a").alias("fp"), F.explode(F.transform(flips, lambda m: F.col("a").bitwiseXOR(m))).alias("z"))
    least = keyed.groupBy("z").agg(F.min("fp").alias("b"))
    return near.unionByName(keyed.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def classes(fps: DataFrame, *, doc_id: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """fp and component_id (smallest doc_id reachable) of every distinct fingerprint of fps (doc_id, fp)."""
    distinct = written(fps.groupBy("fp").agg(F.min(doc_id).alias("least")), "simhash-distinct")
    roots = components(links(distinct, threshold))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.join(owner, "root").select("fp", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id of every row of docs.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other.  Repeated rows
    have one class.  A class whose ids are all null has a null component_id.
    """
    fps = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash-fp")
    return fps.join(classes(fps, threshold=threshold), "fp")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs without all but the first (smallest id) of each near-duplicate class; rows without an id stay."""
    (gone,) = spare(docs.columns, "drop")
    drop = near_duplicates(docs, doc_id=doc_id, text=text, threshold=threshold).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, docs[doc_id] == drop[gone], "left_anti")


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
