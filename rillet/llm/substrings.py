"""Exact repeated substrings by a hash-compared suffix sort.

Every byte covered by a string of `length` (400) bytes that also starts elsewhere is removed.

Each window of `length` bytes picks its anchor: the k-gram of least hash in it, leftmost on ties.  Equal
windows pick equal anchors at equal offsets, so windows are compared only where anchors are equal.
Neighbouring windows with one anchor form a run; a run's bytes are its context.  Contexts of one 128-bit
digest count as equal (one that occurs twice is covered whole) and one of them stands for all.  Where an
anchor has several contexts, they are fetched, and the suffixes that start at the anchors, rightwards and
leftwards, are sorted: mergesort, each comparison finding the common extension by binary search over prefix
polynomial hashes; the extensions of neighbours are verified on the bytes.  For each offset of the
anchor in its window, cutting both orders where neighbours share too little gives classes, and windows
in one class to either side are equal.

A sort takes up to `hot` contexts.  An anchor with more is split by what its windows share: those with the
anchor at offsets a to b all hold the bytes from a before the anchor to `length` - b behind its start, so
only contexts that agree there are sorted together, cut to those windows, and equal cuts stand for each
other again.  Intervals of offsets are split further, down to one offset, where all windows of a group are
equal, until no group has more; so no task holds more than that of one anchor.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from rillet.llm.common import column_of, drop_written, free_shuffles, lean, read, shared_dir, small_batches, written

LENGTH = 400
GRAM = 16
HOT = 512
#: Bytes of text, or of contexts, that a worker handles at once; its arrays take about a hundred times that.
ARRAY_BYTES = 1 << 20
POS = np.uint64((1 << 31) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
KEY = ["th1", "th2"]
CONTEXT = ["ah", "c1", "c2"]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each place on; data ends with 16 bytes of padding."""
    n = len(data) - GRAM
    a = np.ndarray((n,), "<u8", data, 0, (1,))
    b = np.ndarray((n,), "<u8", data, 8, (1,))
    h = a * np.uint64(0xC2B2AE3D27D4EB4F)
    t = b * np.uint64(0x9E3779B185EBCA87)
    h ^= t >> np.uint64(23)
    h += t << np.uint64(31)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text index, anchor place in the text, lo, hi and anchor hash of each run, and the digests of its context.

    A run's windows start at place - hi .. place - lo.
    """
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    total = int(sizes.sum())
    none = np.zeros(0, dtype=np.int64)
    if total < length:
        return none, none, none, none, none.astype(np.uint64), none, none
    blob = b"".join(raw)
    data = np.frombuffer(blob + bytes(GRAM), dtype=np.uint8)
    h = _gram_hashes(data)
    v = h & ~POS
    v |= np.arange(total, dtype=np.uint64)
    w = length - GRAM + 1
    full = -(-(total + w) // w) * w
    grid = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:total] = v
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = total - length + 1
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & POS
    ends = np.repeat(np.cumsum(sizes), sizes)[:n]
    ok = np.arange(n) + length <= ends
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | ~ok[:-1]]) & ok
    first = np.flatnonzero(fresh)
    if not len(first):
        return none, none, none, none, none.astype(np.uint64), none, none
    stop = np.concatenate([(least[1:] != least[:-1]) | ~ok[1:], [True]]) & ok
    last = np.flatnonzero(stop)
    place = least[first].astype(np.int64)
    hi, lo = place - first, place - last
    view = memoryview(blob)
    digest = b"".join(xxh3_128_digest(view[a : b + length], seed=c) for a, b, c in zip(first.tolist(), last.tolist(), hi.tolist(), strict=True))
    two = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins, first, side="right") - 1
    return owner, place - begins[owner], lo, hi, h[place], two[:, 0], two[:, 1]


def _bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in column_of(batch, name).cast(pa.binary()).to_pylist()]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", ARRAY_BYTES):
            owner, place, lo, hi, ah, c1, c2 = anchors(_bytes_of(batch), length)
            key = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ah.view(np.int64)), pa.array(c1), pa.array(c2), *(column_of(batch, k).take(key) for k in KEY), *(pa.array(x, pa.int32()) for x in (place, lo, hi))],
                names=[*CONTEXT, *KEY, "place", "lo", "hi"],
            )

    return run


class Suffixes:
    """Common extensions of suffixes of one byte string by binary search over prefix polynomial hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate([data, np.zeros(1, np.uint8)])
        n = len(data)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, dtype=np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)]))
        symbol = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(symbol[data] * power[:n])])

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to `most`."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        pa_, pb, ia, ib = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa_) * ia == (self.prefix[b + mid] - pb) * ib
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        common = self.extension(a, b, np.minimum(la, lb))
        over = (common == la) | (common == lb)
        x, y = self.data[a + np.minimum(common, la)], self.data[b + np.minimum(common, lb)]
        return np.where(over, np.where(la == lb, or_equal, la < lb), x < y)

    def sort(self, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes within each group (groups lie together), and each one's extension with its forerunner, -1 at a group's first."""
        order = np.arange(len(start))
        head = np.searchsorted(group, group)
        stop = np.searchsorted(group, group, side="right")
        widest, w = int((stop - head).max(initial=0)), 1
        slot = np.arange(len(start))
        while w < widest:
            # Each suffix finds its rank in the run beside its own by binary search.
            run = head + (slot - head) // (2 * w) * (2 * w)
            left = slot < run + w
            low = np.where(left, np.minimum(run + w, stop), run)
            high = np.where(left, np.minimum(run + 2 * w, stop), np.minimum(run + w, stop))
            base = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                me, other = order[slot[live]], order[mid]
                # A left suffix counts the right ones below it; a right one counts the left ones not above it.
                below = self.less(start[other], start[me], size[other], size[me], ~left[live])
                low[live] = np.where(below, mid + 1, low[live])
                high[live] = np.where(below, high[live], mid)
                live = live[low[live] < high[live]]
            rank = low - base
            place = np.where(left, slot + rank, slot - w + rank)
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            w *= 2
        extension = np.full(len(start), -1, dtype=np.int64)
        a, b = order[:-1], order[1:]
        same = np.flatnonzero(group[a] == group[b])
        a, b = a[same], b[same]
        extension[same + 1] = found = self.extension(start[a], start[b], np.minimum(size[a], size[b]))
        self.verify(start[a], start[b], found)
        return order, extension

    def verify(self, a: np.ndarray, b: np.ndarray, found: np.ndarray) -> None:
        """Compare the bytes of the extensions; a collision of hashes is an error, not a wrong result."""
        for k in range(0, len(a), 1000):
            x, y, n = a[k : k + 1000], b[k : k + 1000], found[k : k + 1000]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if not np.array_equal(self.data[np.repeat(x, n) + step], self.data[np.repeat(y, n) + step]):
                raise ArithmeticError("prefix hashes collided")


def repeated_offsets(contexts: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context and anchor offset, whether the window with the anchor there occurs in another context of its group."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    at = begin + hi
    right_order, right = Suffixes(data).sort(at, sizes - hi, group)
    left_order, left = Suffixes(np.ascontiguousarray(data[::-1])).sort(len(data) - at, hi.copy(), group)
    out = np.zeros((len(contexts), length - GRAM + 1), dtype=bool)
    right_class, left_class = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for o in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own) < 2:
            continue
        right_class[right_order] = np.cumsum(right < length - o)
        left_class[left_order] = np.cumsum(left < o)
        both = left_class[own] * (len(contexts) + 1) + right_class[own]
        ranked = np.sort(both)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            out[own, o] = twice[np.searchsorted(twice, both).clip(max=len(twice) - 1)] == both
    return out


def _intervals(flags: np.ndarray) -> list[list[int]]:
    """First and last offset of each stretch of True, by row."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out: list[list[int]] = [[] for _ in range(len(flags))]
    rows, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    for r, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
        out[r] += [a, b - 1]
    return out


def _compare(length: int):
    names = [*CONTEXT, "offsets"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        group = np.unique([r[0] for r in rows], return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        rows, group = [rows[i] for i in order], group[order]
        flags = repeated_offsets([r[5] for r in rows], group, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), length)
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(_intervals(flags), pa.list_(pa.int32()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column_of(batch, c).to_pylist() for c in [*CONTEXT, "lo", "hi", "context"]), strict=True):
                if held and size > ARRAY_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return run


def _fetch(length: int):
    """The contexts that were asked for, cut from the texts."""
    names = [*CONTEXT, "lo", "hi", "context"]
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", ARRAY_BYTES):
            out: list[tuple] = []
            size = 0
            for raw, wanted in zip(_bytes_of(batch), column_of(batch, "wanted").to_pylist(), strict=True):
                for x in wanted:
                    out.append((x["ah"], x["c1"], x["c2"], x["lo"], x["hi"], raw[x["place"] - x["hi"] : x["place"] - x["lo"] + length]))
                    size += len(out[-1][5])
                    if size > ARRAY_BYTES:
                        yield _batch(out, names, types)
                        out, size = [], 0
            yield _batch(out, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def steps(length: int) -> list[int]:
    """Widths of the intervals of offsets: an eighth of the one before, down to 1."""
    out = [length - GRAM + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // 8))
    return out[1:] or [1]


def _split(step: int, length: int):
    """Cut contexts to the windows of each interval of offsets; the new anchor hash is that of the bytes these windows share."""
    names = [*CONTEXT, "lo", "hi", "context", "p0", "p1", "p2"]
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] + [pa.int64()] * 3
    two = "<qq"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column_of(batch, c) for c in [*CONTEXT, "lo", "hi", "context"]), strict=True):
                ah, c1, c2, lo, hi, context = (x.as_py() for x in row)
                for a in range(lo // step * step, hi + 1, step):
                    b = a + step - 1
                    shared, _ = struct.unpack(two, xxh3_128_digest(struct.pack(two, ah, a) + context[hi - a : hi + length - b]))
                    first, last = max(lo, a), min(hi, b)
                    cut = context[hi - last : hi - first + length]
                    out.append((shared, *struct.unpack(two, xxh3_128_digest(cut, seed=last)), first, last, cut if step > 1 else b"", ah, c1, c2))
                    size += len(cut)
                if size > ARRAY_BYTES:
                    yield _batch(out, names, types)
                    out, size = [], 0
        yield _batch(out, names, types)

    return run


CONTEXT_TYPE = "ah bigint, c1 bigint, c2 bigint"


def fates(cool: DataFrame, hot: DataFrame | None, length: int, limit: int, widths: list[int]) -> DataFrame:
    """CONTEXT and offsets (first, last, ...) of the windows that occur in another context, of contexts one a row.

    cool are those of anchors with up to `limit` contexts; hot ones are split by the first of `widths`.
    """
    found = cool.repartition("ah").sortWithinPartitions("ah").mapInArrow(lean(_compare(length)), f"{CONTEXT_TYPE}, offsets array<int>").where(F.size("offsets") > 0)
    if hot is None:
        return found
    parts = written(hot.mapInArrow(lean(_split(widths[0], length)), f"{CONTEXT_TYPE}, lo int, hi int, context binary, p0 bigint, p1 bigint, p2 bigint"), "context-parts")
    # At one offset equal digests are equal windows, and others are none.
    kinds = written(parts.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")), "context-kinds")
    below = kinds.where("n > 1").select(*CONTEXT, F.array("lo", "hi").alias("offsets"))
    if widths[0] > 1:
        many = written(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "context-many")
        each = written(parts.join(many, "ah").groupBy(*CONTEXT, "lo", "hi", "kinds").agg(F.first("context").alias("context")), "context-each")
        hotter = each.where(F.col("kinds") > limit)
        below = below.unionByName(fates(each.where(F.col("kinds") <= limit), None if hotter.isEmpty() else hotter, length, limit, widths[1:]))
    below = written(below, "context-fates")
    back = parts.select(*CONTEXT, "p0", "p1", "p2").join(below, CONTEXT)
    return found.unionByName(back.select(F.col("p0").alias("ah"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), "offsets"))


def _judge(length: int):
    """Lengths, spans and digest of each text, given the window starts to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", ARRAY_BYTES):
            sizes, removed, spans, shas, cuts = [], [], [], [], []
            for raw, starts in zip(_bytes_of(batch), column_of(batch, "starts").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for x in sorted(starts or [], key=lambda x: x["first"]):
                    if merged and x["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["last"] + length)
                    else:
                        merged.append([x["first"], x["last"] + length])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                cuts.append([x for s in merged for x in s])
                shas.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(column_of(batch, k) for k in KEY), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(shas, pa.string()), pa.array(cuts, pa.list_(pa.int64()))], names=[*KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """th1, th2, text, n of every distinct text, stored in buckets of the key so that joins on it move no text."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(raw.alias("text")).select(F.xxhash64("text").alias("th1"), F.xxhash64(F.lit("text"), "text").alias("th2"), "text")
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    unique.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, *KEY).saveAsTable(name)
    free_shuffles(spark)
    return spark.table(name)


def drop_texts(texts: DataFrame) -> None:
    """Delete a table made by distinct_texts() that nothing reads any longer, from the catalog and the folder."""
    spark = texts.sparkSession
    names = {f.rsplit("/", 2)[1] for f in texts.inputFiles()}
    drop_written(texts)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first, end, first, end ...) of every row of docs.

    Null texts are empty.  Repeated rows repeat each other's text.  No match crosses a text.
    """
    spark = docs.sparkSession
    texts = distinct_texts(docs, text)
    rows = written(texts.select(*KEY, "text").mapInArrow(lean(_anchor_rows(length)), "ah bigint, c1 bigint, c2 bigint, th1 bigint, th2 bigint, place int, lo int, hi int"), "anchors")
    # Aggregates are written before they are joined, so that Spark can split the joins' hot anchors.
    again = written(rows.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ah"), "anchors-again")
    shared = written(rows.join(again, "ah", "left_semi"), "anchors-shared")
    drop_written(rows)
    free_shuffles(spark)
    contexts = written(shared.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min(F.struct(*KEY, "place")).alias("at")), "contexts")
    kinds = written(contexts.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "anchor-kinds")
    wanted = contexts.join(kinds, "ah").select(F.col("at.th1").alias("th1"), F.col("at.th2").alias("th2"), F.struct(*CONTEXT, "lo", "hi", F.col("at.place").alias("place")).alias("x"), (F.col("kinds") > hot).alias("hot"))
    asked = lambda want: texts.select(*KEY, "text").join(wanted.where(want).groupBy(*KEY).agg(F.collect_list("x").alias("wanted")), KEY).select("text", "wanted").mapInArrow(lean(_fetch(length)), f"{CONTEXT_TYPE}, lo int, hi int, context binary")
    split = None if kinds.where(F.col("kinds") > hot).isEmpty() else asked("hot")
    whole = contexts.where("n > 1").select(*CONTEXT, F.array("lo", "hi").alias("offsets"))
    fate = written(whole.unionByName(fates(asked("not hot"), split, length, hot, steps(length))), "fate")
    drop_written(contexts)
    free_shuffles(spark)

    place = F.col("place")
    pair = F.transform(F.sequence(F.lit(0), F.size("offsets") - 2, F.lit(2)), lambda i: F.struct((place - F.get("offsets", i + 1)).alias("first"), (place - F.get("offsets", i)).alias("last")))
    starts = shared.join(fate, CONTEXT).select(*KEY, F.explode(pair).alias("s")).groupBy(*KEY).agg(F.collect_list("s").alias("starts"))
    copied = (F.col("n") > 1) & (F.octet_length("text") >= length)
    all_of = F.array(F.struct(F.lit(0).alias("first"), (F.octet_length("text") - length).alias("last")))
    judged = texts.join(starts, KEY, "left").select(*KEY, "text", F.when(copied, all_of).otherwise(F.col("starts")).alias("starts"))
    verdict = written(judged.mapInArrow(lean(_judge(length)), "th1 bigint, th2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"), "verdict")
    drop_texts(texts)
    raw = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw).alias("th1"), F.xxhash64(F.lit("text"), raw).alias("th2"))
    return keyed.join(verdict, KEY).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op6_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats in 400 bytes or more, over all documents."""
    return repeated(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
