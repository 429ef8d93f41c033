"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton of all items (no match crosses an item) is built once per bounded block of items and
sent to the workers; documents stream through it, one state and one matching length per word.  A
window is `window` consecutive words of an item, or a whole shorter item.  A window occurs where the
matching length reaches its size in a state, or a suffix link's state, that stands for it.  Before
the walk, pairs of neighbouring words that no item has cut a document into runs, and runs shorter
than the smallest window are passed over: no match can lie there.

Documents are read once for each block of items, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.llm.common import column_of, lean, read, small_batches, spare, written

WINDOW = 10
#: Text bytes of the items in one automaton; more items make more blocks.
BLOCK_BYTES = 2 << 20

#: Bytes of words stay (digits, letters in lower case, all beyond ASCII); any other becomes a blank.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class _Vocabulary(dict):
    """-1 for unknown words."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocabulary = _Vocabulary()
        self.length, self.link, self.goto = [0], [-1], {}
        outs: list[list[int]] = [[]]
        sequences = []
        for item, text in items:
            words = folded(text).split()
            if words:
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        self._outs = outs
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        del self._outs
        own: dict[int, dict[int, set[str]]] = {}
        self.smallest = window
        pairs = set()
        for item, seq in sequences:
            size = min(window, len(seq))
            self.smallest = min(self.smallest, size)
            pairs.update(a << 32 | b for a, b in zip(seq, seq[1:], strict=False))
            state = 0
            for i, c in enumerate(seq):
                state = self.goto[state << 32 | c]
                if i + 1 >= size:
                    s = state
                    while self.length[self.link[s]] >= size:
                        s = self.link[s]
                    own.setdefault(s, {}).setdefault(size, set()).add(item)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        # The windows of a state: its own and those of all its suffixes.
        self.ends: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            above = self.ends[self.link[s]]
            self.ends[s] = above + tuple((n, frozenset(x)) for n, x in own[s].items()) if s in own else above

    def _extend(self, last: int, c: int) -> int:
        goto, length, link, outs = self.goto, self.length, self.link, self._outs
        there = goto.get(last << 32 | c)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._clone(last, c, there)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        outs.append([])
        p = last
        while p != -1 and (p << 32 | c) not in goto:
            goto[p << 32 | c] = new
            outs[p].append(c)
            p = link[p]
        if p != -1:
            q = goto[p << 32 | c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        goto, length, link, outs = self.goto, self.length, self.link, self._outs
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        outs.append(list(outs[q]))
        for w in outs[q]:
            goto[new << 32 | w] = goto[q << 32 | w]
        link[q] = new
        while p != -1 and goto.get(p << 32 | c) == q:
            goto[p << 32 | c] = new
            p = link[p]
        return new

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which a window may lie."""
        if self.smallest > 1:
            if len(ids) < 2 or not len(self.pairs):
                return []
            pair = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.pairs, pair).clip(max=len(self.pairs) - 1)
            ok = (self.pairs[at] == pair) & (ids[:-1] >= 0) & (ids[1:] >= 0)
            more = 1
        else:
            ok, more = ids >= 0, 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        first, last = edge[::2], edge[1::2] + more
        keep = last - first >= self.smallest
        return list(zip(first[keep].tolist(), last[keep].tolist(), strict=True))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items with an occurring window."""
        hit = np.zeros(len(words), dtype=bool)
        found: set = set()
        if not self.vocabulary or not words:
            return hit, found
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int64, count=len(words))
        goto, length, link, ends = self.goto, self.length, self.link, self.ends
        for first, last in self._runs(ids):
            state = matched = 0
            for i, c in enumerate(ids[first:last].tolist(), first):
                nxt = goto.get(state << 32 | c)
                while nxt is None and state:
                    state = link[state]
                    matched = length[state]
                    nxt = goto.get(state << 32 | c)
                if nxt is None:
                    matched = 0
                    continue
                state, matched = nxt, matched + 1
                for size, items in ends[state]:
                    if size <= matched:
                        hit[i - size + 1 : i + 1] = True
                        found |= items
        return hit, found


def _blocks(bench: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about block_bytes, each collected by itself."""
    items = bench.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()]


def find(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, columns: tuple[str, str, str] = ("_words", "_hit", "_items")) -> DataFrame:
    """docs with three more columns, of the names given: words (count), hits (runs of hit words as first, last exclusive) and items (ids as strings, sorted).

    Null texts have no words; null, empty and wordless items have no window; an item without an id
    hits words but is not listed.  A column of docs with one of the names is an error.  Repeated items count once by id.  Without items nothing is hit.
    """
    n_words, hit_runs, found_items = columns
    if clash := {c.lower() for c in columns} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has {sorted(clash)} already: give other names as columns")
    extra = [T.StructField(n_words, T.LongType()), T.StructField(hit_runs, T.ArrayType(T.IntegerType())), T.StructField(found_items, T.ArrayType(T.StringType()))]
    names = docs.columns
    out = docs
    for k, items in enumerate(_blocks(bench, item_id, bench_text, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in small_batches(batches, text):
                counts, hits, items_ = [], [], []
                before = zip(column_of(batch, hit_runs).to_pylist(), column_of(batch, found_items).to_pylist(), strict=True) if again else None
                for t in column_of(batch, text).to_pylist():
                    words = folded(t).split()
                    hit, found = automaton.hits(words)
                    if before is not None:
                        runs, ids = next(before)
                        for a, b in zip(runs[::2], runs[1::2], strict=True):
                            hit[a:b] = True
                        found |= set(ids)
                    counts.append(len(words))
                    hits.append(np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist())
                    items_.append(sorted(x for x in found if x is not None))
                kept = [column_of(batch, n) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items_, pa.list_(pa.string()))], names=[*names, *columns])

        if k:
            out = written(out, "decontaminate")
        out = out.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *extra]))
    return out


def cut_words(text: str, runs: list[int]) -> str:
    """The text without the words of the runs (first, last exclusive) and what stands between them."""
    raw, fold = text.encode("utf-8", "surrogatepass"), folded(text)
    inside = np.frombuffer(fold, dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    parts, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        parts.append(raw[at : starts[a]])
        at = ends[b - 1]
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, bench: DataFrame, *, text: str = "text", min_span: int = 1, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without benchmark passages: hit runs of min_span words or more are cut from the text.

    A row whose hit words exceed max_coverage of its words is dropped whole.  Cutting can bring words
    together that make a new window; so rows that were cut are searched again until none is cut (each cut
    shortens the text, so this ends).
    Rows without a hit are untouched, null texts included.
    """
    names, schema = docs.columns, docs.schema
    *added, mark = spare(names, "words", "hit", "items", "changed")
    current = docs
    for k in count():
        found = find(current, bench, text=text, columns=tuple(added), **options)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, text):
                texts, keep, changed = [], [], []
                rows = zip(*(column_of(batch, c).to_pylist() for c in (text, *added[:2])), strict=True)
                for t, n, runs in rows:
                    n_hit = sum(runs[1::2]) - sum(runs[::2])
                    long = [x for a, b in zip(runs[::2], runs[1::2], strict=True) if b - a >= min_span for x in (a, b)]
                    keep.append(n_hit <= max_coverage * n)
                    changed.append(bool(long))
                    texts.append(cut_words(t, long) if long else t)
                columns = [pa.array(texts, pa.string()) if n == text else column_of(batch, n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(changed)], names=[*names, mark]).filter(pa.array(keep))

        done = found.mapInArrow(lean(run), T.StructType([*schema.fields, T.StructField(mark, T.BooleanType())]))
        if k == 0:
            done = written(done, "decontaminated")
            clean = done.where(~F.col(mark)).select(*names)
        else:
            done = written(done, "decontaminated")
            clean = clean.unionByName(done.where(~F.col(mark)).select(*names))
        current = done.where(F.col(mark)).select(*names)
        if current.isEmpty():
            break
    return clean


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark table."""
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    step = F.sequence(F.lit(0), F.size("_hit") - 2, F.lit(2))
    hit = F.when(F.size("_hit") == 0, F.lit(0)).otherwise(F.aggregate(F.transform(step, lambda i: F.get("_hit", i + 1) - F.get("_hit", i)), F.lit(0), lambda a, b: a + b)).cast("bigint")
    return found.select("doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_hit") > 0).alias("contaminated"))



#: Windows as strings; a window's size is 10 or that of a shorter item.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM sized)),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS t FROM (SELECT d.doc_id, d.w, s.n, unnest(range(greatest(len(d.w) - s.n + 1, 0))) AS i FROM d, size s)),
found AS (SELECT spot.doc_id, spot.n, spot.i, win.item_id FROM spot JOIN win ON spot.n = win.n AND spot.t = win.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items, sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN item k ON d.doc_id = k.doc_id
"""
