"""Packing of tokenised documents into sequences of a fixed size by best-two-fit.

Tokens: words (between blanks and line ends, which the vocabulary drops) are encoded once each for a
batch and looked up in a bounded cache, then put together by array operations; a document's ids end
with a separator.  Only documents longer than a sequence are cut.

Packing: pieces are dealt at random into buckets of about `bucket_rows`, each packed by itself, so a
bucket's cost is bounded and the waste is one or two sequences a bucket.  In a bucket a sequence is
filled greedily (largest piece that fits, again and again).  If a gap is left, the smallest piece gives
way to the two unpacked pieces whose sum fits the expanded gap most tightly, if that fills it better.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.llm.common import column_of, lean, read, small_batches, spare, written

SEQUENCE = 2048
SEPARATOR = 0
BUCKET_ROWS = 8192
#: Words that a worker holds at once, and those that it keeps, the most used ones, from one task to the next.
CACHE_WORDS = 400_000
KEPT_WORDS = 100_000
#: Words encoded at a time, and the marks that may end one of them.
TOGETHER = 16
MARKS = (".", ",", "!", "?", ";", ":")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers words in order of first sight and keeps the new ones apart."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Token ids of texts, equal to encoding each text whole.

    Blanks and line ends are white space to the vocabulary, which splits there and drops them; so the
    ids of a text are those of its words in turn, and a word is encoded once.  Words of lower-case letters
    alone, or with one mark behind, are one or two units to the vocabulary; they are encoded many at a time,
    without folding and pattern matching, and told apart by the tokens that end a unit.  Should their number not add up, and for all other
    words, each is encoded by itself.
    """

    def __init__(self, path: str, separator: int | None = SEPARATOR) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.separator = Tokenizer.from_file(path), separator
        # Lower-case letters need no folding, and no other cut than at blanks.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.first, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def shrink(self, most: int) -> None:
        """Keep the most used words that were seen twice, `most` at most."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:most]])
        words, first, size, pool, uses = list(self.numbers), self.first[keep], self.size[keep], self.pool, self.uses[keep]
        self._reset()
        for i in keep.tolist():
            self.numbers[words[i]]
        self.numbers.fresh = []
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        self.first, self.size, self.uses, self.pool = np.cumsum(size) - size, size, uses // 2, pool[at]

    def _flat(self, texts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    @staticmethod
    def _units(word: str) -> int:
        """1 for lower-case letters alone, 2 for such letters and a mark, 0 for any other word."""
        body = word[:-1] if word[-1:] in MARKS and len(word) > 1 else word
        if not body.isalpha() or not body.islower() or not (body.isascii() or unicodedata.is_normalized("NFC", body)):
            return 0
        return 1 + (body is not word)

    def _learn(self, words: list[str]) -> None:
        """Encode distinct new words and append them to the pool."""
        units = np.array([self._units(w) for w in words], dtype=np.int64)
        plain = np.flatnonzero(units)
        size = np.zeros(len(words), dtype=np.int64)
        first = np.zeros(len(words), dtype=np.int64)
        flat = np.zeros(0, np.uint32)
        if len(plain):
            joined = [words[i] if units[i] == 1 else f"{words[i][:-1]} {words[i][-1]}" for i in plain.tolist()]
            flat, _ = self._flat([" ".join(joined[k : k + TOGETHER]) for k in range(0, len(joined), TOGETHER)], self.plain)
            stop = np.flatnonzero(self.ends[flat]) + 1
            last = np.cumsum(units[plain])
            if len(stop) == last[-1] and stop[-1] == len(flat):
                cut = stop[last - 1]
                size[plain] = np.diff(np.concatenate([[0], cut]))
                first[plain] = cut - size[plain]
            else:
                units[:], flat = 0, np.zeros(0, np.uint32)
        odd = np.flatnonzero(units == 0)
        if len(odd):
            more, n = self._flat([words[i] for i in odd.tolist()], self.tokenizer)
            size[odd] = n
            first[odd] = len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, more])
        self.first = np.concatenate([self.first, first + len(self.pool)])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, flat])

    @staticmethod
    def _lower(text: str) -> str:
        """The text in lower case where the vocabulary's own folding (NFC, then each letter by itself) gives the same ids."""
        if text.isascii():
            return text.lower()
        if "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            return text
        low = text.lower()
        return low if unicodedata.is_normalized("NFC", low) else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, the separator after each text, and how many each text has."""
        if len(self.numbers) > CACHE_WORDS:
            self.shrink(CACHE_WORDS // 2)
        words = [self._lower(t).replace("\n", " ").split(" ") if t else [] for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        order = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(counts.sum()))
        if self.numbers.fresh:
            self._learn(self.numbers.fresh)
            self.numbers.fresh = []
        self.uses = np.bincount(order, minlength=len(self.size)) + np.append(self.uses, np.zeros(len(self.size) - len(self.uses), np.int64))
        tail = [] if self.separator is None else [self.separator]
        pool = np.concatenate([self.pool, np.array(tail, dtype=np.uint32)])
        # The separator is one more word, number -1, and stands after each text's own.
        ends = np.cumsum(counts)
        order = np.insert(order, ends, -1)
        size, first = np.append(self.size, len(tail)), np.append(self.first, len(self.pool))
        n = size[order]
        total = np.cumsum(n)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(first[order] - total + n, n)
        stops = total[ends + np.arange(len(texts))]
        return pool[at], np.diff(np.concatenate([[0], stops]))


#: A worker's encoder by path and separator, so that its tasks load the vocabulary once.
_ENCODERS: dict[tuple[str, int | None], WordEncoder] = {}


def encoder_of(path: str, separator: int | None = SEPARATOR) -> WordEncoder:
    if (path, separator) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, separator] = WordEncoder(path, separator)
    return _ENCODERS[path, separator]


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, sequence: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32) of every piece.

    Null and empty texts are the separator alone.  Repeated rows are documents of their own.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    path = path or vocabulary_path()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in small_batches(batches):
            flat, totals = encoder.encode(column_of(batch, "text").to_pylist())
            n = -(-totals // sequence)
            row = np.repeat(np.arange(len(totals)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * sequence
            length = np.minimum(totals[row] - start, sequence)
            begin = (np.cumsum(totals) - totals)[row] + start
            raw = memoryview(flat.astype("<u4").tobytes())
            cut = [raw[4 * a : 4 * (a + b)] for a, b in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [column_of(batch, "doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array([bytes(x) for x in cut], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.shrink(KEPT_WORDS)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def best_two_fit(sizes: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; sizes lie between 1 and capacity."""
    stacks: dict[int, list[int]] = {}
    for i, s in enumerate(sizes.tolist()):
        stacks.setdefault(s, []).append(i)
    # Bit s of `there`: a piece of size s is unpacked; bit capacity - s of `turned`: the same.
    there = sum(1 << s for s in stacks)
    turned = sum(1 << capacity - s for s in stacks)

    def take(s: int) -> int:
        nonlocal there, turned
        stack = stacks[s]
        i = stack.pop()
        if not stack:
            there ^= 1 << s
            turned ^= 1 << capacity - s
        return i

    def give_back(s: int, i: int) -> None:
        nonlocal there, turned
        stacks[s].append(i)
        there |= 1 << s
        turned |= 1 << capacity - s

    def pair(most: int, least: int) -> tuple[int, int] | None:
        """Sizes of two unpacked pieces with the largest sum up to `most`, above `least`."""
        for total in range(most, least, -1):
            shift = total - capacity
            both = there & (turned << shift if shift >= 0 else turned >> -shift) & ((1 << total) - 1)
            while both:
                a = both.bit_length() - 1
                if 2 * a < total:
                    break
                if 2 * a > total or len(stacks[a]) > 1:
                    return a, total - a
                both ^= 1 << a
        return None

    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    number = 0
    while there:
        gap, held = capacity, []
        while gap and (s := (there & (1 << gap + 1) - 1).bit_length() - 1) > 0:
            held.append((s, take(s)))
            gap -= s
        if gap and there:
            s, i = held[-1]
            better = pair(gap + s, s)
            if better:
                held.pop()
                held += [(x, take(x)) for x in better]
                give_back(s, i)
        at = 0
        for s, i in held:
            bins[i], offsets[i] = number, at
            at += s
        number += 1
    return bins, offsets


def place(cut: DataFrame, *, sequence: int = SEQUENCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; cut must be a written table."""
    n = max(1, -(-cut.count() // bucket_rows))
    (bucket,) = spare(cut.columns, "bucket")
    dealt = cut.withColumn(bucket, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    fields = [f for f in dealt.schema.fields if f.name != bucket]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_two_fit(rows["length"].to_numpy(), sequence)
        out = rows[[f.name for f in fields]].copy()
        out["sequence_id"] = bins + (int(rows[bucket].iloc[0]) << 32)
        out["offset"] = offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy(bucket).applyInPandas(pack, schema)


def pack(docs: DataFrame, **options) -> DataFrame:
    """Every piece of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(written(pieces(docs, **options), "pieces"), sequence=options.get("sequence", SEQUENCE))


def sequences(docs: DataFrame, placed: DataFrame, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (array of int), from docs with unique ids."""
    whole = pieces(docs, ids=True, **options).select("doc_id", "piece", "ids")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(whole, ["doc_id", "piece"])

    def glue(rows: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(rows.sort_values("offset")["ids"])
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "ids": [np.frombuffer(raw, "<u4").astype(np.int32)]})

    return joined.groupBy("sequence_id").applyInPandas(glue, "sequence_id bigint, ids array<int>")


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
