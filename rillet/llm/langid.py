"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

A word is a run between white space that holds a letter.  Its score for a language is the mean log
probability of its byte n-grams (with word borders) times a length weight, from counts over a bounded
training sample.  A language is a candidate for a word only if the word's scripts occur in the
language's own training text; other languages are excluded, unless that leaves none.  Over a text's words, Viterbi maximises the sum of word scores less
`switch` for each change of language; the path gives spans, and the language with most letters in it
is the text's.  Scoring is one pass over whole texts, without a shuffle; words are scored once each
and the dynamic programme runs over all texts of a batch together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.llm.common import column_of, crc_mod, lean, read, small_batches

#: Fixed values of the Unicode standard: script, first and last code point of its main blocks.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPTS = sorted({name for name, _, _ in SCRIPT_RANGES})
_BIT = {name: 1 << i for i, name in enumerate(SCRIPTS)}
OTHER_SCRIPT = 1 << len(SCRIPTS)
SLOTS = 1 << 16
SIZES = (2, 3, 4)
#: Distinct words that a worker keeps scores of; beyond it the cache starts anew.
CACHE_WORDS = 300_000
WORD_BATCH_BYTES = 8 << 20
#: Score of a language that is no candidate for a word; never chosen while there is a candidate.
NO_CANDIDATE = -1e9


def scripts_of(word: str) -> int:
    """Bit set of the scripts of a word's letters; 0 if it has no letter."""
    if word.isascii():
        return _BIT["latin"] if re.search("[A-Za-z]", word) else 0
    bits = 0
    for c in set(word):
        if c.isalpha():
            o = ord(c)
            bits |= next((_BIT[name] for name, lo, hi in SCRIPT_RANGES if lo <= o <= hi), OTHER_SCRIPT)
    return bits


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte n-grams of the words, lower-cased and with borders, and the word that each belongs to."""
    raw = [f" {w.lower()} ".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    slots, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, dtype=np.uint64)
        for j in range(n):
            code = code * np.uint64(0x100000001B3) ^ data[j : len(data) - n + 1 + j]
        code = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(48)
        inside = owner[: len(code)] == owner[n - 1 :]
        slots.append(code[inside].astype(np.int64))
        owners.append(owner[: len(code)][inside])
    return np.concatenate(slots or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


class _Seen(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class LanguageModel:
    """Log probabilities of hashed n-grams and allowed scripts for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, script_letters: np.ndarray, *, switch: float = 8.0, script_share: float = 0.01) -> None:
        self.langs, self.switch = langs, switch
        total = counts.sum(0, keepdims=True)
        self.table = np.log((counts + 0.1) / (total + 0.1 * SLOTS)).astype(np.float32)
        share = script_letters / np.maximum(script_letters.sum(1, keepdims=True), 1)
        self.allowed = share >= script_share

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language, and the letters of each word."""
        slots, owner = _grams(words)
        n = len(words)
        out = np.empty((n, len(self.langs)), dtype=np.float32)
        grams = np.maximum(np.bincount(owner, minlength=n), 1)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, weights=self.table[slots, k], minlength=n) / grams
        bits = np.array([scripts_of(w) for w in words], dtype=np.int64)
        letters = np.where(bits > 0, [len(w) for w in words], 0)
        out *= np.minimum(2 + letters, 12)[:, None].astype(np.float32)
        for b in np.unique(bits):
            if b:
                own = [i for i in range(len(SCRIPTS)) if b >> i & 1]
                ok = self.allowed[:, own].any(1) if own else np.zeros(len(self.langs), bool)
                if ok.any():
                    out[np.ix_(bits == b, ~ok)] = NO_CANDIDATE
        return out, letters

    def label(self, texts: list[str | None], seen: _Seen, cache: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the language of each word with a letter, and those words' letters."""
        words = [t.split() if t else [] for t in texts]
        if len(seen) > CACHE_WORDS:
            seen.clear()
            cache[:] = []
        known = len(seen)
        ids = np.fromiter((i for w in words for i in map(seen.__getitem__, w)), dtype=np.int64, count=sum(map(len, words)))
        if len(seen) > known:
            fresh = self.score_words(list(seen)[known:])
            cache[:] = [np.concatenate([cache[0], fresh[0]]), np.concatenate([cache[1], fresh[1]])] if cache else list(fresh)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not len(ids):
            return [np.zeros(0, np.int16)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        scores, letters = cache
        real = letters[ids] > 0
        owner = np.repeat(np.arange(len(texts)), lengths)[real]
        ids = ids[real]
        lengths = np.bincount(owner, minlength=len(texts))
        path = viterbi(scores, ids, lengths, self.switch)
        cuts = np.cumsum(lengths)[:-1]
        return np.split(path, cuts), np.split(letters[ids], cuts)


def viterbi(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every item of many sequences laid end to end; a change of label costs `switch`.

    Step t handles the t-th item of every sequence that has one, so the steps are as many as the
    longest sequence has items.
    """
    n_lang = scores.shape[1]
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    stay = np.empty((len(ids), n_lang), dtype=bool)
    best = np.zeros(len(ids), dtype=np.int16)
    v = np.zeros((len(sizes), n_lang), dtype=np.float32)
    for t, a in enumerate(active):
        at = starts[:a] + t
        s = scores[ids[at]]
        if t == 0:
            v[:a] = s
            continue
        prev = v[:a]
        top = prev.max(1, keepdims=True) - np.float32(switch)
        stay[at] = keep = prev >= top
        best[at] = prev.argmax(1)
        v[:a] = s + np.where(keep, prev, top)
        v[:a] -= v[:a].max(1, keepdims=True)
    path = np.zeros(len(ids), dtype=np.int16)
    cur = v.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        path[at] = c = cur[:a]
        if t:
            cur[:a] = np.where(stay[at, c], c, best[at])
    return path


#: Most languages; a model takes SLOTS * 4 bytes of each, 134 MB in all at this bound.
MAX_LABELS = 512


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500, switch: float = 8.0) -> LanguageModel:
    """Count n-grams in a sample of about per_language texts of each language, chosen by a hash of the id.

    Rows without language or text teach nothing.  More than MAX_LABELS distinct languages are an error.
    """
    good = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = good.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    langs = [r["lang"] for r in found]
    if not langs:
        return LanguageModel([], np.zeros((SLOTS, 0)), np.zeros((0, len(SCRIPTS))), switch=switch)
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in found}
    rate = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)]), F.col(lang))
    unit = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    number = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each language's n-grams, and behind them (from SLOTS on) its letters by script."""
        for batch in small_batches(batches):
            ks, slots, counts = [], [], []
            for text_, lang_ in zip(column_of(batch, "text").to_pylist(), column_of(batch, "lang").to_pylist(), strict=True):
                words = [w for w in text_.split() if scripts_of(w)]
                if not words:
                    continue
                found, n = np.unique(_grams(words)[0], return_counts=True)
                bits = np.array([scripts_of(w) for w in words])
                letters = np.array([len(w) for w in words])
                by = np.array([letters[bits >> i & 1 == 1].sum() for i in range(len(SCRIPTS))])
                slots += [found, SLOTS + np.flatnonzero(by)]
                counts += [n, by[by > 0]]
                ks.append(np.full(len(found) + (by > 0).sum(), number[lang_], np.int32))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((ks, np.int32), (slots, np.int32), (counts, np.int64))], names=["k", "slot", "n"])

    counts = np.zeros((SLOTS, len(langs)))
    scripts = np.zeros((len(langs), len(SCRIPTS)))
    sample = good.where(unit < rate).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # Summed by executors: what comes to the driver is bounded by the model's size, whatever the sample.
    sums = sample.mapInArrow(lean(count), "k int, slot int, n bigint").groupBy("k", "slot").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    k, slot, n = (found.column(c).to_numpy() for c in ("k", "slot", "n"))
    gram = slot < SLOTS
    counts[slot[gram], k[gram]] = n[gram]
    scripts[k[~gram], slot[~gram] - SLOTS] = n[~gram]
    return LanguageModel(langs, counts, scripts, switch=switch)


def identify(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (share of its letters in that language), n_words, spans.

    spans lists (first, last, lang) over the words with a letter, last exclusive.  Null, empty and
    letterless texts give `und`, score 0 and no span.  Ties go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen, cache = _Seen(), []
        for batch in small_batches(batches, "text", WORD_BATCH_BYTES):
            texts = column_of(batch, "text").to_pylist()
            if m.langs:
                paths, letters = m.label(texts, seen, cache)
            else:
                paths, letters = [np.zeros(0, np.int16)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
            langs, scores, spans = [], [], []
            for p, w in zip(paths, letters, strict=True):
                if not len(p):
                    langs.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                by = np.bincount(p, weights=w, minlength=len(m.langs))
                k = int(by.argmax())
                langs.append(m.langs[k])
                scores.append(float(by[k] / by.sum()))
                cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
                spans.append([{"first": a, "last": b, "lang": m.langs[int(p[a])]} for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([len(p) for p in paths], pa.int64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "n_words", "spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, n_words bigint, spans array<struct<first:int,last:int,lang:string>>")


def op1_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
