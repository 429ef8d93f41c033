"""Quality classifier learnt from positive and unlabelled texts (non-negative unbiased risk).

A text becomes shares of byte-class trigrams and a few word statistics, so that the model sees form
(case, symbols, repetition, tables) and no vocabulary of one language.  Trusted positives are the rows
with quality 1; all other rows are unlabelled.  A linear model minimises

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss.  The prior, the share of positives among the unlabelled, is estimated beforehand from
scores of held-out positives and unlabelled rows; no other label is used.  The fit uses a bounded sample
(`max_positive`, `max_unlabelled` rows, taken by hash); scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.llm.common import column_of, crc_mod, lean, read, small_batches

#: Byte classes: 0 other symbol, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 beyond ASCII.
N_CLASS = 8
N_TRIGRAM = N_CLASS**3
N_STAT = 8
N_FEATURE = N_TRIGRAM + N_STAT


def _classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[97:123], out[65:91], out[48:58], out[[32, 9]], out[[10, 13]], out[128:] = 1, 2, 3, 4, 5, 7
    out[[ord(c) for c in ".,;:?'-"]] = 6
    return out


CLASSES = _classes()


def features(texts: list[str | None]) -> np.ndarray:
    """One row of N_FEATURE numbers for each text; null and empty texts give zeros."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), N_FEATURE), dtype=np.float32)
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(data) >= 3:
        kind = CLASSES[data]
        code = kind[:-2] * (N_CLASS * N_CLASS) + kind[1:-1] * N_CLASS + kind[2:]
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        inside = owner[:-2] == owner[2:]
        counts = np.bincount((owner[:-2].astype(np.int64) * N_TRIGRAM + code)[inside], minlength=len(raw) * N_TRIGRAM).reshape(len(raw), N_TRIGRAM)
        out[:, :N_TRIGRAM] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    for i, text in enumerate(texts):
        words = text.split() if text else []
        if words:
            n = len(words)
            again = sum(map(str.__eq__, words, words[1:])) / n
            fresh = len(set(words)) / n
            mean = (len(text) - n + 1) / n
            lines = text.count("\n") + 1
            out[i, N_TRIGRAM:] = (1.0, np.log1p(n) / 10, again, fresh, min(mean, 40) / 20, np.sqrt(again), min(lines / n, 1), fresh * np.log1p(n) / 10)
    return out


FEATURE_TYPE = T.StructType([T.StructField("features", T.BinaryType())])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        x = features(column_of(batch, "text").to_pylist())
        yield pa.record_batch([column_of(batch, "label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "features"])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores of held-out positives and unlabelled rows alone.

    Above a threshold lie a share of the positives and a share of the unlabelled; the second over the first
    bounds the prior from above, closest where few negatives score as high (Garg et al. 2021, best bin
    estimation).  The threshold is the one of least upper confidence bound.  Without scores it is 0.5.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    doubt = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    best = int(np.argmin((above_u + doubt) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def held_out_scores(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Scores of rows that a classifier of positive against unlabelled was not fitted on: two halves, each scored by the other's."""
    outs: tuple[list, list] = ([], [])
    for k in (0, 1):
        p, u = positive[k::2], unlabelled[k::2]
        if not len(p) or not len(u):
            return np.zeros(0), np.zeros(0)
        # Of positives and unlabelled rows as they are: the plain risk, which is that of a prior of a half with nothing taken back.
        w, b, mean, scale = fit_plain(p, u, rounds=rounds)
        for out, x in zip(outs, (positive[1 - k :: 2], unlabelled[1 - k :: 2]), strict=True):
            out.append(((x - mean.astype(np.float32)) / scale.astype(np.float32)) @ w.astype(np.float32) + b)
    return np.concatenate(outs[0]), np.concatenate(outs[1])


def fit_plain(one: np.ndarray, zero: np.ndarray, *, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, mean and scale of a logistic model with both classes at equal weight (Adam, full batches)."""
    both = np.concatenate([one, zero])
    mean, scale = both.mean(0, dtype=np.float64), both.std(0, dtype=np.float64) + 1e-3
    del both
    p, u = ((x - mean.astype(np.float32)) / scale.astype(np.float32) for x in (one, zero))
    step = _Adam(p.shape[1] + 1, rate)
    w, b = np.zeros(p.shape[1]), 0.0
    for _ in range(rounds):
        zp, zu = (np.clip((x @ w.astype(np.float32)).astype(np.float64) + b, -30, 30) for x in (p, u))
        gp, gu = -1 / (1 + np.exp(zp)) / len(p), 1 / (1 + np.exp(-zu)) / len(u)
        move = step(np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + ridge * w, gp.sum() + gu.sum()))
        w, b = w - move[:-1], b - float(move[-1])
    return w, b, mean, scale


class _Adam:
    """Steps of the Adam rule."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def __call__(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def pu_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of scores of positives and unlabelled rows, and the direction of the step in both.

    Where the estimated negative risk is below zero, the step goes against it, as the non-negative correction asks.
    """
    negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    up, down, rest = -prior * (1 - sp) / len(zp), -prior * sp / len(zp), su / len(zu)
    risk = prior * np.log1p(np.exp(-zp)).mean() + max(0.0, negative)
    return (risk, up + down, rest) if negative >= 0 else (risk, -down, -rest)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, mean and scale of the non-negative PU logistic model (Adam, full batches)."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0, dtype=np.float64), both.std(0, dtype=np.float64) + 1e-3
    del both
    p, u = ((x - mean.astype(np.float32)) / scale.astype(np.float32) for x in (positive, unlabelled))
    step = _Adam(p.shape[1] + 1, rate)
    w, b = np.zeros(p.shape[1]), 0.0
    for _ in range(rounds):
        zp, zu = (np.clip((x @ w.astype(np.float32)).astype(np.float64) + b, -30, 30) for x in (p, u))
        _, gp, gu = pu_gradient(zp, zu, prior)
        move = step(np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + ridge * w, gp.sum() + gu.sum()))
        w, b = w - move[:-1], b - float(move[-1])
    return w, b, mean, scale


class QualityModel:
    """A fitted model; it pickles to some kilobytes whatever the corpus."""

    def __init__(self, w: np.ndarray, b: float, mean: np.ndarray, scale: np.ndarray, prior: float) -> None:
        self.w, self.b, self.mean, self.scale, self.prior = w, b, mean, scale, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = ((features(texts) - self.mean) / self.scale) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_positive: int = 4000, max_unlabelled: int = 8000) -> QualityModel:
    """Fit on a bounded sample of docs: at most max_positive rows labelled 1 and max_unlabelled others.

    The sample takes rows by a hash of the id, so it does not depend on order or partitioning.  Labels
    other than 1, missing labels and labels of unknown documents count as unlabelled.  Where a document
    has several labels, the largest holds.  Without positives, or without text, every score is the prior.
    """
    judged = labels.where(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(quality).cast("int").alias("label"))
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")).alias("_h"))
    ids = base.select("_id", "_h").join(judged, "_id", "left")
    take = ids.where("label = 1").orderBy("_h").limit(max_positive).unionByName(ids.where("label is null or label <> 1").orderBy("_h").limit(max_unlabelled))
    sample = base.join(F.broadcast(take.select("_id", "label").dropDuplicates(["_id"])), "_id")
    rows = sample.select("label", "text").mapInArrow(lean(_feature_rows), "label int, features binary").collect()
    if not rows:
        return QualityModel(np.zeros(N_FEATURE), 0.0, np.zeros(N_FEATURE), np.ones(N_FEATURE), 0.5)
    x = np.stack([np.frombuffer(r["features"], dtype=np.float32) for r in rows])
    one = np.array([r["label"] == 1 for r in rows])
    del rows
    positive, rest = x[one], x[~one]
    del x
    # Of the unlabelled sample, which leaves out the labelled positives; no label but 1 is used.
    prior = estimate_prior(*held_out_scores(positive, rest))
    if not len(positive) or not len(rest):
        return QualityModel(np.zeros(N_FEATURE), float(np.log(prior / (1 - prior))), np.zeros(N_FEATURE), np.ones(N_FEATURE), prior)
    return QualityModel(*fit_pu(positive, rest, prior), prior)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", column: str = "score") -> DataFrame:
    """docs with one more column, the model's probability of good quality, in place of one of that name; every row is kept, nulls included."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            s = shared.value.score(column_of(batch, text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names), pa.array(s)], names=[*names, column])

    return docs.select(*names).mapInArrow(lean(run), schema)


THRESHOLD = 0.3


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels come only from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learn = crc_mod("doc_id", 5) != 0
    model = fit(docs.where(learn), read(spark, sf_dir, "labels").where(learn).select("doc_id", "quality"))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
