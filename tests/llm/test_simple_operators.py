"""Classifiers, decontamination, packing and sharding against brute force, and on odd input."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillet.llm import common, decontaminate, langid, packing, quality, sharding


def test_quality_learns_from_positives_and_unlabelled(spark, sf):
    out = quality.op9_quality_pu(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert out.score.between(0, 1).all() and len(out) == 200
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    both = labels.merge(out, on="doc_id")
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert np.mean([(x > bad).mean() for x in good]) > 0.97


def test_quality_risk_is_not_negative_and_odd_input(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (200, 3)), np.concatenate([rng.normal(2, 1, (150, 3)), rng.normal(-2, 1, (150, 3))])
    w, b, mean, scale = quality.fit_pu(p, u, 0.5)
    z = ((u - mean) / scale) @ w + b
    assert (z[:150] > 0).mean() > 0.9 and (z[150:] < 0).mean() > 0.9
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    out = quality.score(odd_docs, model, column="my_score").toPandas()
    assert len(out) == odd_docs.count() and out.my_score.between(0, 1).all() and list(out.columns[:-1]) == odd_docs.columns
    assert quality.score(no_docs, quality.fit(no_docs, labels)).count() == 0
    assert quality.estimate_prior(np.zeros(0), np.zeros(0)) == 0.5


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled_rows_alone(prior):
    rng = np.random.default_rng(3)
    draw = lambda n, share: np.concatenate([rng.normal(1.5, 1, (round(n * share), 4)), rng.normal(-1.5, 1, (n - round(n * share), 4))]).astype(np.float32)
    positive, unlabelled = draw(1500, 1), rng.permutation(draw(4000, prior))
    assert abs(quality.estimate_prior(*quality.held_out_scores(positive, unlabelled)) - prior) < 0.07


def test_gradient_of_the_risk():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.6):
        zp, zu = rng.normal(0, 2, 7), rng.normal(0, 2, 9)
        risk, gp, gu = quality.pu_gradient(zp, zu, prior)
        unbiased = lambda a, b: prior * np.log1p(np.exp(-a)).mean() + max(0.0, np.log1p(np.exp(b)).mean() - prior * np.log1p(np.exp(a)).mean())  # noqa: E731, B023
        assert risk == pytest.approx(unbiased(zp, zu))
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            assert gp[i] == pytest.approx((unbiased(zp + step, zu) - unbiased(zp - step, zu)) / 2e-6, abs=1e-5)
        for i in range(9):
            step = np.eye(9)[i] * 1e-6
            assert gu[i] == pytest.approx((unbiased(zp, zu + step) - unbiased(zp, zu - step)) / 2e-6, abs=1e-5)
    # A negative risk below zero turns the step round.
    _, gp, gu = quality.pu_gradient(np.full(3, 5.0), np.full(3, -5.0), 0.9)
    assert (gp > 0).all() and (gu < 0).all()


def test_many_languages_and_excluded_ones(spark):
    rows = [(i, f"word{i:03d}x " * 12, f"l{i:03d}") for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 200
    # A word in a script that only one language has is that language's, whatever the price of a change.
    rows = [(1, "the same words again " * 30, "en"), (2, "слова и слова " * 30, "ru")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), switch=1000.0)
    (out,) = langid.identify(spark.createDataFrame([(1, "the same words слова again and again")], "doc_id long, text string"), model).collect()
    assert [s.lang for s in out.spans] == ["en", "ru", "en"] and out.lang_pred == "en"


def test_language_of_held_out_rows(spark, sf):
    out = langid.op1_language_spans(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().merge(out, on="doc_id")
    held = truth[truth.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def brute_path(scores, switch):
    n, k = scores.shape
    v, back = scores[0].copy(), []
    for t in range(1, n):
        step = v[None, :] - switch * (1 - np.eye(k))
        back.append(step.argmax(1))
        v = scores[t] + step.max(1)
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    total = lambda p: sum(scores[t, c] for t, c in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))
    return path[::-1], total


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(50, 3)).astype(np.float32)
    lengths = np.array([0, 7, 1, 30, 0, 12])
    ids = rng.integers(0, 50, lengths.sum())
    got = np.split(langid.viterbi(scores, ids, lengths, 1.5), np.cumsum(lengths)[:-1])
    for path, rows in zip(got, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        if len(rows):
            want, total = brute_path(scores[rows].astype(float), 1.5)
            assert total(path) == pytest.approx(total(want), abs=1e-4)


def test_language_spans_and_odd_input(spark, odd_docs, no_docs):
    rows = [(i, "the cat and the dog sat on the mat with the hat", "en") for i in range(9)] + [(i, "кот и собака сидели на ковре и пели", "ru") for i in range(9, 18)] + [(99, "x", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    mixed = spark.createDataFrame([(1, "the cat sat on the mat кот и собака сидели на ковре")], "doc_id long, text string")
    spans = langid.identify(mixed, model).first().spans
    assert [(s.first, s.last, s.lang) for s in spans] == [(0, 6, "en"), (6, 12, "ru")]
    out = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[5].lang_pred == out[6].lang_pred == "und"
    assert out[4].lang_pred == "en" and out[4].n_words == 60_000
    assert langid.identify(no_docs, langid.fit(no_docs)).count() == 0
    assert langid.identify(mixed, langid.fit(no_docs)).first().lang_pred == "und"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute_hits(items, doc):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    d = words(doc)
    hit, found = [False] * len(d), set()
    for n in {len(x) for x in windows}:
        for k in range(len(d) - n + 1):
            if tuple(d[k : k + n]) in windows:
                found |= windows[tuple(d[k : k + n])]
                hit[k : k + n] = [True] * n
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 2, 5, 9, 10, 14, 30])))) for i in range(r.randint(0, 5))]
    if seed % 3:
        items = [x for x in items if len(x[1].split()) >= 9]
    doc = " - ".join(r.choice(["a", "B", "c", "x"][: 3 + seed % 2]) for _ in range(r.randint(0, 60))) + " " + " ".join(t for _, t in r.sample(items, min(1, len(items))))
    hit, found = decontaminate.Automaton(items).hits(decontaminate.folded(doc).split())
    assert (hit.tolist(), found) == brute_hits(items, doc)


def test_decontamination_in_blocks_and_cutting(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven"), (2, "tiny item"), (3, None), (None, "no id here at all"), (2, "tiny item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Start. one two, three four five six seven eight nine ten END"), (2, "a tiny, ITEM here and more words of its own"), (3, "clean words only"), (4, "no id here at all and then much more text follows it"), (5, "tiny item"), (6, None)], "doc_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 20):
        got = {r.doc_id: (r._words, r._hit, r._items) for r in decontaminate.find(docs, bench, block_bytes=block).collect()}
        assert got == {1: (12, [1, 11], ["1"]), 2: (10, [1, 3], ["2"]), 3: (3, [], []), 4: (12, [0, 5], []), 5: (2, [0, 2], ["2"]), 6: (0, [], [])}
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {2: "a  here and more words of its own", 3: "clean words only", 4: " and then much more text follows it", 6: None}
    assert decontaminate.find(odd_docs, bench, columns=("n", "runs", "ids")).count() == odd_docs.count()
    with pytest.raises(ValueError, match="_hit"):
        decontaminate.find(odd_docs, bench)
    assert decontaminate.decontaminate(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.find(no_docs, bench).count() == 0
    empty = bench.limit(0)
    assert [r._hit for r in decontaminate.find(docs, empty).collect()] == [[]] * 6


def test_cutting_never_leaves_a_window(spark):
    item = "a b c d e f g h i j"
    doc = "pre one two three four five six seven eight nine a b c d a b c d e f g h i j e f g h i j post"
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = decontaminate.decontaminate(docs, bench, max_coverage=1.0).first().text
    assert not any(brute_hits([("1", item)], text)[0]) and text.split()[0] == "pre" and text.split()[-1] == "post"


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_encoder_equals_encoding_whole():
    texts = ["", "  ", None, "a\tb\x0bc d", "<|endoftext|> x<|startoftext|>y z", "don't DON'T we'll 12 345 \U0001f600é ́x", "İstanbul ΣΑΣ. Ä x.,! ﬁn ǅ", "a\x1cb\x85c d\r\ne, f. Gh! ij?", "你好 हिन्दी ไทย", "Word. word, WORD; word: wo.rd .word ."]
    flat, n = packing.WordEncoder(packing.vocabulary_path()).encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == whole(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_packing_is_valid_and_tight(sizes):
    bins, offsets = packing.best_two_fit(np.array(sizes), 40)
    loads = []
    for b in range(bins.max() + 1):
        at = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in at] == np.concatenate([[0], np.cumsum([s for _, s in at])[:-1]]).tolist()
        loads.append(sum(s for _, s in at))
    assert max(loads) <= 40
    assert sorted(loads)[:2] == sorted(loads)[:1] or sum(sorted(loads)[:2]) > 40
    best_fit = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, x in enumerate(best_fit) if x + s <= 40]
        if fits:
            best_fit[max(fits, key=lambda i: best_fit[i])] += s
        else:
            best_fit.append(s)
    assert len(loads) <= len(best_fit) + 2


def test_two_replace_the_smallest():
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_pack_round_trip_and_odd_input(spark, odd_docs, no_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    placed = common.written(packing.pack(docs), "placed")
    ids = {r.sequence_id: list(r.ids) for r in packing.sequences(docs, placed).collect()}
    back = {}
    for r in sorted(placed.collect(), key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and len(back.get(r.doc_id, [])) == r.start
        back.setdefault(r.doc_id, []).extend(part)
    rows = docs.collect()
    assert back == dict(zip([r.doc_id for r in rows], whole([r.text for r in rows]), strict=True))
    assert max(map(len, ids.values())) <= 2048 and len(ids) <= -(-sum(map(len, back.values())) // 2048) + 1
    odd = packing.pack(odd_docs).collect()
    assert len({(r.sequence_id, r.offset) for r in odd}) == len(odd) >= odd_docs.count()
    assert packing.pack(no_docs).count() == 0


def brute_flow(supply, capacity, cost):
    """Cheapest shipment by trying all of a few units."""
    from functools import lru_cache

    units = [i for i, s in enumerate(supply) for _ in range(s)]

    @lru_cache(None)
    def go(k, left):
        if k == len(units):
            return 0
        return min(cost[units[k]][j] + go(k + 1, left[:j] + (left[j] - 1,) + left[j + 1 :]) for j in range(len(left)) if left[j])

    return go(0, tuple(capacity))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_flow_is_cheapest(seed):
    r = random.Random(seed)
    supply = [r.randint(0, 3) for _ in range(3)]
    capacity = [r.randint(1, 3) for _ in range(3)] + [9]
    cost = [[r.randint(0, 4) for _ in capacity] for _ in supply]
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert sum(f * cost[i][j] for (i, j), f in flow.items()) == brute_flow(supply, capacity, cost)
    assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(3)] == supply


def test_resharding(spark, odd_docs, no_docs, sf, tmp_path):
    out = sharding.op8_flow_reshard(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(s == 8 + len(texts[i].encode()) and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() - loads.min() <= out["size"].max()
    # Equal texts stay together, but for texts of over a shard.
    groups = out.assign(t=out.doc_id.map(texts)).groupby("t").agg(total=("size", "sum"), shards=("shard", "nunique"))
    assert groups[groups.total <= loads.mean()].shards.max() == 1
    moved = out[out.shard != out.old_shard]["size"].sum()
    old = out.groupby("old_shard")["size"].sum()
    assert moved <= (old - loads.mean()).clip(lower=0).sum() + 24 * out["size"].max()
    old_shard = F.pmod(F.xxhash64("text"), F.lit(3))
    assert sharding.reshard(odd_docs, old_shard, 3, 4).count() == odd_docs.count()
    assert sharding.reshard(no_docs, old_shard, 3, 4).count() == 0
    # Rows without an id, and equal rows, are rewritten as they are.
    p = sharding.plan(odd_docs.where("length(text) < 1000 or text is null"), F.lit(0), 1, 4)
    changed = sharding.rewrite(p, str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new")).select(*odd_docs.columns, F.col(p.shard).alias("shard"))
    key = lambda r: str(tuple(r))
    want = p.frame.where(F.col(p.shard).isin(changed)).select(*odd_docs.columns, F.col(p.shard).alias("shard"))
    assert changed and sorted(map(key, new.collect())) == sorted(map(key, want.collect()))


def test_moved_bytes_are_the_least():
    r = random.Random(8)
    for _ in range(30):
        n_old, n_new, size = r.randint(1, 3), r.randint(2, 3), r.randint(1, 9)
        blocks = [((i,), r.randrange(n_old), size) for i in range(n_new * r.randint(1, 2))]
        target = size * len(blocks) // n_new
        got = sharding.assign(blocks, n_old, [target] * n_new)
        cost = lambda to: sum(s for (k, old, s), j in zip(blocks, to, strict=True) if j != old)
        every = [to for to in itertools.product(range(n_new), repeat=len(blocks)) if all(to.count(j) * size <= target for j in range(n_new))]
        assert cost([got[k] for k, _, _ in blocks]) == min(map(cost, every))
    for _ in range(50):
        n_old, n_new = r.randint(1, 6), r.randint(1, 8)
        blocks = [((i,), r.randrange(n_old), r.randint(1, 100)) for i in range(r.randint(1, 60))]
        total = sum(b[2] for b in blocks)
        targets = [total // n_new + 1] * n_new
        got = sharding.assign(blocks, n_old, targets)
        supply = [sum(b[2] for b in blocks if b[1] == i) for i in range(n_old)]
        load = [sum(b[2] for b in blocks if got[b[0]] == j) for j in range(n_new)]
        least = sum(max(0, s - targets[i]) if i < n_new else s for i, s in enumerate(supply))
        assert sum(b[2] for b in blocks if got[b[0]] != b[1]) <= least
        assert max(x - t for x, t in zip(load, targets, strict=True)) < max(b[2] for b in blocks)


def test_hot_group_is_split_when_it_exceeds_a_shard(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    out = sharding.reshard(docs, F.pmod(F.xxhash64("text"), F.lit(4)), 4, 8).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() / loads.mean() < 1.02
