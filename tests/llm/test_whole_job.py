"""Cases that earlier versions of the operators left out, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillet.llm import decontaminate, langid, lines, passages, shingles


def prose(seed, size=4000):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(size)]
    return r, lambda n: [r.choice(vocabulary) for _ in range(n)]


def test_near_duplicate_stage_finds_edited_copies(spark):
    import corpus_pipeline as c

    r, words = prose(21)
    rows = []
    for _ in range(12):
        base = words(r.randint(80, 300))
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(2, len(w) // 40))):
                w[r.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w)))
    common = words(60)
    rows += [(len(rows) + i, " ".join(common + words(r.randint(5, 40)))) for i in range(30)]
    rows += [(1000, "a b c"), (1001, "A  b c"), (1002, ""), (1003, None), (None, rows[0][1])]
    sets = [(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}) for d, t in rows if d is not None for w in [(t or "").lower().split()]]
    least = {d: d for d, _ in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in shingles.classes(docs).collect()} == {d: find(d) for d in least}
    kept = [x.doc_id for x in c.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({find(d) for d in least}) and kept.count(None) == 1
    assert len(kept) < 0.6 * len(rows)


def test_classes_of_dense_and_short_texts_are_exact(spark):
    r, words = prose(25, 300)
    texts = []
    for size in (6, 9, 14, 40, 60):
        base = words(size)
        for _ in range(60):  # Copies of one text are about as near to each other as the bound.
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 20))):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = words(r.randint(0, 2))
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.component_id for x in shingles.classes(docs).orderBy("doc_id").collect()] == root
    assert 20 < len(set(root)) < len(texts) - 50


def test_two_shared_passages_with_other_words_between(spark):
    _, words = prose(22)
    rows, want = [], {}
    for gap in (40, 60, 100, 150):
        head, foot = words(60), words(60)
        for _ in range(2):
            before = words(10 + len(rows))
            want[len(rows)] = [(len(before), len(before) + 60), (len(before) + 60 + gap, len(before) + 120 + gap)]
            rows.append((len(rows), " ".join(before + head + words(gap) + foot + words(20))))
    got = {x.doc_id: [(p.first, p.last) for p in x.passages] for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    for d, spans in want.items():
        assert len(got[d]) == 2 and all(abs(a - c) <= 2 and abs(b - e) <= 2 for (a, b), (c, e) in zip(got[d], spans, strict=True)), (d, got[d], spans)


@pytest.mark.parametrize("few", [8, 1])
def test_passage_whose_seeds_lie_first_in_parts_of_it(spark, monkeypatch, few):
    monkeypatch.setitem(passages.alignments.__kwdefaults__, "few_places", few)
    _, words = prose(23, 20_000)
    rows, pairs = [], {}
    for _ in range(30):
        p = words(80)
        rows += [(len(rows) + i, " ".join(words(30) + part + words(30))) for i, part in enumerate((p[:45], p[35:]))]
        pairs |= {len(rows): len(rows) + 1, len(rows) + 1: len(rows)}
        rows += [(len(rows) + i, " ".join(words(25) + p + words(25))) for i in range(2)]
    got = {x.doc_id: x.match_ids for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.transform("passages", lambda p: p["match_id"]).alias("match_ids")).collect()}
    assert all(m in got[d] for d, m in pairs.items())


def test_recall_of_edited_passages(spark):
    r, words = prose(24, 20_000)
    rows, kinds = [], {}
    for k in range(40):
        for name, at in (("every 6th", range(k % 6, 60, 6)), ("every 8th", range(k % 8, 60, 8)), ("0.95", r.sample(range(60), 3)), ("0.9", r.sample(range(60), 6)), ("0.85", r.sample(range(60), 9))):
            p = words(60)
            q = [f"edit{r.randrange(10**6)}" if i in set(at) else w for i, w in enumerate(p)]
            for text in (p, q):
                kinds[len(rows)] = (name, k)
                rows.append((len(rows), " ".join(words(25) + text + words(25))))
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(kinds[p.match_id] == kinds[x.doc_id] for x in out for p in x.passages)
    share = {name: sum(bool(x.passages) for x in out if kinds[x.doc_id][0] == name) / 80 for name in ("every 6th", "every 8th", "0.95", "0.9", "0.85")}
    assert share["every 6th"] >= 0.8 and share["every 8th"] == 1 and share["0.95"] == 1 and share["0.9"] >= 0.95 and share["0.85"] >= 0.85, share


def test_line_stage_takes_short_and_unspaced_repeats(spark):
    import corpus_pipeline as c

    rows = [(1, "all rights reserved.\nyes\n\n一行没有空格的文字"), (2, "All  rights reserved.\nall rights kept\n\nyes"), (3, "一行没有空格的文字\n一行没有空格的文章\nyes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in c.line_stage(spark, docs, "").collect()} == {1: rows[0][1], 2: "all rights kept\n", 3: "一行没有空格的文章"}
    assert {x.doc_id: x.text for x in lines.dedup_lines(docs).collect()} == dict(rows)


def test_decontamination_goes_on_until_nothing_is_cut(spark):
    depth = 7
    text = [f"w{i}" for i in range(10)]
    for _ in range(depth):  # Each cut of the inner window brings the outer one together.
        text = [f"w{i}" for i in range(5)] + text + [f"w{i}" for i in range(5, 10)]
    docs = spark.createDataFrame([(1, " ".join(text + [f"own{i}" for i in range(200)]))], "doc_id long, text string")
    bench = spark.createDataFrame([("b", " ".join(f"w{i}" for i in range(10)))], "item_id string, text string")
    (row,) = decontaminate.decontaminate(docs, bench).collect()
    assert row.text.split() == [f"own{i}" for i in range(200)]


def test_labels_beyond_127():
    scores = np.full((200, 200), -9.0, dtype=np.float32)
    np.fill_diagonal(scores, 0.0)
    ids = np.repeat(np.arange(200), 3)
    assert langid.viterbi(scores, ids, np.array([300, 300]), 1.0).tolist() == ids.tolist()


def test_passages_meet_past_the_hubs_of_frequent_seeds(spark):
    """Every seed of a pair is frequent and each of its hubs is a text that holds only 30 words of the passage."""
    r, words = prose(31, 20_000)
    rows, pairs = [], {}
    for _ in range(6):
        p = words(66)
        # Parts come first by key or not; ten of each make every seed frequent.
        for i in range(10):
            for part in (p[:30], p[18:48], p[36:]):
                rows.append((len(rows), " ".join(words(40) + part + words(40))))
        pairs |= {len(rows): len(rows) + 1, len(rows) + 1: len(rows)}
        q = [w if i % 16 != 12 else f"edit{r.randrange(10**6)}" for i, w in enumerate(p)]
        rows += [(len(rows) + i, " ".join(words(25) + text + words(25))) for i, text in enumerate((p, q))]
    got = {x.doc_id: x.match_ids for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.transform("passages", lambda p: p["match_id"]).alias("match_ids")).collect()}
    assert all(m in got[d] for d, m in pairs.items())
    assert {d for d, m in got.items() if m} == set(pairs)


def test_pairs_that_grow_are_those_of_all_pairs():
    r = random.Random(32)
    group = np.sort(np.array([r.randrange(3) for _ in range(90)]))
    root = np.array([r.randrange(12) for _ in range(90)])
    base = [[r.randrange(1, 9) for _ in range(24)] for _ in range(4)]
    words = np.array([[w if r.random() < 0.85 else r.randrange(9) for w in base[r.randrange(4)]] for _ in range(90)], dtype="<u2")
    got = {(min(a, b), max(a, b)) for x, y in passages.grown_pairs(group, root, words, 20) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = set()
    for i in range(90):
        for j in range(i + 1, 90):
            if group[i] == group[j] and root[i] != root[j]:
                a, b = words[i].tolist(), words[j].tolist()
                k = next((k for k in range(24) if a[k] != b[k]), 24)
                two = lambda w: {(w[k + p], w[k + p + 1]) for p in range(5) if k + p + 1 < 24 and w[k + p] and w[k + p + 1]}  # noqa: B023, E731
                if k >= 20 or two(a) & two(b):
                    want.add((i, j))
    assert got == want and len(want) > 100


def test_words_laid_end_to_end_and_chains_grown_at_once_are_those_of_one_at_a_time():
    texts = ["", "a B  c\n", None, " \x00 é ÀB\x1f x ", "tail", "head　x\x0b\x0cy", " ", "x" * 600_000 + " y", "y " * 200_000]
    for column in (pa.array(texts), pa.array(texts).slice(1, 5), pa.array(texts[:1])):
        laid = passages.Laid(column, passages.Grams())
        words = [w for t in column.to_pylist() for w in passages.words_of(t)]
        assert laid.sizes.tolist() == [len(passages.words_of(t)) for t in column.to_pylist()]
        assert [laid.data[i:j].tobytes() for i, j in zip(laid.first, laid.last, strict=True)] == words
        assert len(set(zip(words, laid.hash.tolist(), strict=True))) == len(set(words)) == len(set(laid.hash.tolist()))
    rng = np.random.default_rng(33)
    for _ in range(40):
        a = rng.integers(0, 8, 150).astype(np.uint64)
        b = np.delete(np.where(rng.random(150) < 0.2, np.uint64(9), a), rng.integers(0, 150, 3))
        p = rng.integers(0, len(b), 30)
        box = (np.maximum(p - 60, 0), np.minimum(p + 60, len(a)), np.maximum(p - 50, 0), np.minimum(p + 64, len(b)))
        for step in (1, -1):
            got = passages.grown(a, b, p, p, step, box)
            want = [passages._grow(a.tolist(), b.tolist(), int(p[i]), int(p[i]), step, tuple(int(x[i]) for x in box)) for i in range(30)]
            assert np.stack(got, axis=1).tolist() == [list(w) for w in want]
