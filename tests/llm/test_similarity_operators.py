"""Near duplicates, neighbours, lines, substrings, passages and the pipeline against brute force, and on odd input."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillet.llm import ann, common, lines, passages, simhash, substrings


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 600)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = union(600, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: root[x] for x in touched}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_definition():
    for text in ("", "One", "one two", "A b  c\td", "x y z " * 30, "a b c d e"):
        w = text.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        assert simhash.fingerprint(text) == sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))
    assert simhash.fingerprint(None) == 0


def test_golay_code_covers_within_three():
    a = simhash.Anchors()
    for k in (3, 4, 5):
        weights = np.bitwise_count(a.mask)
        assert ((weights == k) & (a.excess < 99)).sum() == {3: 1771, 4: 8855, 5: 33649}[k]
    assert ((a.excess == 0).sum(1) == 1).all()


@pytest.mark.parametrize(("pairs", "held"), [(4096, 2_000_000), (0, 2_000_000), (4096, 40)])
def test_links_equal_brute_force(spark, monkeypatch, pairs, held):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "HELD", held)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for x in base.tolist():
        fps.add(x)
        for _ in range(12):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    want = union(len(fps), near.tolist())
    signed = fps.view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    index = {x: i for i, x in enumerate(signed)}
    assert all(np.bitwise_count(np.uint64(e.a % (1 << 64)) ^ np.uint64(e.b % (1 << 64))) <= 2 for e in edges)
    assert union(len(fps), [(index[e.a], index[e.b]) for e in edges]) == want


def test_near_duplicates_on_odd_input(spark, odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert {r.component_id for r in out if r.fp == 0} == {2}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 in ids and 3 not in ids and ids.count(None) == 2
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [float("inf")] + [1.0] * 15), (1080, [None] + [1.0] * 15), (1100, []), (1120, [1.0, 2.0]), (1140, [3.0, 4.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(df, F.col("vec_id") % 20 == 0, query_block=7, candidate_block=40, stripes=3)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = sum(y[:, j] * y[q, j] for j in range(16))
        want = sorted((-s[i], i) for i in range(300) if i != q)[:20]
        assert got.pop(q) == [(i, -v) for v, i in want]
    assert got == {1120: [(1140, 11.0)], 1140: [(1120, 11.0)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert [tuple(r) for r in ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.lit(True)).collect()] == [(0, 1, 1, 2.0), (1, 1, 0, 2.0)]


def brute_lines(rows, least=5):
    at = sorted((d, n, tuple(w)) for d, t in rows if d is not None and t is not None for n, l in enumerate(t.split("\n")) if len(w := l.lower().replace("\t", " ").split()) >= least)
    first = {}
    for d, n, w in at:
        first.setdefault(w, (d, n))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return p + s >= max(len(a), len(b)) - 1

    gone = {w for w in first if any(first[v] < first[w] and near(v, w) for v in first if v != w)}
    out = {}
    for d, n, w in at:
        if w in gone or first[w] != (d, n):
            out.setdefault(d, []).append(n)
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(" ".join(r.choice(["a", "b", "B\t"]) for _ in range(r.randint(3, 9))) for _ in range(r.randint(0, 4)))) for i in range(80)]
    rows += [(100 + i, f"page number {i} of the long report") for i in range(50)] + [(1000, None), (None, "a b a b a b"), (1001, "")]
    got = {x.doc_id: x.removed for x in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_removal_and_odd_input(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(2, "this line stands here too\nown words of the second text"), (1, "this line stands here too\n\nshort one"), (3, "This line stands HERE also too")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {1: "this line stands here too\n\nshort one", 2: "own words of the second text", 3: ""}
    out = lines.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert lines.dedup_lines(no_docs).count() == 0


def brute_bytes(rows, length=400):
    seen = {}
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    cover = [bytearray(len((t or "").encode())) for _, t in rows]
    for v in seen.values():
        if len(v) > 1:
            for i, p in v:
                cover[i][p : p + length] = b"\1" * length
    out = {}
    for (d, t), c in zip(rows, cover, strict=True):
        spans = sum(1 for i, x in enumerate(c) if x and (not i or not c[i - 1]))
        out[d] = (len(c), sum(c), spans, hashlib.sha256(bytes(y for y, x in zip((t or "").encode(), c, strict=True) if not x)).hexdigest())
    return out


@pytest.fixture(scope="module")
def passage_rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [text(120) for _ in range(4)]
    rows = []
    for i in range(200):
        k = r.random()
        if k < 0.5:
            t = f"{text(r.randint(0, 80))} {r.choice(shared)[r.randint(0, 60) : r.randint(380, 700)]} {text(r.randint(0, 80))}"
        elif k < 0.7:
            w = r.choice(shared).split()
            w[r.randrange(len(w))] = "XX"
            t = " ".join(w)
        elif k < 0.8 and rows:
            t = r.choice(rows)[1]
        elif k < 0.85:
            t = "ab " * r.randint(1, 400)
        else:
            t = text(r.randint(0, 200))
        rows.append((i, t))
    return rows + [(1000, None), (1001, ""), (1002, "x" * 399), (1003, "x" * 399), (1004, "y" * 400), (1005, "y" * 400), (1006, "z" * 401)]


@pytest.mark.parametrize("hot", [128, 3])
def test_substrings_equal_brute_force(spark, passage_rows, hot):
    df = spark.createDataFrame(passage_rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated(df, hot=hot).collect()}
    assert got == brute_bytes(passage_rows)


def test_suffix_sort():
    r = random.Random(6)
    data = bytes(r.choice(b"ab") for _ in range(400))
    group = np.sort(np.array([r.randrange(6) for _ in range(60)]))
    start = np.array([r.randrange(380) for _ in range(60)])
    size = np.array([r.randint(0, 20) for _ in range(60)])
    order, shared = substrings.Suffixes(np.frombuffer(data, np.uint8)).sort(start, size, group)
    piece = lambda i: data[start[i] : start[i] + size[i]]
    assert [(group[i], piece(i)) for i in order] == sorted((group[i], piece(i)) for i in range(60))
    for k in range(1, 60):
        a, b = piece(order[k - 1]), piece(order[k])
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_substrings_on_odd_input(spark, odd_docs, no_docs):
    out = substrings.repeated(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert substrings.repeated(no_docs).count() == 0


def brute_chain(x, y, weight, gap):
    best = []
    for i in range(len(x)):
        before = [best[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
        best.append(weight + max([0.0, *before]))
    return max(best)


def test_chaining_is_best():
    r = random.Random(7)
    for _ in range(60):
        points = sorted({(r.randrange(40), r.randrange(40)) for _ in range(r.randint(1, 40))}, key=lambda p: (p[0], -p[1]))
        x, y = [p[0] for p in points], [p[1] for p in points]
        parts = passages.chain(x, y)
        best = parts[0]
        score = passages.K * len(best) - passages.GAP * (x[best[-1]] - x[best[0]] + y[best[-1]] - y[best[0]])
        assert score == pytest.approx(brute_chain(x, y, passages.K, passages.GAP))
        assert sorted(i for p in parts for i in p) == list(range(len(x)))


def test_edits():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(8)
    for _ in range(100):
        a, b = ([r.choice([b"x", b"y", b"z"]) for _ in range(r.randint(0, 9))] for _ in range(2))
        assert passages.edits(a, b) == brute(a, b)


def test_passages_are_found_and_clean_texts_left(spark, odd_docs, no_docs):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [words(70) for _ in range(5)]
    rows, holds = [], {}
    for i in range(150):
        if i % 3:
            rows.append((i, " ".join(words(r.randint(0, 150)))))
            continue
        k = r.randrange(5)
        p = list(shared[k])
        for _ in range(r.randint(0, 2)):
            p[r.randrange(70)] = f"zz{r.randrange(99)}"
        if r.random() < 0.3:
            del p[r.randrange(60)]
        holds[i] = k
        rows.append((i, " ".join(words(r.randint(0, 60)) + p + words(r.randint(0, 60)))))
    rows += [(1003, "w" + rows[1][1] * 3), (1004, "w" + rows[1][1] * 3)]
    out = {x.doc_id: x for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(150) if out[i].passages and i != 1} == set(holds)
    assert all(holds[p.match_id] == holds[i] and p.identity >= 0.8 and p.last - p.first >= 50 for i in holds for p in out[i].passages)
    assert out[1004].class_id == 1003 and out[1004].passages[0].match_id == 1003
    assert passages.repeated_passages(odd_docs).count() == odd_docs.count()
    assert passages.repeated_passages(no_docs).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    assert [s[0] for s in c.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in c.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0] and sizes[1] < sizes[0] and sizes[1] == sizes[2]
    fps = [simhash.fingerprint(r.text) for r in docs.collect()]
    assert len(fps) == sizes[-1]
    placed = c.STAGES[-1][1](spark, docs, sf)
    assert placed.select("doc_id").distinct().count() == sizes[-1]
    assert docs.where("n_chars <> length(text)").count() == 0


def test_pipeline_on_odd_input(spark, odd_docs, sf):
    import corpus_pipeline as c

    docs = odd_docs
    for name, stage in c.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == odd_docs.columns
    assert c.STAGES[-1][1](spark, docs, sf).count() >= 1
    for _, stage in c.STAGES:
        assert stage(spark, odd_docs.limit(0), sf).count() == 0
