"""Nearest neighbours, hard negatives and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import hard_negatives, nearest, spelling, vectors

ROWS = "vec_id long, embedding array<float>, label int, cell string, vector int, `a.b` int, rows string"


def vector_rows(seed=1, n=400, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    rows = []
    for i in range(n):
        c = i % 6
        v = (centres[c] + 0.4 * rng.standard_normal(width)).astype(np.float32)
        rows.append([i, v.tolist(), c])
    copy = rows[7][1]
    rows += [[n + i, copy, i % 3] for i in range(200)]  # a third of the rows is one vector
    rows += [[900, None, 1], [901, [0.0] * width, 1], [902, [float("nan")] + [1.0] * (width - 1), 1], [903, [float("inf")] + [1.0] * (width - 1), 1], [904, [None] + [1.0] * (width - 1), 1]]
    rows += [[None, copy, 1], [905, copy, None], [906, [1.0, -2.0], 2], [950, [1.0, -2.0], 1], [9000, [], 1], [50, rows[50][1], rows[50][2]]]
    return [(*r, "clash", 1, 2, "clash") for r in rows]


def padded(v, width=12):
    return np.array([*v, *[0.0] * (width - len(v))], float)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ROWS", 40), ("GROUP_ROWS", 5), ("CELL_ROWS", 50), ("SAMPLE_ROWS", 300)):
        monkeypatch.setattr(vectors, name, value)


def brute_nearest(rows, k):
    own = [(r[0], padded(r[1])) for r in rows if r[0] is not None and usable(r[1]) and any(r[1])]
    ids, v = np.array([x[0] for x in own]), np.stack([x[1] for x in own])
    out = {}
    for i, q in own:
        if i % 10 == 0:
            d = np.sqrt(((v - q) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("confidence", [1.0, nearest.CONFIDENCE])
def test_nearest(spark, small_blocks, confidence):
    rows = vector_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = nearest.nearest(df, df.where("vec_id % 10 = 0"), k=10, confidence=confidence)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, 10)
    assert set(found) == set(want)
    if confidence == 1:
        assert found == want
    hits = sum(len({x for x, _ in found[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(list(v) == sorted(v, key=lambda x: (x[1], x[0])) for v in found.values())


def test_nearest_few_rows(spark):
    df = spark.createDataFrame(vector_rows()[:4], ROWS)
    assert nearest.nearest(df, df.where("vec_id = 0")).count() == 3
    assert nearest.nearest(df.where("false"), df).count() == 0
    assert nearest.nearest(df, df.where("false")).count() == 0
    elsewhere = spark.createDataFrame([(77, [1.0] * 12)], "vec_id long, embedding array<double>")
    assert nearest.nearest(df, elsewhere).count() == 4


def test_chi_square():
    # fixed values: published quantiles of 8 degrees of freedom
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(nearest.chi_square_quantile(0.99, 8) - 20.090) < 1e-3


def test_stopping_test_prunes():
    """On rows in clusters far apart a block's search verifies few of them."""
    rng = np.random.default_rng(5)
    points = (rng.standard_normal((40, 8)) * 50)[np.arange(4000) % 40] + rng.standard_normal((4000, 8))
    tree = nearest.KdTree(points, 16)
    leaf = tree.leaf(points)
    assert np.bincount(leaf).max() <= 16 and set(leaf) <= {i for i, a in enumerate(tree.axis) if a < 0}
    near = [b for b in np.unique(leaf) if nearest.outside(points[:1], points[leaf == b].min(0)[None], points[leaf == b].max(0)[None])[0, 0] <= 15.5 * 1.5**2]
    assert len(near) < 0.1 * tree.leaves
    same = nearest.KdTree(np.ones((500, 8)), 16)
    assert same.leaves == 1


def brute_negatives(rows, anchors, positives, negatives):
    own = [(r[0], r[2], np.floor(256 * padded(r[1]))) for r in rows if r[0] is not None and r[2] is not None and usable(r[1])]
    asks = {}
    for r in own:
        if r[0] % anchors == 0:
            asks[r[0]] = min(asks.get(r[0], r), r, key=lambda x: (x[1], x[2].tolist()))
    out = []
    for a, label, v in asks.values():
        scored = sorted(((-int(v @ w), i, own_label) for i, own_label, w in own if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives(spark, small_blocks):
    rows = vector_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 5, 3)
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id < 3"), F.lit(True)).count() == 0


def test_bounds_skip_lists():
    """Lists far from the window are not visited, and no list that could hold a hit is left out."""
    rng = np.random.default_rng(4)
    v = np.floor(256 * (np.repeat(np.eye(8), 50, 0) + 0.05 * rng.standard_normal((400, 8))))
    centres = hard_negatives.k_means(v, 8)
    own = hard_negatives.squared(v, centres).argmin(1)
    cells = np.unique(own)
    radii = np.array([np.sqrt(((v[own == c] - centres[c]) ** 2).sum(1)).max() for c in cells])
    import pyarrow as pa

    windows = pa.array([[{"score": 60_000, "kth": None}]] * 400, pa.list_(pa.struct([("score", pa.int64()), ("kth", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), pa.array(v.astype(int).tolist()), windows], names=["anchor_id", "vector", "windows"])
    (asked,) = hard_negatives.visits(cells.astype(np.int32), centres[cells], radii, 50, 95)([batch])
    met = set(zip(asked.column("anchor_id").to_pylist(), asked.column("cell").to_pylist()))
    s = v @ v.T
    wanted = {(i, int(own[j])) for i, j in zip(*np.nonzero((s >= 30_000) & (s <= 57_000)))}
    assert wanted <= met and len(met) < 400 * len(cells) / 3


def test_visits_come_out_in_bounded_batches(monkeypatch):
    """A batch of anchors that each visit every list goes out in pieces, all of them together the same rows."""
    import pyarrow as pa

    monkeypatch.setattr(hard_negatives, "BATCH_BYTES", 1 << 14)
    n, lists = 200, 50
    windows = pa.array([[{"score": None, "kth": None}]] * n, pa.list_(pa.struct([("score", pa.int64()), ("kth", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.ones((n, 8), int).tolist()), windows], names=["anchor_id", "vector", "windows"])
    out = list(hard_negatives.visits(np.arange(lists, dtype=np.int32), np.ones((lists, 8)), np.ones(lists), 50, 95)([batch]))
    assert len(out) > 10 and max(b.num_rows for b in out) <= (1 << 14) * n // batch.nbytes
    assert sorted((a, c) for b in out for a, c in zip(b.column("anchor_id").to_pylist(), b.column("cell").to_pylist())) == [(a, c) for a in range(n) for c in range(lists)]


def test_large_components():
    big = np.array([[2**40, 3], [-(2**62), 1]], np.int64)
    assert hard_negatives.scores(big, big).tolist() == [[hard_negatives.MOST, hard_negatives.LEAST], [hard_negatives.LEAST, hard_negatives.MOST]]
    assert hard_negatives.scores(big[:1], np.array([[2**20, 5]])).tolist() == [[2**60 + 15]]
    assert hard_negatives.window(7, 50, 95) == (4, 6) and hard_negatives.window(-7, 50, 95) == (-3, -7)


def typing(seed=2):
    rng = random.Random(seed)
    letters = "abcdeéÖß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaab", "banana", "bananas", "bannana", "ananas"]
    texts = []
    for i in range(80):
        some = []
        for _ in range(150):
            w = rng.choice(words[: rng.randrange(1, len(words))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w.upper(), w.title()])
            some.append(w)
        texts.append(" ".join(some) if i % 2 else "\n1,".join(some))
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "12 34 ×÷× Ā short"), (None, texts[0]), (3, texts[3]), (93, "abcdeé" * 3 + " " + "long words " * 200_000)]
    return [(*r, "x", "x", 1) for r in rows]


def brute_spelling(rows, every):
    counts = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w]), root(w)) for w in n)


@pytest.mark.parametrize("part", [spelling.PART_WORDS, 2])
def test_spelling(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    rows = typing()
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string, `a.b` int").repartition(4)
    got = spelling.spelling_variants(df, every=3)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = brute_spelling(rows, 3)
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n, r.root) for r in got.collect()) == want
    assert len(want) > 100 and any(w[2] for w in want) and any(w[3] for w in want)
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_pieces_and_held_words():
    import pyarrow as pa

    rows = [(str(r[0]) if r[0] is not None else None, r[1]) for r in typing()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["ident", "text"])

    def total():
        out = Counter()
        for b in spelling.counter(7, 6)([batch]):
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                out[w] += n
        return out

    whole = total()
    text = rows[-1][1]
    assert "".join(spelling.pieces(text, 50)) == text
    spelling.HELD_WORDS, kept = 10, spelling.HELD_WORDS
    try:
        assert total() == whole
    finally:
        spelling.HELD_WORDS = kept


def test_chains(spark):
    chain = [(f"word{i:02d}", f"word{i + 1:02d}") for i in range(13)]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string"), 14.0)
    assert {r.root for r in got.collect()} == {"word13"}
