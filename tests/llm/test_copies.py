"""Exact dedup, n-gram Jaccard join, sharding and mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strataloom.llm import components as cc
from strataloom.llm import exact_dedup, mixing, ngram_jaccard, sharding, shingles

DOCS = "doc_id long, text string, source string, kept string, size string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    rows, base = [], prose(rng, 120)
    for i in range(60):
        words = base.split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        rows.append(" ".join(words))
    passage = prose(rng, 60)
    rows += [passage + " " + prose(rng, 80, 9999) for _ in range(40)]
    rows += ["same  text\there"] * 30 + ["same text here ", "Same text here", None, "", " \n ", "a", "a b", "A  B", "é É", "É é", "one two three four", "ONE two three four"]
    rows += [prose(rng, rng.randrange(1, 40)) for _ in range(40)] + ["long " * 30_000 + "end"]
    return [(i, t, f"s{i % 5}" if i % 11 else None, "clash", "clash") for i, t in enumerate(rows)]


def test_trie():
    rng = random.Random(3)
    for budget in (1 << 30, 4000):
        trie, out, want = exact_dedup.RadixTrie(), defaultdict(lambda: [None, 0]), defaultdict(lambda: [None, 0])
        for i in range(500):
            key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) * rng.randrange(1, 4)
            want[key][1] += 1
            want[key][0] = i if want[key][0] is None else want[key][0]
            trie.insert(key, i, 1)
            if trie.size > budget:
                for k, low, n in trie.spill(budget // 2):
                    out[k][0], out[k][1] = low if out[k][0] is None else min(out[k][0], low), out[k][1] + n
        for k, low, n in trie.terminals():
            out[k][0], out[k][1] = low if out[k][0] is None else min(out[k][0], low), out[k][1] + n
        assert dict(out) == dict(want)


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 3000])
def test_exact_dedup(spark, budget):
    rows = corpus()
    rows += [rows[0], (None, "null id", None, None, None), (None, "w", None, None, None), (9999, "w", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_dedup(df, budget=budget)
    assert got.columns == ["doc_id", "text", "source", "size", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got.collect())
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def brute_set(t, k):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [(i, brute_set(t, k)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for j, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(j)] = min(least.get(find(j), i), i)
    return sorted(str((i, len(s), least.get(find(j)) if s else i)) for j, (i, s) in enumerate(sets))


def test_shingles():
    texts = [r[1] for r in corpus()]
    for k in (1, 4, 5):
        got = list(shingles.shingle_sets(texts, k))
        assert [len(s) for s in got] == [len(brute_set(t, k)) for t in texts]
        for a in range(0, 60, 7):
            assert len(np.intersect1d(got[a], got[a + 1])) == len(brute_set(texts[a], k) & brute_set(texts[a + 1], k))


@pytest.mark.parametrize(("k", "percent", "group"), [(4, 85, 64), (2, 70, 2)])
def test_jaccard(spark, monkeypatch, k, percent, group):
    monkeypatch.setattr(ngram_jaccard, "GROUP", group)
    rows = [r[:2] for r in corpus(7)]
    rows += [rows[3], (7, "another text of a repeated identifier"), (None, "null id text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(str(tuple(r)) for r in ngram_jaccard.jaccard_components(df, k, percent).collect())
    assert got == brute_components(rows, k, percent)


def test_jaccard_without_leaders(spark, monkeypatch):
    """The matrix alone finds every link."""
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", 0)
    rows = [r[:2] for r in corpus(9)]
    got = sorted(str(tuple(r)) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 75).collect())
    assert got == brute_components(rows, 3, 75)


def test_jaccard_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.jaccard_components(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard.jaccard_components(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_bitmaps_bound_the_overlap(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (3, 40, 200, 900):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], rng.integers(0, 1 << 64, n, np.uint64)]))
        rows.append(([int(x) for x in ngram_jaccard.bitmap(a).view(np.int64)], [int(x) for x in ngram_jaccard.bitmap(b).view(np.int64)], len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a))))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a array<long>, b array<long>, x long, y long")
    for r in df.select("x", "y", ngram_jaccard.lacking(F.col("a"), F.col("b")).alias("la"), ngram_jaccard.lacking(F.col("b"), F.col("a")).alias("lb")).collect():
        assert r.la <= r.x and r.lb <= r.y and r.lb > 0.5 * r.y


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 7), (7, 100), (5, 5)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 0} | {i: 21 for i in range(21, 41)}


def brute_shards(rows, shards):
    keyed = sorted(rows, key=lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0))
    total, below, out, slots = sum(len((t or "").encode()) + 1 for _, t in rows), 0, [], defaultdict(int)
    for i, t in keyed:
        size = len((t or "").encode()) + 1
        s = min(shards - 1, (2 * below + size) * shards // (2 * total))
        out.append((i, size, zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s], below = slots[s] + 1, below + size
    return sorted(map(str, out))


@pytest.mark.parametrize("shards", [1, 8, 500])
def test_sharding(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "PROBES", 4)
    monkeypatch.setattr(sharding, "REFINED", 3)
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    rows = [r[:2] for r in corpus(11) if r[0] % 50 or r[0] < 130] + [(None, "n"), (3, "three"), (3, "three"), (3, "three")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string").repartition(3)
    got = sharding.shard_by_bytes(df, shards)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)) for r in got.collect()) == brute_shards(rows, shards)
    assert sharding.shard_by_bytes(df.where("false"), shards).count() == 0


def test_sharding_tolerance_and_files(spark, tmp_path):
    rows = [(i, "x" * (i % 90)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r[1] for r in sharding.shard_by_bytes(df, 4, tolerance=0.1).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 0.25 * sum(sizes) / 4
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3000 and back.select("shard").distinct().count() == 4


def test_flight_keeps_the_balance():
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 400):
        p = [rng.random() for _ in range(n)]
        tokens = [float(rng.choice([0, 5, 5, rng.randrange(1, 1000)])) for _ in range(n)]
        rows = [float(rng.choice([1, 1, 2])) for _ in range(n)]
        q = mixing.flight(p, tokens, rows, [rng.random() for _ in range(n)])
        assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
        for w in (tokens, rows):
            assert abs(sum(a * b for a, b in zip(p, w)) - sum(a * b for a, b in zip(q, w))) < 1e-5 * max(1, sum(w))
        assert all(x in (0.0, 1.0) for x in mixing.landed(q, tokens, rows))


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    monkeypatch.setattr(mixing, "MERGED", 3)
    rows = corpus(13)
    rows += [rows[0], rows[0], (None, "null id of four", "s1", None, None), (5000, None, "empty", None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.mix_sources(df)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for r in rows:
        by[r[2]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        left, w = sum(by.values()) - sum(3 * by[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * by[s] if s in full else left * weight[s] / w for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * by[s] + 1e-9}
        if not more:
            break
        full |= more
    out, taken, heaviest = got.collect(), defaultdict(int), max(size(r[1]) for r in rows if r[0] != 162)
    assert len(out) == len(rows) and "kept" in got.columns
    for r in out:
        assert (r["size"], r.source_size) == (size(r.text), by[r.source]) and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.taken == r["size"] * r.copies <= 3 * r["size"]
        taken[r.source] += r.taken
    big = max(rows, key=lambda r: size(r[1]))
    for s in order:
        assert abs(taken[s] - target[s]) <= (size(big[1]) if s == big[2] else heaviest)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.repeated(got, ["doc_id"]).count() == sum(r.copies for r in out)
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_pairs_of_a_hot_group_grow_with_its_rows(spark, monkeypatch):
    """Near copies without their original, one to eight words changed: pairs in proportion to rows, and no link lost."""
    sizes, plain = {}, ngram_jaccard.written

    def counted(df, name):
        out = plain(df, name)
        if name in ("representative-pairs", "asked", "group-pairs"):
            sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_jaccard, "written", counted)
    for n in (250, 1000):
        rng, sizes = random.Random(5), {}
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        rows = []
        for i in range(n):
            words = list(base)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(150)] = f"x{rng.randrange(999)}"
            rows.append((i, " ".join(words), 1, 2, 3))
        df = spark.createDataFrame(rows, "doc_id long, text string, n long, token long, cls long")
        got = ngram_jaccard.jaccard_components(df)
        assert sum(sizes.values()) <= 8 * n, sizes
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        if n == 250:
            assert sorted(str(tuple(r)) for r in got.collect()) == brute_components([r[:2] for r in rows], 4, 85)


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["cell", "start", "base", "width", "on_hash", "at__", "at", "below", "row", "h", "d", "h__", "a.b"]
    rows = [(i, f"text {i % 40}", *(f"{name} of {i}" for name in names)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in names))
    out = sharding.shard_by_bytes(df, 3)
    assert out.columns == ["doc_id", "text", *names, "size", "text_crc32", "shard", "slot"]
    assert sorted(tuple(r)[: len(names) + 2] for r in out.collect()) == sorted(rows)


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from strataloom.llm import common

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    assert common.scratch_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="share"):
        common.scratch_dir(session("spark://host:7077", None))
