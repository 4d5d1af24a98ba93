import random
import re

import numpy as np
import pytest

from zetasky.llm import components, jaccard


def brute(rows, width=4, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz été ÀÉ".split()) + str(rng.randrange(30))
    passage = [word() for _ in range(25)]
    rows, base = [], []
    for i in range(n):
        kind = rng.randrange(5)
        if kind == 0 or not base:
            words = [word() for _ in range(rng.randrange(1, 90))]
        elif kind == 1:
            words = [word() for _ in range(40)] + passage
        else:
            words = list(rng.choice(base[:6] if kind == 2 else base))
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = word()
        base.append(words)
        sep = rng.choice([" ", "\n", " \t"])
        rows.append((i, sep.join(words).upper() if i % 17 == 0 else sep.join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "One"), (n + 5, "a\x1cb c"), (3, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (None, None), (n + 6, "long word " * 9000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, node string")


def classes(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_classes_equal_brute_force(spark, width, percent):
    rows = corpus(width)
    assert classes(jaccard.similar_classes(frame(spark, rows), width, percent)) == brute(rows, width, percent)


def test_small_blocks_and_common_keys(spark, monkeypatch):
    for name, value in {"BLOCK_NODES": 12, "COMMON_KEY": 5, "COUNTED": 500, "COMMON": 2}.items():
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "LARGE", 40)
    rows = corpus(8, 200)
    assert classes(jaccard.similar_classes(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert jaccard.similar_classes(frame(spark, [])).count() == 0
    assert classes(jaccard.similar_classes(frame(spark, [(1, None), (2, "x")]))) == [(1, 0, 1), (2, 1, 2)]


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.96], rng.integers(0, 2**63, rng.integers(1, 30)).astype(np.uint64)])) if i % 3 else np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for i in range(300)]
    points, sizes = np.stack([jaccard.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree, pruned = jaccard.RTree(points, sizes), 0
    for i, s in enumerate(sets):
        near = set(tree.search(points[i], sizes[i], 85).tolist())
        pruned += len(sets) - len(near)
        for j, t in enumerate(sets):
            if 185 * len(np.intersect1d(s, t)) >= 85 * (len(s) + len(t)):
                assert j in near
    assert pruned > 30_000


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)] + [(9, 9), (7000, 7000), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_large_sets_share_a_range():
    rng = np.random.default_rng(2)
    for percent in (85, 80):
        for _ in range(300):
            n = int(rng.integers(20, 3000))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            changes = int(rng.integers(0, 2 * n * (100 - percent) // (100 + percent) + 1))
            drop = int(rng.integers(0, changes + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, changes - drop, dtype=np.uint64)]))
            if len(b) and (100 + percent) * len(np.intersect1d(a, b)) >= percent * (len(a) + len(b)):
                assert np.intersect1d(jaccard.range_keys(a, percent), jaccard.range_keys(b, percent)).size


def test_clashing_columns_pass_through(spark):
    rows = [(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, "q r s t u v w", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_id string, row_number int").withColumnRenamed("text_id", "Text_ID")
    got = jaccard.keep_one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_slice_of_a_common_key_loses_no_link(spark, monkeypatch):
    """Nodes that a slice ties to their first node stay candidates of other slices' nodes."""
    for name, value in {"SLICE_NODES": 8, "SLICE_COMMON": 1, "LEAST_BUCKETS": 2, "BLOCK_NODES": 2, "CELL_NODES": 3, "COMMON": 1, "COUNTED": 200}.items():
        monkeypatch.setattr(jaccard, name, value)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [line + " " + " ".join(f"tail{i // 2}_{j}" for j in range(4 + i % 9)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert classes(jaccard.similar_classes(docs, 4, 80)) == brute(list(enumerate(texts)), 4, 80)


def test_packed_points_bound_every_overlap():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 9000).astype(np.uint64)
    for _ in range(40):
        a, b = (np.unique(base[rng.random(9000) < rng.random()]) for _ in range(2))
        p, q = jaccard.unpacked_points([jaccard.packed_point(a), jaccard.packed_point(b)])
        assert len(p) <= 2 * jaccard.GROUPS + 1 or min(len(a), len(b)) > jaccard.GROUPS * jaccard.FILL
        assert len(np.intersect1d(a, b)) <= np.minimum(p, q).sum() and p.sum() == len(a)
