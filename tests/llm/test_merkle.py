"""The Merkle manifest against a plain tree."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from zetasky.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, idx long, hash string, path int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout):
    """The top, and each node's siblings (before, after) from the lowest level on."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // fanout * fanout : k // fanout * fanout + fanout]
            steps[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], steps


def plain(rows, fanout):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fanout) for s in sources}
    root, above = tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, up in zip(sources, above, strict=True):
        for x, steps in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            r, node = x[3], x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:5])
            for before, after in steps + up:
                node = H(before, node, after)
            out.append((r[0], x[2], trees[s][0], root, H(*(b + a for b, a in steps + up)), node, node == root))
    return out


def rows_of(n, seed=2):
    rng = random.Random(seed)
    sizes = [("hot", n), (None, 17), ("", 16), ("one", 1), ("Ä", 2), ("zz", 33)] + [(f"s{i}", rng.randint(1, 5)) for i in range(20)]
    ids = iter(range(10**6))
    for source, k in sizes:
        for _ in range(k):
            i = next(ids)
            text = None if i % 13 == 0 else "" if i % 17 == 0 else rng.choice(["Abc É", "abc", "ÄÖ x", "A" * 3000])
            yield (None if i % 29 == 0 else i, text, rng.choice(["en", None]), source, rng.choice([None, i]), "x", 1, "y", 0)
    yield from [(7, "Same", "en", "hot", 4, "x", 1, "y", 0)] * 5  # equal rows, and an id of several rows


@pytest.mark.parametrize(("n", "fanout", "parts"), [(300, 16, 7), (70, 2, 3), (1, 16, 1)])
def test_manifest_equals_a_plain_tree(spark, n, fanout, parts):
    rows = list(rows_of(n))
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(parts), fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows, fanout)))


def test_small_manifests(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    only = merkle.manifest(spark.createDataFrame([(4, "Text", "en", "s", 4, "x", 1, "y", 0)], SCHEMA)).first()
    assert only.leaf == only.subroot == only.root == leaf(4, "Text", "en", "s", 4) and only.proof_sha256 == H("")
    changed = merkle.manifest(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("Ab").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2).cast("long").alias("n_chars")))
    counts = {r.verified: r["count"] for r in changed.groupBy("verified").count().collect()}
    assert counts[False] == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(2000)) and sum(counts.values()) == 2000


def test_numbering_spreads_a_key_over_tasks(spark):
    nodes = spark.range(0, 5000, 1, 9).select(F.when(F.col("id") % 3 == 0, "=hot").otherwise(F.concat(F.lit("=s"), F.col("id") % 7)).alias("key"), (F.col("id") * 7919 % 5003).alias("v"))
    rows, _ = merkle.numbered(nodes, F.col("v"))
    got = rows.collect()
    want = defaultdict(list)
    for r in nodes.collect():
        want[r.key].append(r.v)
    assert len(got) == 5000
    for r in got:
        assert sorted(want[r.key])[r.idx] == r.v and r.nodes == len(want[r.key])
