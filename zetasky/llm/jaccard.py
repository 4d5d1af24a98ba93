"""Exact n-gram Jaccard join with a count-vector R-tree.

A document is the set of its word shingles. The shingles of a set are hashed into groups; the counts in the groups
are a point. The sum of two points' coordinate minima bounds the overlap of their sets from above, and so does the
sum over an R-tree box's upper corner for every point in the box. What survives the bound is verified on the sets.

Stages, each exact and none quadratic in a group of copies:

1. Equal sets become one node.
2. Nodes are dealt by the keys that two similar sets must share: in any fixed order of shingles, sets above the
   threshold have one in common among their first few. The order goes from rare shingles to frequent ones. A large
   set, whose shingles may be common by chance, is cut into more hash ranges than similar sets can differ in; one
   range must then agree as a whole.
3. Nodes that meet under a key, have sizes that can be similar and survive the R-tree's bound are tied together;
   components of ties hold all links. A part of the keys goes first: nodes that it joins are not tied again under the
   many other keys they share.
4. A component's sets are verified in blocks of bounded size. Nodes already linked need no look at each other.
   Components of several blocks are shuffled into new blocks once. Nodes that are still apart meet by key again, as
   points, and only those that survive the bound get their texts sent to each other, once for each pair of blocks.

Shingles are 64-bit hashes throughout: a wrong link would take colliding hashes of different shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, labelled
from .util import arrow_schema, free_name, map_columns, pack48, runs, ship, sorted_groups, stash, unpack48, unstash, with_arrow

#: Groups that shingles are hashed into: the dimensions of a point, but for one that sums what exceeds MOST_COUNT. They
#: double until a group holds FILL shingles on average at most; a point is folded to compare it with a shorter one.
GROUPS, FILL, MOST_COUNT = 256, 4, 15
#: Points in a leaf, children of a box; bytes of points of small groups that are compared at once, and nodes in a small group.
LEAF, FAN_OUT, COMPARED, SMALL = 32, 8, 1_000_000, 8
#: Sets of this size and more get keys of whole hash ranges.
LARGE = 1000
#: Dimensions of a point at most, where sets are verified and may be large.
MOST_GROUPS = 4096
#: Keys in a bucket on average, and buckets at least. Nodes of a slice and, among them, nodes of one key from which
#: on they are tied together at once.
BUCKET_KEYS, LEAST_BUCKETS, SLICE_NODES, SLICE_COMMON = 500_000, 96, 4096, 16
#: Nodes under a key up to which the R-tree compares them; nodes under a more common key are tied together.
COMMON_KEY = 1024
#: Sizes are sent with keys as classes: powers of this ratio, and the mark of a node that stands for a tied slice.
SIZE_STEP, TIED = 1.07, 255
#: One key in so many is looked at before the others.
FIRST_KEYS = 8
#: Ties that a task holds before it reduces them to those that join nodes still apart.
HELD_TIES = 100_000
#: A block of a component: nodes and shingles at most on average. Nodes of a cell in which nodes still apart meet.
BLOCK_NODES, BLOCK_SHINGLES, CELL_NODES = 256, 500_000, 256
#: Shingles that a task counts together to find common ones, how often a common one occurs among them, and how
#: many common ones are broadcast. They decide the order of shingles, so speed and never results.
COUNTED, COMMON, COMMON_KEPT = 2_000_000, 4, 500_000
WORD_CACHE = 200_000
#: A character of a word.
WORDLIKE = r"[^\t-\r ]"

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: runs of ``width`` words, or all words where there are fewer.

    A-Z are lower-cased; words are separated by spaces and the control characters 9 to 13.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n * 0x2545F4914F6CDD1D % 2**64, dtype=np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * MIX[j % 8] * np.uint64(2 * (j // 8) + 1)
    total ^= total >> np.uint64(31)
    total *= MIX[0]
    total ^= total >> np.uint64(29)
    return np.unique(total)


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)


def packed_point(shingles: np.ndarray) -> bytes:
    """The point in half a byte a group; what exceeds MOST_COUNT is summed in four bytes at the end.

    The minima of capped counts plus the smaller excess are never less than the minima of the counts.
    """
    groups = GROUPS
    while len(shingles) > FILL * groups:
        groups *= 2
    counts = point(shingles, groups)
    low = np.minimum(counts, MOST_COUNT).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes() + int((counts - low).sum()).to_bytes(4, "little")


def unpacked_points(blobs: list[bytes], shortest: int = 0) -> np.ndarray:
    """Counts with as many groups as the shortest point has, or one of ``shortest`` bytes; the excess is last."""
    lengths = np.array([len(b) for b in blobs])
    shortest = shortest or int(lengths.min())
    groups = 2 * shortest - 8
    out = np.empty((len(blobs), groups + 1), dtype=np.int32)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        raw = np.frombuffer(b"".join(blobs[i] for i in rows), dtype=np.uint8).reshape(len(rows), length)
        counts = np.empty((len(rows), 2 * length - 8), dtype=np.uint8)
        counts[:, 0::2], counts[:, 1::2] = raw[:, :-4] & 15, raw[:, :-4] >> 4
        # The group of a hash among half as many groups is that of its own group.
        out[rows, :-1] = counts if length == shortest else counts.reshape(len(rows), -1, groups).sum(axis=1)
        out[rows, -1] = np.ascontiguousarray(raw[:, -4:]).view("<u4")[:, 0]
    return out


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(np.maximum(sizes, 1)) / np.log(SIZE_STEP), TIED - 1).astype(np.uint8)


def class_reach(percent: int) -> int:
    """Classes by which similar sets' sizes can differ, rounding included."""
    return int(np.log(100 / percent) / np.log(SIZE_STEP) + 1e-6) + 1


@lru_cache
def shingles_a_range(percent: int) -> float:
    """Shingles of the largest set of a class that a hash range shall hold on average.

    A set of ``n`` may differ from a similar one in n * (100 - percent) / percent shingles, so its keys must be more than
    that. What is sought is a mean with which the ranges of c shingles or more are enough, for the greatest such c.
    """
    t = percent / 100

    def share(mean: float, c: int) -> float:
        return (1 - sum(exp(-mean) * mean**k / factorial(k) for k in range(c))) / mean

    best = max(((c, min(share(m * x, c) for x in (t * t, t, 1.0)), m) for c in range(1, 9) for m in (0.2 * i for i in range(1, 60))), key=lambda b: (b[0] if b[1] > 1.05 * (1 - t) / t else 0, b[1]))
    return best[2]


def range_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the hash ranges of a large set: similar sets share one at least.

    Sizes fall into classes by powers of the threshold, so similar sets are in one class or in neighbours; a set has
    keys for its class and the next. Two similar sets differ in no more shingles than ``most``, so of more ranges one at
    least holds the same shingles in both. Ranges of few shingles, which sets may share by chance, get no key where
    enough fuller ones are left; of two sets' shared ranges one is full enough for both.
    """
    lowest, keys = int(np.floor(np.log(len(shingles)) / np.log(100 / percent) + 1e-9)), []
    most = len(shingles) * (100 - percent) // percent
    for c in (lowest, lowest + 1):
        ranges = max(most + 2, int((100 / percent) ** (c + 1) / shingles_a_range(percent)))
        at = (((shingles >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content = np.zeros(ranges, dtype=np.uint64)
        content[at[first]] = np.add.reduceat((shingles ^ shingles >> np.uint64(27)) * MIX[2], first)
        counts = np.bincount(at, minlength=ranges)
        held = np.flatnonzero(counts >= np.sort(counts)[ranges - most - 1])
        key = (content[held] ^ content[held] >> np.uint64(31)) * MIX[3] + held.astype(np.uint64) * MIX[4] + np.full(1, c, dtype=np.uint64) * MIX[5]
        keys.append((key ^ key >> np.uint64(30)) * MIX[6])
    return np.concatenate(keys)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` among which two sets above the threshold share one: any ``n`` minus the least
    overlap, plus one; the least overlap with any partner is ``percent`` of ``n``, rounded up."""
    return n - -(-percent * n // 100) + 1


def enough(overlap, sizes, percent: int):
    """Whether an overlap (or a bound of it) reaches the threshold for the sum of two sets' sizes, in integers."""
    return (100 + percent) * overlap >= percent * sizes


class RTree:
    """Points packed into boxes; a box knows its upper corner and its smallest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points, np.arange(len(points)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        corner, least, step = self.points, self.sizes, LEAF
        while True:
            cuts = np.arange(0, len(corner), step)
            corner, least = np.maximum.reduceat(corner, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((corner, least))
            if len(cuts) <= FAN_OUT:
                break
            step = FAN_OUT

    def _pack(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows in an order that keeps near points together: halves along the widest dimension, to leaves."""
        stack, out = [rows], []
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            spread = points[part].max(axis=0) - points[part].min(axis=0)
            part = part[np.argsort(points[part, spread.argmax()], kind="stable")]
            half = (len(part) // 2 + LEAF - 1) // LEAF * LEAF
            stack += [part[half:], part[:half]]
        return np.concatenate(out)

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose overlap with the point could reach the threshold."""
        corner, least = self.levels[-1]
        boxes = np.arange(len(corner))
        for level in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[level]
            boxes = boxes[enough(np.minimum(corner[boxes], point).sum(axis=1), size + least[boxes], percent)]
            step, below = (LEAF, len(self.points)) if level == 0 else (FAN_OUT, len(self.levels[level - 1][0]))
            boxes = (boxes[:, None] * step + np.arange(step)).ravel()
            boxes = boxes[boxes < below]
        boxes = boxes[enough(np.minimum(self.points[boxes], point).sum(axis=1), size + self.sizes[boxes], percent)]
        return self.order[boxes]


def pairs_within(points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the earlier rows that survive the bound."""
    if len(points) <= 2 * LEAF:
        for i in range(1, len(points)):
            yield i, np.flatnonzero(enough(np.minimum(points[:i], points[i]).sum(axis=1), sizes[i] + sizes[:i], percent))
        return
    tree = RTree(points, sizes)
    for i in range(1, len(points)):
        near = tree.search(points[i], sizes[i], percent)
        yield i, np.sort(near[near < i])


def shared_keys(nodes: DataFrame, total: int, percent: int) -> DataFrame:
    """Nodes that meet under a key: (key, a, null), or (null, a, b) where so many meet that they are tied at once.

    Keys travel in packed slices of many nodes by hash bucket: six bytes, a size class and a place in the slice each.
    """
    buckets, reach = max(LEAST_BUCKETS, int(total / BUCKET_KEYS)), class_reach(percent)
    ddl = "bucket int, base long, keys binary, sizes binary, owners binary, ties binary"
    schema, out_schema = arrow_schema(ddl), arrow_schema("key long, a long, b long")

    def pack(batches):
        for batch in batches:
            nid = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(nid) != 1) + 1).tolist(), len(nid)]
            for begin, stop in zip(cuts, cuts[1:], strict=False):
                for at in range(begin, stop, SLICE_NODES):
                    part = batch.slice(at, min(SLICE_NODES, stop - at))
                    blobs = part.column(2).to_pylist()
                    both = np.sort(unpack48(blobs) << np.uint64(16) | np.repeat(np.arange(len(blobs), dtype=np.uint64), [len(b) // 6 for b in blobs]))
                    key, owner = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
                    size = size_class(part.column(1).to_numpy())[owner]
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    common = np.repeat(n > SLICE_COMMON, n)
                    head = np.repeat(first, n)
                    size[common] = TIED
                    extra = common & (np.arange(len(key)) != head)
                    ties = np.stack([owner[extra], owner[head[extra]]], axis=1).astype("<i8") + nid[at]
                    key, owner, size = key[~extra], owner[~extra], size[~extra]
                    bucket = (key % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    key, owner, size, bucket = key[order], owner[order], size[order], bucket[order]
                    ends = np.searchsorted(bucket, np.arange(buckets + 1))
                    rows = [(b, int(nid[at]), pack48(key[i:j]), size[i:j].tobytes(), owner[i:j].astype("<u2").tobytes(), b"") for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]
                    if len(ties):
                        rows.append((int(nid[at] % buckets), int(nid[at]), b"", b"", b"", ties.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)

    def meet(batches):
        for _, rows in runs(batches, ["bucket"]):
            key = unpack48(rows.column("keys").to_pylist())
            size = np.frombuffer(b"".join(rows.column("sizes").to_pylist()), dtype=np.uint8)
            owners = rows.column("owners").to_pylist()
            nid = np.frombuffer(b"".join(owners), dtype="<u2").astype(np.int64) + np.repeat(rows.column("base").to_numpy(), [len(o) // 2 for o in owners])
            ties = np.frombuffer(b"".join(rows.column("ties").to_pylist()), dtype="<i8").reshape(-1, 2)
            order = np.argsort(key << np.uint64(8) | size)
            key, size, nid = key[order], size[order].astype(np.int16), nid[order]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            many = np.repeat((n > COMMON_KEY) | (size[first + n - 1] == TIED), n)
            head = np.repeat(first, n)
            near = (key[1:] == key[:-1]) & (size[1:] - size[:-1] <= reach)
            few = (np.concatenate([[False], near]) | np.concatenate([near, [False]])) & ~many
            many &= np.arange(len(key)) != head
            ties = np.concatenate([ties, np.stack([nid[many], nid[head[many]]], axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(key[few].astype(np.int64)), pa.array(nid[few]), pa.nulls(int(few.sum()), pa.int64())], schema=out_schema)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ties), pa.int64()), pa.array(ties[:, 0].copy()), pa.array(ties[:, 1].copy())], schema=out_schema)

    packed = with_arrow(nodes.select("node", "n", "keys"), pack, ddl)
    return sorted_groups(packed, ["bucket"], meet, "key long, a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a value of ``column`` does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        value = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(value, value[-1]))
        if cut or (held and held[-1].column(column)[-1].as_py() != value[-1]):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def ties_under_keys(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[np.ndarray]:
    """Arrays of ties (node, node) that join all nodes of a key which survive the bound; rows come sorted by key.

    Groups of a few nodes are compared many groups at once, larger ones through the R-tree. Nodes of one label are
    joined already and need no tie.
    """
    for rows in whole_groups(batches, "key"):
        key, nodes, sizes, labels = (rows.column(c).to_numpy() for c in ("key", "node", "n", "label"))
        blobs = rows.column("point").to_pylist()
        lengths = np.array([len(b) for b in blobs])
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        n = np.diff(cuts)
        is_small = np.repeat(n <= SMALL, n)
        pairs = [np.stack([i, i + step]) for step in range(1, SMALL) if len(i := np.flatnonzero((key[step:] == key[:-step]) & (labels[step:] != labels[:-step]) & is_small[step:]))]
        pairs = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), dtype=np.int64)
        shorter = lengths[pairs].min(axis=0)
        for length in np.unique(shorter).tolist():
            own = pairs[:, shorter == length]
            for i, j in (own[:, at : at + COMPARED // length] for at in range(0, own.shape[1], COMPARED // length)):
                a, b = (unpacked_points([blobs[r] for r in side.tolist()], length) for side in (i, j))
                survive = enough(np.minimum(a, b).sum(axis=1), sizes[i] + sizes[j], percent)
                yield np.stack([nodes[j[survive]], nodes[i[survive]]], axis=1)
        for begin, count in zip(cuts[:-1][n > SMALL].tolist(), n[n > SMALL].tolist(), strict=True):
            own, root = nodes[begin : begin + count], np.unique(labels[begin : begin + count], return_inverse=True)[1]
            if not root.any():
                continue
            ties = []
            for i, near in pairs_within(unpacked_points(blobs[begin : begin + count]), sizes[begin : begin + count], percent):
                other, first = np.unique(root[near], return_index=True)
                for r, j in zip(other.tolist(), near[first].tolist(), strict=True):
                    if r != root[i]:
                        ties.append((i, j))
                        root[root == r] = root[i]
            if ties:
                yield own[np.array(ties)]


def forests(ties: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Ties that join the same nodes as ``ties``: each node with the least that it reaches, of many ties at a time.

    Similar nodes meet again under most of their keys, so ties are many times as many as nodes; these are fewer than
    the nodes that were tied.
    """
    held, size = [], 0

    def least() -> np.ndarray:
        nodes, labels = labelled(np.unique(np.concatenate(held), axis=0).T)
        return np.stack([nodes, labels], axis=1)[nodes != labels]

    for found in ties:
        held.append(found)
        size += len(found)
        if size >= HELD_TIES:
            held = [least()]
            size = len(held[0])
            if 2 * size >= HELD_TIES:
                yield held[0]
                held, size = [], 0
    if size:
        yield least()


def verify(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels: (row, row)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = min(MOST_GROUPS, max(GROUPS, 1 << (int(sizes.max()) // 8).bit_length()))
    points = np.stack([point(s, groups) for s in sets])
    _, root = np.unique(labels, return_inverse=True)
    links = []
    tree = RTree(points, sizes) if len(sets) > 2 * LEAF else None
    for i in range(len(sets)):
        near = tree.search(points[i], sizes[i], percent) if tree else np.flatnonzero(enough(np.minimum(points, points[i]).sum(axis=1), sizes[i] + sizes, percent))
        near = near[root[near] != root[i]]
        while len(near):
            j = near[0]
            overlap = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
            if enough(overlap, sizes[i] + sizes[j], percent):
                links.append((int(i), int(j)))
                root[root == root[j]] = root[i]
                near = near[root[near] != root[i]]
            else:
                near = near[1:]
    return links


def text_id() -> Column:
    """With doc_id, names a row, or equal ones."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingled(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """doc_id, tid (hash of the text), n, print (128-bit fingerprint of the set), point and packed keys of every
    document; no print without a shingle."""

    def make():
        words = WordHashes()
        last, frequency = common.value

        def run(doc_id, tid, text):
            out = {"doc_id": doc_id, "tid": tid, "n": [], "print": [], "point": [], "keys": []}
            for t in text:
                s = shingle_set(t, width, words)
                out["n"].append(len(s))
                if len(s) == 0:
                    for k in ("print", "point", "keys"):
                        out[k].append(None)
                    continue
                out["print"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["point"].append(packed_point(s))
                want = prefix_size(len(s), percent)
                ranges = range_keys(s, percent) if len(s) >= LARGE else s[:0]
                if len(s) * percent > LARGE * 100:  # no similar set is small
                    keys = s[:0]
                elif len(last):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    is_common = last[at] == s
                    keys = s[~is_common][:want]
                    by_frequency = np.argsort(frequency[at[is_common]], kind="stable")
                    keys = np.concatenate([keys, s[is_common][by_frequency][: want - len(keys)]])
                else:
                    keys = s[:want]
                out["keys"].append(pack48(np.concatenate([keys, ranges]) >> np.uint64(16)))
            return out

        return run

    rows = docs.select("doc_id", text_id().alias("tid"), "text")
    return map_columns(rows, ["doc_id", "tid", "text"], "doc_id long, tid long, n long, print binary, point binary, keys binary", make)


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and their places by frequency, the least frequent first: those met
    again and again by a task, with the largest sums."""

    def count(batches):
        words, held, size = WordHashes(), [], 0

        def often():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"shingle": found[n >= COMMON].view(np.int64), "n": n[n >= COMMON].astype(np.int64)})

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), width, words))
                size += len(held[-1])
                if size >= COUNTED:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    counts = with_arrow(docs.select("text"), count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).select("shingle").toArrow().column(0).to_numpy()
    found = rows.astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - 1 - order).astype(np.int32)


def verified_links(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different labels in blocks (comp, block, part, node, label, text)."""

    def run(batches):
        words = WordHashes()
        for _, rows in runs(batches, ["comp", "block", "part"]):
            if rows.num_rows < 2:
                continue
            nodes = rows.column("node").to_pylist()
            sets = [shingle_set(t.as_py(), width, words) for t in rows.column("text")]
            links = verify(sets, rows.column("label").to_numpy(), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], schema=schema)

    schema = arrow_schema("a long, b long")
    return sorted_groups(blocks, ["comp", "block", "part"], run, "a long, b long")


def similar_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Classes of documents that links of Jaccard similarity ``percent`` / 100 or more connect.

    ``docs`` needs doc_id and text; other columns are ignored. Returns a row for each row of ``docs``: doc_id,
    n_shingles, component_id (the least doc_id that links reach) and n_copies (rows with the very same set).
    Null, empty or wordless texts have no shingles and stand alone. Rows with a null id link like others, and get a
    null component unless links reach a row with an id. Repeated rows are copies. An empty table gives no rows.
    """
    base, named = _classes(docs, width, percent)
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(heads, "label").select("print", "component_id", "copies")
    return base.join(classes, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n, print), and the sets: print, least (doc_id), head, copies and label, the same for linked sets.

    ``head`` is the set's first row as (nameless, doc_id, tid), rows without an id last.
    """
    spark = docs.sparkSession
    ship(spark)
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    whole, whole_path = stash(shingled(docs, width, percent, common))
    base, _ = stash(whole.select("doc_id", "tid", "n", "print"))
    one_each = whole.filter("print is not null").groupBy("print").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tid")).alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("keys").alias("keys"))
    keyed, keyed_path = stash(one_each.withColumn("node", F.monotonically_increasing_id()))
    nodes, _ = stash(keyed.select("node", "print", "least", "head", "copies", "n"))
    unstash(spark, whole_path)

    # Ties: nodes that share a key and survive the bound.
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("keys") / 6), F.lit(0))).first()[0]
    shared, shared_path = stash(shared_keys(keyed, total, percent))
    few = shared.filter("key is not null").select("key", F.col("a").alias("node"))
    points = keyed.select("node", "n", "point")
    schema = arrow_schema("a long, b long")

    def tied(batches):
        for found in forests(ties_under_keys(batches, percent)):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in (0, 1)], schema=schema)

    def met(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        known = points.withColumn("label", F.col("node")) if labels is None else points.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return sorted_groups(rows.join(known, "node").select("key", "node", "n", "point", "label"), ["key"], tied, "a long, b long")

    # Some of the keys first: similar nodes share most of theirs, and what these tie needs no tie under the others. Ties
    # are written, for components read them more than once.
    is_first = F.pmod("key", F.lit(FIRST_KEYS)) == 0
    ties, ties_path = stash(shared.filter("key is null").select("a", "b").union(met(few.filter(is_first), None)))
    labels, labels_path = stash(connected_components(ties))
    more, more_path = stash(met(few.filter(~is_first), labels))
    tied_nodes, _ = stash(connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)).select("node", F.col("label").alias("comp")))
    unstash(spark, shared_path, ties_path, labels_path, more_path)

    # Blocks: one text for each node of a component of several.
    members = nodes.select("node", "print", "least", "n").join(tied_nodes, "node")
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(sizes.select("comp", blocks.alias("blocks")), "comp")
    texts = docs.select("doc_id", "text").join(placed.select(F.col("least").alias("doc_id"), "node", "print", "comp", "blocks"), "doc_id")
    nameless = placed.filter("least is null").select("node", "print", "comp", "blocks").join(texts_of_nameless(docs, width), "print")
    texts, texts_path = stash(one_text_each(texts.select(*SOUGHT).union(nameless.select(*SOUGHT)), width))

    def deal(df: DataFrame, salt: int) -> DataFrame:
        return df.select("comp", block_of(salt).alias("block"), F.lit(0).alias("part"), "node", F.col("node").alias("label"), "text")

    first, _ = stash(verified_links(deal(texts, 1), width, percent))
    links, several = first, texts.filter("blocks > 1")
    if several.limit(1).count():
        again, _ = stash(verified_links(deal(several, 2), width, percent))
        links = links.union(again)
        more, _ = stash(verified_links(still_apart(spark, keyed, several, links, percent), width, percent))
        links = links.union(more)
    labels, _ = stash(connected_components(links))
    unstash(spark, keyed_path, texts_path)

    named = nodes.select("node", "print", "least", "head", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return base, named


def block_of(salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each class of ``docs``, with all its columns: that with the smallest id, then the smallest text hash.

    Rows decide, not ids: of one id's texts each stays or goes with its own class. A row without an id stays where no
    row of its class has one. Repeated rows stay once. Rows without a shingle stay, repeated ones with an id once.
    """
    base, named = _classes(docs, width, percent)
    first = named.groupBy("label").agg(F.min("head").alias("head")).select("head.doc_id", F.col("head.tid").alias("tid"))
    bare = base.filter("print is null").select("doc_id", "tid")
    own_id, own_tid, tid, row = (free_name(docs, stem) for stem in ("kept_id", "kept_tid", "text_id", "row_number"))
    keep = first.union(bare).distinct().select(F.col("doc_id").alias(own_id), F.col("tid").alias(own_tid))
    kept = docs.withColumn(tid, text_id()).join(keep, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(tid) == F.col(own_tid)), "left_semi")
    alone = F.when(F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(WORDLIKE), F.monotonically_increasing_id()).otherwise(-1)
    return kept.withColumn(row, alone).dropDuplicates(["doc_id", tid, row]).select(*(F.col(f"`{c}`") for c in docs.columns))


#: What ``one_text_each`` reads.
SOUGHT = ("node", "comp", "blocks", "print", "text")


def texts_of_nameless(docs: DataFrame, width: int) -> DataFrame:
    """print and text of each set that rows with a null id hold, which no id leads to."""
    schema = arrow_schema("print binary, text string")

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, words) for t in batch.column(0)]
            kept = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(sets[i].tobytes()) for i in kept], pa.binary()), pa.array([batch.column(0)[i].as_py() for i in kept], pa.string())], schema=schema)

    return with_arrow(docs.filter("doc_id is null").select("text"), run, "print binary, text string").dropDuplicates(["print"])


def one_text_each(texts: DataFrame, width: int) -> DataFrame:
    """One row for each node, with a text that really has its set: ids may repeat with different texts."""
    schema = arrow_schema("node long, comp long, blocks int, text string")

    def run(batches):
        words = WordHashes()
        for batch in batches:
            keep = [xxhash.xxh3_128_digest(shingle_set(t.as_py(), width, words).tobytes()) == p.as_py() for t, p in zip(batch.column(4), batch.column(3), strict=True)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in (0, 1, 2, 4)], schema=schema)

    return with_arrow(texts.select(*SOUGHT), run, "node long, comp long, blocks int, text string").dropDuplicates(["node"])


def still_apart(spark, keyed: DataFrame, several: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Blocks (comp, block, part, node, label, text) in which nodes that ``links`` leaves apart meet, by pairs of blocks.

    Two nodes with different labels meet if they share a key and survive the bound. Under a key that many nodes hold,
    those outside its largest label are dealt into parts and all its nodes into blocks, which meet as points.
    """
    labels = connected_components(links).select("node", "label")
    places = several.select("node", "comp", "blocks").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    places, _ = stash(places)
    unsettled = places.groupBy("comp").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("comp")
    open_nodes, _ = stash(keyed.select("node", "n", "point", "keys").join(places.join(unsettled, "comp").withColumn("home", block_of(1)).select("node", "label", "home"), "node"))

    schema = arrow_schema("key long, node long, label long")

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_NODES):
                part = batch.slice(at, SLICE_NODES)
                blobs = part.column(2).to_pylist()
                owner = np.repeat(np.arange(len(blobs)), [len(b) // 6 for b in blobs])
                yield pa.RecordBatch.from_arrays([pa.array(unpack48(blobs).astype(np.int64)), pa.array(part.column(0).to_numpy()[owner]), pa.array(part.column(1).to_numpy()[owner])], schema=schema)

    keys, _ = stash(with_arrow(open_nodes.select("node", "label", "keys"), spread, "key long, node long, label long"))
    by_label = keys.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).filter(F.col("all") > F.col("top.n"))
    split, _ = stash(split.select("key", F.col("top.label").alias("most"), F.ceil((F.col("all") - F.col("top.n")) / CELL_NODES).cast("int").alias("parts"), F.ceil(F.col("all") / CELL_NODES).cast("int").alias("blocks")))  # written, so that the join below can split a common key
    rows = keys.join(split, "key").withColumn("part_of", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).withColumn("block_of", block_of(4))
    every = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.col("block_of")).withColumn("mine", F.lit(False))
    minor = rows.filter("label <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.col("part_of")).withColumn("mine", F.lit(True))
    cells = every.unionByName(minor).select("key", "block", "part", "node", "label", "mine").join(open_nodes.select("node", "home", "n", "point"), "node")
    met_schema = arrow_schema("block int, part int, node long")

    def meet(batches):
        for _, cell in runs(batches, ["key", "block", "part"]):
            mine = cell.column("mine").to_numpy(zero_copy_only=False)
            if not mine.any() or mine.all():
                continue
            home, node, label, sizes = (cell.column(c).to_numpy() for c in ("home", "node", "label", "n"))
            points = unpacked_points(cell.column("point").to_pylist())
            yours = np.flatnonzero(~mine)
            tree = RTree(points[yours], sizes[yours])
            found = []
            for i in np.flatnonzero(mine):
                near = yours[tree.search(points[i], sizes[i], percent)]
                near = near[label[near] != label[i]]
                low, high = np.minimum(home[near], home[i]), np.maximum(home[near], home[i])
                found += [np.stack([low, high, node[near]], axis=1), np.stack([low, high, np.full(len(near), node[i])], axis=1)]
            found = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].copy())], schema=met_schema)

    met = sorted_groups(cells, ["key", "block", "part"], meet, "block int, part int, node long").distinct()
    return met.join(places.select("node", "label"), "node").join(several.select("node", "comp", "text"), "node").select("comp", "block", "part", "node", "label", "text")
