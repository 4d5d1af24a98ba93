"""Exact top-k inner-product search without random access.

Candidates are dealt into blocks and stay there; only the queries, one row in a hundred, go to every block, and pass it
in batches. A block's vectors are turned into their principal axes, which leaves inner products
as they are but puts most of every score into few components, and each component's values form a sorted list. For a
query the lists that matter most are read first, each from its best end; what has been read gives every candidate a
lower and an upper bound of its score, unread values lying between the list's frontier and its far end. Reading stops
when few candidates are left outside which none can qualify, and those get their final scores from the integers. The
blocks' winners meet in one small ranking for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import arrow_schema, runs, ship, with_arrow

#: Rows of a block of candidates on average, and blocks at least.
CANDIDATE_ROWS, LEAST_BLOCKS = 16_384, 24
#: Lists that are read together, shares of them that are read before the bounds are looked at again, and the share
#: of a block's candidates below which their final scores are cheaper than more reading.
LISTS, DEPTHS, FEW = 8, (0.5, 1.0), 0.25
#: Scores beyond 64 bits are shown as the nearest long.
LEAST, MOST = -(2**63), 2**63 - 1


class Block:
    """Candidates of one length with the sorted lists of their principal components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.read, self.held = ids, x, 0, 0
        self.largest = float(np.abs(x).max(initial=0.0))
        self.plain = x.size == 0 or self.largest > 2**40
        if not self.plain:
            _, self.axes = np.linalg.eigh(x.T @ x)
            self.turned = x @ self.axes
            columns = np.ascontiguousarray(self.turned.T)
            self.order = np.argsort(columns, axis=1, kind="stable")  # a row for each list
            self.sorted = np.take_along_axis(columns, self.order, axis=1)
            self.slack = 1e-10 * float(np.sqrt((x * x).sum(axis=1).max()))

    def survivors(self, query: np.ndarray, take: np.ndarray, k: int) -> np.ndarray:
        """Rows of ``take`` that can be among the k best."""
        if self.plain or len(take) <= k:
            return take
        n, weight = len(self.x), query @ self.axes
        ends = np.sort(np.stack([self.sorted[:, 0] * weight, self.sorted[:, -1] * weight]), axis=0)  # worst, best
        slack = self.slack * float(np.sqrt(query @ query)) + 1e-300
        by_spread = np.argsort(ends[0] - ends[1])
        done, left = np.zeros(n), take
        self.held += n * len(by_spread)
        for g in range(0, len(by_spread), LISTS):
            lists, rest = by_spread[g : g + LISTS], by_spread[g + LISTS :]
            low, high = ends[0][rest].sum(), ends[1][rest].sum()
            part, unread_low, unread_high, at = np.zeros(n), np.full(n, ends[0][lists].sum()), np.zeros(n), 0
            seen = [np.zeros(0, dtype=np.int64)] * len(lists)
            for depth in DEPTHS:
                to = max(at + 1, int(depth * n))
                chunk = [slice(n - to, n - at) if weight[d] > 0 else slice(at, to) for d in lists]
                rows = [self.order[d, c] for d, c in zip(lists, chunk, strict=True)]
                gains = [self.sorted[d, c] * weight[d] for d, c in zip(lists, chunk, strict=True)]
                part += np.bincount(np.concatenate(rows), weights=np.concatenate(gains), minlength=n)
                self.read += (to - at) * len(lists)
                at = to
                if to < n:
                    frontier = np.array([g.min() for g in gains])
                    seen = rows if not len(seen[0]) else [np.concatenate([a, b]) for a, b in zip(seen, rows, strict=True)]
                    flat, sizes = np.concatenate(seen), [len(a) for a in seen]
                    unread_low = ends[0][lists].sum() - np.bincount(flat, weights=np.repeat(ends[0][lists], sizes), minlength=n)
                    unread_high = frontier.sum() - np.bincount(flat, weights=np.repeat(frontier, sizes), minlength=n)
                else:
                    unread_low = unread_high = np.zeros(n)
                lower, upper = done + part + unread_low + low, done + part + unread_high + high
                bar = np.partition(lower[take], len(take) - k)[len(take) - k]
                left = take[upper[take] >= bar - slack]
                if len(left) <= max(4 * k, FEW * n):
                    return left
            done = done + part
        return left

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates but those with the query's own id, ties to smaller ids."""
        return [(s, int(self.ids[row])) for s, row in self.best(query, own, k)]

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, row) of the same."""
        left = self.survivors(query, np.flatnonzero(self.ids != own), k)
        exact = self.largest * float(np.abs(query).max(initial=0.0)) * self.x.shape[1] < 2**52
        whole = [[int(v) for v in row] for row in self.x[left]] if not exact else None
        scores = (self.x[left] @ query).astype(np.int64) if exact else np.array([sum(a * int(b) for a, b in zip(row, query, strict=True)) for row in whole], dtype=object)
        best = sorted(zip((-s for s in scores.tolist()), self.ids[left].tolist(), left.tolist(), strict=True))[:k]
        return [(-s, row) for s, _, row in best]


def clipped(score: int) -> tuple[int, str]:
    """The nearest long, and a text that sorts scores with the same one as the scores themselves are sorted."""
    if LEAST <= score <= MOST:
        return score, "5"
    digits = str(abs(score))
    if score > 0:
        return MOST, f"9{len(digits):05d}{digits}"
    return LEAST, f"1{99999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The k rows with the highest integer inner product for every row whose vec_id is divisible by ``every``.

    ``vectors`` needs vec_id and embedding; other columns are ignored. A component x counts as floor(scale * x).
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Vectors that are null or hold null
    components, or components that are not finite once scaled, and rows without an id take no part. Every other row
    counts, also where ids repeat: as a candidate for other ids and as a query whose results share the ranking of its
    id; equal rows travel as one with their number. Scores are exact integers of any size and ranked as such; one
    beyond 64 bits is shown as the nearest long. Vectors are compared with vectors of their own length only; an empty
    table gives no rows. Nothing is broadcast.
    """
    ship(vectors.sparkSession)
    whole = F.expr(f"transform(embedding, x -> transform(array({scale}D * cast(x as double)), y -> if(abs(y) < 4503599627370496D, cast(floor(y) as double), y))[0])")
    finite = F.expr("vec_id is not null and x is not null and forall(x, y -> y is not null and not isnan(y) and abs(y) < double('infinity'))")
    usable = vectors.select("vec_id", whole.alias("x")).filter(finite).groupBy("vec_id", "x").agg(F.count("*").alias("times"))
    blocks = max(LEAST_BLOCKS, math.ceil(vectors.count() / CANDIDATE_ROWS))
    candidates = usable.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asked"), "vec_id", "times", "x")
    queries = usable.filter(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asked"), "vec_id", "times", "x")
    ddl = "query_id long, vec_id long, score long, beyond string"
    schema = arrow_schema(ddl)

    def search(batches):
        held, number, built = [], None, {}
        for (block, asked), rows in runs_by_batch(batches):
            if block != number:
                held, number, built = [], block, {}
            if not asked:
                held.append(rows)
                continue
            if held:
                built, held = built_blocks(pa.Table.from_batches(held)), []
            out = []
            for own, again, vector in zip(rows.column("vec_id").to_pylist(), rows.column("times").to_pylist(), rows.column("x").to_pylist(), strict=True):
                if len(vector) in built:
                    found, times = built[len(vector)]
                    best = found.best(np.array(vector, dtype=np.float64), own, k)
                    out += [(own, int(found.ids[row]), *clipped(s)) for s, row in best for _ in range(min(k, again * int(times[row])))][:k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = candidates.unionByName(queries).repartition("block").sortWithinPartitions("block", "asked")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return with_arrow(dealt, search, ddl).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def runs_by_batch(batches):
    """((block, asked), rows): each batch's runs by themselves, so a block's queries are never held together."""
    for batch in batches:
        for key, rows in runs(iter([batch]), ["block", "asked"]):
            yield key, rows.to_batches()[0]


def built_blocks(rows: pa.Table) -> dict[int, tuple[Block, np.ndarray]]:
    """A block of candidates for each length of vector, with how often each row stands in the table."""
    lengths = rows.column("x").combine_chunks().value_lengths().to_numpy()
    out = {}
    for dims in np.unique(lengths).tolist():
        part = rows.filter(pa.array(lengths == dims))
        x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims)
        out[dims] = Block(part.column("vec_id").to_numpy(), x), part.column("times").to_numpy()
    return out


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from s)
select query_id, cast(rn as int) as rank, vec_id, score from r where rn <= 10
"""
