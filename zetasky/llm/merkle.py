"""A Merkle manifest of a dataset: a hash tree over every source's documents and one over the sources.

Rows are numbered inside their source, and level by level every ``fanout`` consecutive nodes become one: an integer
division gives the parent's number, a grouping the sorted array of its children, and a hash the parent. The way back
down appends siblings: a node's path is its own siblings and its parent's path, so long paths travel with parents, a
sixteenth as many rows, and a document's are put together only where its proof is.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import stash, unstash

#: Children of a node, and the fields of a leaf in their order.
FANOUT, FIELDS = 16, ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<before:string,after:string>>"


def leaf_of(**instead: Column) -> Column:
    """The leaf of a row: each field as byte count, colon and value, or a dash where it is null."""
    text = lambda c: instead.get(c, F.col(c)).cast("string")
    parts = [F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in FIELDS]
    return F.sha2(F.concat(*parts), 256)


def tampered() -> Column:
    """Whether a row is one of those that are changed: 5 divides the CRC-32 of its id; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(nodes: DataFrame, *order: Column) -> tuple[DataFrame, str]:
    """``nodes`` (key, ...) with row numbers from 0 inside their key (idx) and the key's number of nodes, and a path to delete.

    Rows are dealt by range and numbered where they are; what stands before a range is added from the ranges' counts.
    So a key of any size is spread over tasks. ``nodes`` must be a table already written, and is written again numbered,
    since ranges are drawn from a sample: a range that is computed anew must hold the same rows.
    """
    ranged = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed, path = stash(ranged.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy(part, "key").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = counts.selectExpr("part", "key", "first - sum(n) over (partition by key order by part) + n as shift", "sum(n) over (partition by key) as nodes")
    rows = placed.withColumn("part", part).join(before, ["part", "key"])
    return rows.select(*nodes.columns, (F.col("place") - F.col("shift")).alias("idx"), "nodes"), path


def parent(fanout: int) -> Column:
    return F.floor(F.col("idx") / fanout).cast("long")


class Tree:
    """The levels of hash trees over nodes (key, idx, nodes, hash, and what leaves carry), one for each key.

    ``runs[k]`` has the runs of siblings of level k (key, up, kids), ``tops`` the trees' last nodes (key, height, hash).
    """

    def __init__(self, leaves: DataFrame, carry: tuple[str, ...] = (), fanout: int = FANOUT):
        self.fanout, self.runs, self.paths, tops = fanout, [], [], []
        level, nodes = 0, leaves
        most = leaves.agg(F.max("nodes")).first()[0] or 1
        while True:
            tops.append(nodes.filter("nodes = 1").select("key", F.lit(level).alias("height"), "hash"))
            if level == 0:
                self.lone = nodes.filter("nodes = 1")
            if most <= 1:
                break
            kids = F.array_sort(F.collect_list(F.struct("idx", "hash", *(carry if level == 0 else ()))))
            runs = nodes.filter("nodes > 1").groupBy("key", parent(fanout).alias("up")).agg(F.max("nodes").alias("nodes"), kids.alias("kids"))
            runs, path = stash(runs)
            self.runs.append(runs)
            self.paths.append(path)
            above = F.ceil(F.col("nodes") / fanout).cast("long").alias("nodes")
            nodes = runs.select("key", F.col("up").alias("idx"), above, F.sha2(F.concat_ws("", F.col("kids.hash")), 256).alias("hash"))
            most, level = -(-most // fanout), level + 1
        self.tops = tops[0]
        for more in tops[1:]:
            self.tops = self.tops.union(more)

    def climb(self, tops: DataFrame, *carry: str) -> DataFrame:
        """The leaves (key, idx, hash, the carried columns of both) with ``path``: the siblings on the way to the top and then
        the path that ``tops`` (key, height, path, ...) gives. Level by level from the top, where a tree begins at its own height."""
        own = [c for c in tops.columns if c not in ("key", "height", "path")]
        at = lambda k: tops.filter(F.col("height") == k).select("key", F.lit(0).cast("long").alias("idx"), "path", *own)
        nodes = at(len(self.runs))
        for level in range(len(self.runs) - 1, -1, -1):
            joined = self.runs[level].join(nodes.withColumnRenamed("idx", "up"), ["key", "up"])
            spread = joined.select("key", "path", *own, "kids", F.posexplode("kids").alias("spot", "kid"))
            side = lambda first, n: F.concat_ws("", F.slice(F.col("kids.hash"), first, n))
            step = F.struct(side(F.lit(1), F.col("spot")).alias("before"), side(F.col("spot") + 2, F.lit(self.fanout)).alias("after"))
            longer = F.concat(F.array(step), "path").alias("path")
            if level == 0:
                return spread.select("key", "kid.hash", *(f"kid.{c}" for c in carry), longer, *own)
            nodes = spread.select("key", "kid.idx", longer, *own).union(at(level))
        return None

    def leaves_with_paths(self, tops: DataFrame, *carry: str) -> DataFrame:
        """All leaves with their paths, also those that are their tree's only node."""
        own = [c for c in tops.columns if c not in ("key", "height")]
        alone = self.lone.join(tops.filter("height = 0").drop("height"), "key").select("key", "hash", *carry, *own)
        climbed = self.climb(tops, *carry)
        return alone if climbed is None else climbed.select(*alone.columns).union(alone)


def folded(leaf: Column, path: Column) -> Column:
    """The top that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``docs`` with a proof for each row, and what verification says of rows tampered with.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns are ignored. Returns doc_id, leaf, subroot, root,
    proof_sha256, folded_root and verified. Rows of one source ascend by doc_id, null first, and by leaf, so rows that are
    equal in all fields are leaves of their own with equal hashes; a null source is one of its own, before all others;
    a source of one row has its leaf as subroot; an empty table gives no rows. Sources and ids of any frequency are
    spread over tasks; what a task groups are ``fanout`` nodes.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("key")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(tampered(), leaf_of(text=lower)).alias("changed")
    leaves, leaf_path = stash(docs.select(*FIELDS).select(key, "doc_id", leaf_of().alias("hash"), changed))
    rows, row_path = numbered(leaves, F.col("doc_id").asc_nulls_first(), F.col("hash"))
    inner = Tree(rows, ("doc_id", "changed"), fanout)

    subroots, subroot_path = stash(inner.tops.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "height", "hash"))
    tops, top_path = numbered(subroots, F.col("source_key"))
    outer = Tree(tops, ("source_key", "height"), fanout)
    roots = outer.tops.select("key", F.col("height"), F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    above = outer.leaves_with_paths(roots, "source_key", "height")
    sources = above.select(F.col("source_key").alias("key"), "height", "path", F.col("hash").alias("subroot"), "root")
    found = inner.leaves_with_paths(sources, "doc_id", "changed")
    again = folded(F.coalesce("changed", "hash"), F.col("path"))
    result, _ = stash(found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root")))
    unstash(spark, leaf_path, row_path, subroot_path, top_path, *inner.paths, *outer.paths)
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c=c) for c in FIELDS)
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_UP = "select level + 1 as level, {key}idx // 16 as idx, any_value((n + 15) // 16) as n, sha256(string_agg(h, '' order by idx)) as h from {tree} where n > 1 group by level, {key}idx // 16"

#: CRC-32 goes byte by byte, with its table made from the reflected polynomial.
ORACLE = f"""
with recursive steps as (
  select range as i, 0 as k, cast(range as bigint) as v from range(256)
  union all select i, k + 1, case when v % 2 = 1 then xor(v >> 1, cast(3988292384 as bigint)) else v >> 1 end from steps where k < 8
),
crc as (select list(v order by i) as t from steps where k = 8),
texts as (select doc_id, source, sha256({_LEAF}) as leaf, sha256({_LEAF.replace("text", _LOWER)}) as other,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, y: xor(c >> 8, t[cast(xor(c & 255, y) as int) + 1])), cast(4294967295 as bigint)) as code
  from documents, crc),
leaves as (select row_number() over () as r, doc_id, leaf, case when code % 5 = 0 then other else leaf end as changed, coalesce('=' || source, '') as key,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from texts),
inner_tree as (select 0 as level, key, idx, n, leaf as h from leaves union all {_UP.format(key="key, ", tree="inner_tree")}),
subroots as (select key, level as height, h as subroot, row_number() over (order by key) - 1 as idx, count(*) over () as n from inner_tree where n = 1),
outer_tree as (select 0 as level, idx, n, subroot as h from subroots union all {_UP.format(key="", tree="outer_tree")}),
root as (select h as root from outer_tree where n = 1),
levels as (select range as level from range(20)),
beside as (
  select r, 0 as tree, level, t.idx < l.idx // pow(16, level)::bigint as ahead, t.idx, h from leaves l cross join levels join inner_tree t using (level, key)
    where t.idx // 16 = l.idx // pow(16, level + 1)::bigint and t.idx <> l.idx // pow(16, level)::bigint
  union all select r, 1, level, t.idx < s.idx // pow(16, level)::bigint, t.idx, h from leaves l join subroots s using (key) cross join levels join outer_tree t using (level)
    where t.idx // 16 = s.idx // pow(16, level + 1)::bigint and t.idx <> s.idx // pow(16, level)::bigint
),
proofs as (select r, sha256(string_agg(h, '' order by tree, level, idx)) as proof_sha256 from beside group by r),
heights as (select r, height, (select max(level) from outer_tree) as outer_height, subroot, changed from leaves join subroots using (key)),
sides as (
  select r, case when tree = 0 then level else height + level end as step, coalesce(string_agg(h, '' order by idx) filter (where ahead), '') as a, coalesce(string_agg(h, '' order by idx) filter (where not ahead), '') as b
  from beside join heights using (r) group by 1, 2
),
fold as (
  select r, 0 as step, changed as h from heights
  union all select f.r, f.step + 1, sha256(coalesce(a, '') || f.h || coalesce(b, '')) from fold f join heights using (r) left join sides s on s.r = f.r and s.step = f.step where f.step < height + outer_height
)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = root as verified
from leaves join heights using (r) join fold f using (r) cross join root left join proofs using (r) where f.step = height + outer_height
"""
