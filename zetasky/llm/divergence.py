"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Terms are hashed into shards by (language, term), and each shard is worked off by an in-process DuckDB inside the Spark
task that holds it: vectorised SQL counts terms, keeps the common ones, and sums what the shard's terms add to every
pair of sources. Spark deals the shards, merges the sums and ranks.

Two sources that lack a term differ by a constant, so only terms that both sources have are compared one by one: with z
the share of a term that a source lacks, A and B the terms of sources a and b, and V the number of kept terms,

    sum |pa - pb| = sum over A and B of (|pa - pb| - |pa - zb| - |za - pb| + |za - zb|)
                    + sum over A of |pa - zb| + sum over B of |za - pb| + (V - |A| - |B|) |za - zb|

and the sums over A need no more of it than how many of its terms occur how often.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import stash, unstash, with_arrow

#: What a term is, the documents that it needs, the share's unit and its smoothing, and ranks of a report.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, UNIT, SMOOTH, MOST_TERMS = 30, 1_000_000_000, 5, 50

#: Rows and bytes of text that DuckDB is given at a time, characters beyond which a text comes in pieces, rows that it holds before
#: they are merged or sent, its memory.
SLICE_ROWS, SLICE_BYTES, SLICE_CHARS, HELD_ROWS, MEMORY = 2048, 4 << 20, 1 << 20, 250_000, "768MB"
#: Parts over which a language's occurrence counts are spread where they meet the other sources.
SPREAD = 64


class Shard:
    """A DuckDB of one thread and bounded memory, which never spills to the machine's disk."""

    def __enter__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        return self

    def __exit__(self, *_):
        self.db.close()

    def run(self, query: str, values: dict | None = None, **tables) -> None:
        for name, table in tables.items():
            self.db.register(name, table)
        self.db.execute(query, values).fetchall()
        for name in tables:
            self.db.unregister(name)

    def rows(self, query: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        yield from self.db.sql(query).to_arrow_table().cast(schema).to_batches()

    def held(self, table: str) -> int:
        return self.db.execute(f"select count(*) from {table}").fetchall()[0][0]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in parts of at most SLICE_ROWS and SLICE_BYTES of text; one that may be longer than SLICE_CHARS is a part of
    its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > SLICE_BYTES or i - start == SLICE_ROWS or max(size, sizes[i - 1]) > SLICE_CHARS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


COUNTED = "lang string, source string, term string, docs long, n long"
SUMMED = "select lang, source, term, sum(docs)::bigint as docs, sum(n)::bigint as n from found group by all"
_TERMS = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) as term"
COUNT = f"""
insert into found
select lang, source, term, count(*), sum(n) from (
  select spot, any_value(lang) as lang, any_value(source) as source, term, count(*) as n
  from (select spot, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS} from part)
  group by spot, term)
group by lang, source, term
"""
#: The same of one text that comes in pieces.
COUNT_PIECE = f"insert into piece select term, count(*) from (select {_TERMS} from part) group by term"
COUNT_WHOLE = "insert into found select coalesce($lang, ''), coalesce($source, ''), term, 1, sum(n) from piece group by term"
GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about SLICE_CHARS, cut between terms."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + SLICE_CHARS)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of plain columns; tasks have no session that could parse them."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of each (lang, source, term) of a task's documents, merged before they are shuffled."""
    schema = schema_of(COUNTED)
    with Shard() as shard:
        shard.run("create table found (lang varchar, source varchar, term varchar, docs bigint, n bigint)")
        for batch in batches:
            for part in slices(batch):
                if part.num_rows == 1 and part.column("text")[0].is_valid and len(text := part.column("text")[0].as_py()) > SLICE_CHARS:
                    shard.run("create or replace table piece (term varchar, n bigint)")
                    for piece in pieces(text):
                        shard.run(COUNT_PIECE, part=pa.table({"text": [piece]}))
                        if shard.held("piece") >= HELD_ROWS:
                            shard.run("create or replace table piece as select term, sum(n)::bigint as n from piece group by term")
                    shard.run(COUNT_WHOLE, {c: part.column(c)[0].as_py() for c in ("lang", "source")})
                else:
                    shard.run(COUNT, part=pa.Table.from_batches([part.append_column("spot", pa.array(range(part.num_rows)))]))
                if shard.held("found") >= HELD_ROWS:
                    yield from shard.rows(SUMMED, schema)
                    shard.run("truncate found")
        yield from shard.rows(SUMMED, schema)


def whole_terms(shard: Shard, batches: Iterator[pa.RecordBatch], merge: str | None = None) -> Iterator[None]:
    """Give the rows of batches sorted by (lang, term) to the table ``ready``, some HELD_ROWS at a time and no term in parts.

    The last term of what is held waits for its other rows; those are merged by ``merge``, so that a term that every
    task has counted stays small.
    """
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_ROWS):
            part = batch.slice(at, HELD_ROWS)
            shard.run("create table if not exists found as select * from part limit 0; insert into found select * from part", part=pa.Table.from_batches([part]))
            held += part.num_rows
            if held >= HELD_ROWS:
                last = {c: part.column(c)[part.num_rows - 1].as_py() for c in ("lang", "term")}
                shard.run("create or replace table ready as select * from found where lang <> $lang or term <> $term", last)
                shard.run(f"create or replace table stay as select * from ({merge or 'from found'}) where lang = $lang and term = $term", last)
                shard.run("drop table found; alter table stay rename to found")
                yield
                held = 0
    if shard.held("duckdb_tables() where table_name = 'found'"):
        shard.run("create or replace table ready as select * from found")
        yield


KEPT = "lang string, source string, term string, n long, in_lang long, first int"
KEEP = f"""
select lang, source, term, n, (sum(n) over own)::bigint as in_lang, (row_number() over (partition by lang, term order by source) = 1)::int as first
from ({SUMMED.replace("found", "ready")}) window own as (partition by lang, term) qualify sum(docs) over own >= {LEAST_DOCS}
"""


def keep_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms that enough documents of their language hold, from partial counts sorted by (lang, term)."""
    schema = schema_of(KEPT)
    with Shard() as shard:
        for _ in whole_terms(shard, batches, SUMMED):
            yield from shard.rows(KEEP, schema)


def share_sql(n: str, total: str) -> str:
    return f"(1 + {UNIT}::hugeint * ({n} + {SMOOTH}) // ({total} + {SMOOTH} * kinds))"


PARTS = "lang string, source string, part string, item string, value long"
SHARES = f"select lang, source, term, n, {share_sql('n', 'total')} as p, {share_sql('0', 'total')} as z, {share_sql('in_lang', 'lang_total')} as q from ready"
BOTH = "abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)"
TOP = f"qualify row_number() over (partition by lang, source order by value desc, item) <= {MOST_TERMS}"


def compare_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms of a task add to the pairs of sources, and its foremost terms of each source."""
    schema = schema_of(PARTS)

    def send(last: bool) -> Iterator[pa.RecordBatch]:
        shard.run(f"create or replace table term as select * from term {TOP}")
        shard.run("create or replace table pair as select lang, source, item, sum(value)::hugeint as value from pair group by all")
        for part in ("pair", "term"):
            if last or shard.held(part) >= HELD_ROWS:
                yield from shard.rows(f"select lang, source, '{part}' as part, item, value::bigint as value from {part}", schema)
                shard.run(f"truncate {part}")

    with Shard() as shard:
        shard.run("create table pair (lang varchar, source varchar, item varchar, value hugeint); create table term (lang varchar, source varchar, item varchar, value bigint)")
        for _ in whole_terms(shard, batches):
            shard.run(f"create or replace table shares as {SHARES}")
            shard.run(f"insert into pair select a.lang, a.source, b.source, sum({BOTH}) from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all")
            shard.run(f"insert into term select lang, source, term as item, (p - q)::bigint as value from shares where p > q {TOP}")
            yield from send(False)
        yield from send(True)


def share(n: str, total: str) -> Column:
    """p of ``n`` occurrences among ``total``, in exact decimals; 0 where the language keeps no term."""
    ratio = f"(cast({UNIT} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(20,0))) div cast({total} + {SMOOTH} * kinds as decimal(20,0))"
    return F.expr(f"case when kinds > 0 then 1 + {ratio} else cast(0 as bigint) end")


def audit_sources(docs: DataFrame) -> DataFrame:
    """Compare every source of every language with the language's others and with the language as a whole.

    ``docs`` needs text, lang and source; other columns are ignored, and nulls are read as empty strings. Returns lang,
    source, part, item, value and rank: part ``pair`` has every other source of the language by distance of term shares,
    part ``term`` the up to MOST_TERMS terms that the source overuses most. A group without terms has all counts 0, a
    language without kept terms distances of 0, equal values are ranked by item; repeated rows count each; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text"), F.col("lang"), F.col("source"))
    sharded = lambda df: df.repartition("lang", "term").sortWithinPartitions("lang", "term")
    kept, kept_path = stash(with_arrow(sharded(with_arrow(texts, count_terms, COUNTED)), keep_common, KEPT))
    read = lambda c: F.coalesce(c, F.lit("")).alias(c)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    langs = kept.filter("first = 1").groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kinds"))
    zero = lambda *names: {c: F.coalesce(c, F.lit(0)).cast("long") for c in names}
    found = docs.select(read("lang"), read("source")).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups, groups_path = stash(found.withColumns(zero("total", "own", "lang_total", "kinds")).withColumn("z", share("0", "total")))

    rows = kept.join(groups.select("lang", "source", "total", "lang_total", "kinds"), ["lang", "source"])
    parts, parts_path = stash(with_arrow(sharded(rows.select("lang", "source", "term", "n", "in_lang", "total", "lang_total", "kinds")), compare_sources, PARTS))

    # every source meets the language's others by (lang, spread): a language of many sources is dealt over SPREAD tasks
    apart = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int").alias("spread")
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("own_b"), F.col("z").alias("z_b"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    often = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups.select("lang", "source", "total", "kinds"), ["lang", "source"])
    often = often.select("lang", "source", "times", share("n", "total").alias("p"), apart("source", "n"))
    lacking = often.join(other, ["lang", "spread"]).filter("source <> item").groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("z_b"))).alias("value"))
    every = groups.select("lang", "source", "kinds", "own", "z", apart("source")).join(other, ["lang", "spread"]).filter("source < item")
    neither = every.select("lang", "source", "item", ((F.col("kinds") - F.col("own") - F.col("own_b")) * F.abs(F.col("z") - F.col("z_b"))).alias("value"))
    both = parts.filter("part = 'pair'").select("lang", "source", "item", "value")
    once = neither.union(lacking).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = once.select("lang", F.explode(ends).alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    ranked = pairs.withColumn("rank", place).union(terms.withColumn("rank", place).filter(F.col("rank") <= MOST_TERMS))
    result, _ = stash(ranked)
    unstash(spark, kept_path, groups_path, parts_path)
    return result


_SHARE = f"1 + 1000000000::hugeint * ({{n}} + {SMOOTH}) // ({{total}} + {SMOOTH} * kinds)"

ORACLE = f"""
with texts as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t from documents),
words as (select r, any_value(lang) as lang, any_value(source) as source, term, count(*) as n from (select r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) as term from texts) group by r, term),
kept as (select lang, term, sum(n) as in_lang from words group by all having count(*) >= {LEAST_DOCS}),
langs as (select lang, count(*) as kinds, sum(in_lang) as lang_total from kept group by lang),
counts as (select lang, source, term, sum(n) as n from words join kept using (lang, term) group by all),
groups as (select lang, source, coalesce(total, 0) as total, kinds, lang_total from (select distinct lang, source from texts) left join (select lang, source, sum(n) as total from counts group by all) using (lang, source) left join langs using (lang)),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {_SHARE.format(n='coalesce(c.n, 0)', total='g.total')} as p, {_SHARE.format(n='k.in_lang', total='g.lang_total')} as q
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from shares where n > 0 and p > q
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= {MOST_TERMS}
"""
