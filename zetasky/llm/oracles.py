"""DuckDB twins of the operators that SQL can express over whole tables."""

from __future__ import annotations

import string

from .sharding import N_SLOTS, PARTS

#: Words by ASCII lower case, and a row number: ids may repeat.
_WORDS = rf"""select row_number() over () as r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents"""

JACCARD = rf"""
with recursive words as ({_WORDS}),
sets as (
  select r, doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [list_aggregate(w, 'string_agg', ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end)) as s
  from words
),
kinds as (select row_number() over () as k, s, len(s) as n, min(doc_id) as least, count(*) as copies from sets where len(s) > 0 group by s),
held as (select k, n, unnest(s) as x from kinds),
shared as (select a.k as i, b.k as j, any_value(a.n) + any_value(b.n) as total, count(*) as common from held a join held b on a.x = b.x and a.k < b.k group by 1, 2),
links as (select i, j from shared where 100 * common >= 85 * (total - common)),
reach as (select k, k as o from kinds union select reach.k, e.j from reach join (select i, j from links union all select j, i from links) e on reach.o = e.i),
named as (select reach.k, min(least) as component_id from reach join kinds on kinds.k = reach.o group by 1)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, case when len(sets.s) = 0 then sets.doc_id else component_id end as component_id, cast(coalesce(copies, 1) as bigint) as n_copies
from sets left join kinds on kinds.s = sets.s left join named using (k)
"""

SUFFIXES = """
with texts as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
spots as (select r, doc_id, unnest(range(0, len(h) // 2 - 49)) as spot, h from texts where doc_id is not null and len(h) >= 100),
strings as (select r, doc_id, spot, substr(h, 2 * spot + 1, 100) as x from spots),
firsts as (select x, min(doc_id) as least from strings group by x having min(doc_id) < max(doc_id)),
hits as (select distinct r, spot from strings join firsts using (x) where doc_id > least),
marked as (select r, spot, case when spot > lag(spot) over (partition by r order by spot) + 50 or lag(spot) over (partition by r order by spot) is null then 1 else 0 end as fresh from hits),
numbered as (select r, spot, sum(fresh) over (partition by r order by spot rows unbounded preceding) as g from marked),
spans as (select r, g, min(spot) as a, max(spot) + 50 as b from numbered group by 1, 2),
gaps as (select r, a, b, lead(a) over (partition by r order by a) as next from spans),
tails as (select t.r, string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, len(h) // 2) - b)), '' order by a) as tail, min(a) as first, count(*) as n, sum(b - a) as removed from gaps join texts t using (r) group by t.r)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
  sha256(unhex(case when n is null then h else substr(h, 1, 2 * first) || tail end)) as kept_sha256
from texts left join tails using (r)
"""

#: CRC-32 goes byte by byte, with its table made from the reflected polynomial.
SHARDS = f"""
with recursive steps as (
  select range as i, 0 as k, cast(range as bigint) as v from range(256)
  union all select i, k + 1, case when v % 2 = 1 then xor(v >> 1, cast(3988292384 as bigint)) else v >> 1 end from steps where k < 8
),
crc as (select list(v order by i) as t from steps where k = 8),
bytes as (select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h, t from documents, crc),
codes as (select doc_id, b, t, list_transform(range(0, len(h) // 2), lambda i: cast(('0x' || substr(h, 2 * i + 1, 2)) as bigint)) as x from bytes),
sized as (
  select doc_id, cast(octet_length(b) + 1 as bigint) as size,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), x), lambda c, y: xor(c >> 8, t[cast(xor(c & 255, y) as int) + 1])), cast(4294967295 as bigint)) as text_crc32,
    cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 3)) as int) as vslot
  from codes
)
select doc_id, size, text_crc32, 'key' as law, cast(vslot % 16 as int) as shard,
  cast(row_number() over (partition by vslot % 16 order by vslot, text_crc32 % {PARTS}, doc_id nulls first, text_crc32, size) - 1 as bigint) as slot,
  cast(case when vslot >= {N_SLOTS - 16 * (N_SLOTS // 17 // 16)} then 16 else vslot % 16 end as int) as grown_shard,
  vslot, cast(sum(size) over (partition by vslot) as bigint) as slot_bytes, cast(1 as int) as map_version
from sized
"""
