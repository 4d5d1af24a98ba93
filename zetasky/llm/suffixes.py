"""Removal of repeated byte strings by sorting a sample of suffixes.

The difference-cover idea is to sort a sample of all suffixes chosen so that any two positions have sampled ones at
the same short distance, and to settle the rest through the sample. A cover fixed by position samples too densely
to be moved at this size, so the cover here is chosen by content: in every string of ``length`` bytes the least of
its gram hashes marks one sampled position. Equal strings mark the same place, so each string belongs to exactly
one sampled suffix, its anchor, at one distance.

1. Anchors' names are dealt in packed buckets; a name that one document alone holds is dropped there. The others are
   broadcast as a filter of bounded size, which may let some more through but none of them go.
2. The remaining anchors meet by name as hashes of their surroundings, the bytes of the strings they own. Equal
   surroundings hold equal strings, so all of them but the first document's are repeated whole; a task settles what it
   can before anything is sent, so a passage in very many documents is sent once by each slice of them. Different
   surroundings of one name can still share a string if they agree on one side of the anchor.
3. Decisions go back packed by slice and become merged ranges of each document and places that need a comparison. The
   bytes around those meet by name; the strings owned there are sorted, and adjacent ones compared byte by byte: a string
   is repeated if an equal one stands in a document with a smaller id. Names with very many different surroundings
   are compared by a join of their strings, which can be split.
4. A document's repeated strings are united and cut out.

Surroundings count as equal by 112 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_schema, pack48, runs, ship, sorted_groups, stash, unpack48, unstash, with_arrow

#: Bytes of a gram. Shorter grams are common by chance, longer ones leave fewer to choose an anchor from.
GRAM = 18
#: Bytes of text handled at once: some twenty arrays of eight bytes each stand beside a piece. Names that a task
#: packs together, and names in a bucket on average.
PIECE, PACKED_NAMES, BUCKET_NAMES = 300_000, 400_000, 1_000_000
LEAST_BUCKETS = 96
#: Bits of the filter of shared names that is broadcast, in all and in a bucket's part; shared names up to which it keeps
#: most others away, and with more of them all anchors meet.
FILTER_BITS, BUCKET_BITS, SHARED_BROADCAST = 2**29, 2**20, 300_000_000
#: Copies that are broadcast as ids; with more of them they are joined.
COPIES_BROADCAST = 500_000
#: Surroundings that a task compares at once, so many of one name too; a name with more is compared by a join.
COMPARED = COMMON_NAME = 30_000
#: Rows of documents in a slice.
SLICE_DOCS = 50_000

MULTIPLIER = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFF)
BYTE_CODES = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * PIECE)
            ones = np.ones(1, dtype=np.uint64)
            self.up, self.down = (np.cumprod(np.concatenate([ones, np.full(size - 1, m, dtype=np.uint64)])) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(MULTIPLIER)
    return h ^ h >> np.uint64(29)


def running_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * POWERS.of(len(data))[0], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``begin`` to ``end``, which may be clipped to what there is."""
    begin, end = np.maximum(begin, 0), np.minimum(end, len(sums) - 1)
    return mixed((sums[end] - sums[begin]) * POWERS.of(len(sums))[1][begin])


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` bytes, from differences of one running sum."""
    sums = running_sums(data)
    return mixed((sums[size:] - sums[:-size]) * POWERS.of(len(data))[1][: len(data) - size + 1])


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into arrays of about PIECE bytes, as (bytes, ends, text numbers, offsets); a text longer than
    that comes in parts that overlap by ``length`` - 1, so every string lies whole in exactly one part."""
    parts, numbers, offsets, size = [], [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            parts.append(part)
            numbers.append(number)
            offsets.append(at)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), np.array(numbers), np.array(offsets)
                parts, numbers, offsets, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), np.array(numbers), np.array(offsets)


def gram_size(length: int) -> int:
    return min(GRAM, max(1, length // 2))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors as (name, part, spot, first, last): the anchor owns the strings that start at first to last in ``data``."""
    gram = gram_size(length)
    h = window_hashes(data, gram)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    span, have = length - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    spot = (least & LOW).astype(np.int32)
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        spot[max(begin, end - length + 1) : end] = -1  # strings that cross the end of their part
    change = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    last = np.concatenate([change[1:], [len(spot)]]) - 1
    keep = spot[change] >= 0
    first, last = change[keep], last[keep]
    spot = spot[first]
    return h[spot] >> np.uint64(16), np.searchsorted(ends, first, side="right"), spot.astype(np.int64), first, last


def filter_bits(buckets: int) -> int:
    """Bits of a bucket's part of the filter, a power of two."""
    return max(8, min(BUCKET_BITS, 1 << (FILTER_BITS // buckets).bit_length() - 1))


def may_be_shared(name: np.ndarray, bits: np.ndarray, buckets: int) -> np.ndarray:
    """Whether the filter holds a name; it holds all shared ones and, by chance, some more."""
    each = 8 * len(bits) // buckets
    at = name % np.uint64(buckets) * np.uint64(each) + name // np.uint64(buckets) % np.uint64(each)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def name_filter(shared: DataFrame, buckets: int) -> np.ndarray:
    """The parts of all buckets, one after the other."""
    size = filter_bits(buckets) // 8
    out = np.zeros(buckets * size, dtype=np.uint8)
    for batch in shared.select("bucket", "bits").toArrow().to_batches():
        for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[bucket * size : (bucket + 1) * size] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    return out


def shared_names(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, n and bits: how many names of a bucket two documents or more may hold, and its part of their filter."""
    each = filter_bits(buckets)
    schema = arrow_schema("bucket int, once binary, often binary, n binary")

    def packed_names(held: list[np.ndarray]) -> pa.RecordBatch:
        name, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (name % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        name, n, bucket = name[order], n[order], bucket[order]
        present, cuts = np.unique(bucket, return_index=True)
        rows = [slice(i, j) for i, j in stretches(cuts, len(name))]
        once, often = ([pack48(name[s][(n[s] > 1) == many]) for s in rows] for many in (False, True))
        return pa.RecordBatch.from_arrays([pa.array(present), pa.array(once, pa.binary()), pa.array(often, pa.binary()), pa.array([n[s][n[s] > 1].astype("<u4").tobytes() for s in rows], pa.binary())], schema=schema)

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t.encode("utf-8", "replace") for t in batch.slice(at, 256).column(0).to_pylist()]
                for data, ends, _, _ in pieces(texts, length):
                    held.append(anchors(data, ends, length)[0])
                    size += len(held[-1])
                    if size >= PACKED_NAMES:
                        yield packed_names(held)
                        held, size = [], 0
        if size:
            yield packed_names(held)

    out_schema = arrow_schema("bucket int, n long, bits binary")

    def meet(batches):
        for (bucket,), rows in runs(batches, ["bucket"]):
            once, often = (unpack48(rows.column(c).to_pylist()) for c in ("once", "often"))
            n = np.concatenate([np.ones(len(once), dtype=np.int64), np.frombuffer(b"".join(rows.column("n").to_pylist()), dtype="<u4").astype(np.int64)])
            name, inverse = np.unique(np.concatenate([once, often]), return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(name)).astype(np.int64)
            name = name[total > 1]
            bits = np.zeros(each, dtype=bool)
            bits[name // np.uint64(buckets) % np.uint64(each)] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(name)], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], schema=out_schema)

    packed = with_arrow(docs.select("text"), pack, "bucket int, once binary, often binary, n binary")
    return sorted_groups(packed, ["bucket"], meet, "bucket int, n long, bits binary")


#: An anchor: its name with a hash of what is left of it in the upper bits, hashes of all surroundings and of what is right
#: of it, the document, and its place: row in the slice, first byte, bytes beyond one string.
ENTRY = np.dtype([("name", "<u8"), ("whole", "<u8"), ("right", "<u2"), ("doc", "<i8"), ("row", "<u2"), ("first", "<u4"), ("more", "<u2")])
PLACE = np.dtype([("row", "<u2"), ("first", "<u4"), ("more", "<u2")])
#: A place whose bytes need a comparison, and whether its name has very many surroundings.
SOUGHT = np.dtype([("row", "<u2"), ("first", "<u4"), ("more", "<u2"), ("name", "<u8"), ("manifold", "?")])
NAME = np.uint64(2**48 - 1)


def placed(entries: np.ndarray, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(entries), dtype=kind)
    for field in ("row", "first", "more"):
        out[field] = entries[field]
    return out


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of sorted columns starts."""
    change = np.zeros(len(columns[0]), dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def stretches(cuts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first, end) of the runs that start at ``cuts`` in ``n`` rows."""
    return list(zip(cuts.tolist(), np.append(cuts[1:], n).tolist(), strict=True)) if len(cuts) else []


def settled(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by name and surroundings, and which of them are repeated whole: a smaller document has the same."""
    name = entries["name"] & NAME
    entries = entries[np.lexsort((entries["doc"], entries["whole"], name))]
    head = starts_of(entries["name"] & NAME, entries["whole"])
    least = np.repeat(entries["doc"][head], np.diff(np.append(head, len(entries))))
    return entries, entries["doc"] > least


def found_anchors(texts: list[bytes], length: int, shared: np.ndarray | None, buckets: int):
    """(entries, text numbers) of the anchors of each piece of the texts, of names that the filter holds if there is one;
    row and doc are not set."""
    gram = gram_size(length)
    half = (length - gram + 1) // 2
    for data, ends, numbers, offsets in pieces(texts, length):
        name, part, spot, first, last = anchors(data, ends, length)
        if shared is not None:
            hit = may_be_shared(name, shared, buckets)
            name, part, spot, first, last = name[hit], part[hit], spot[hit], first[hit], last[hit]
        if not len(name):
            continue
        sums = running_sums(data)
        entries = np.empty(len(name), dtype=ENTRY)
        entries["name"] = name | range_hashes(sums, spot - half, spot + gram) >> np.uint64(48) << np.uint64(48)
        entries["whole"] = range_hashes(sums, first, last + length)
        entries["right"] = range_hashes(sums, spot, spot + gram + half) >> np.uint64(48)
        entries["first"] = first - np.concatenate([[0], ends[:-1]])[part] + offsets[part]
        entries["more"] = last - first
        yield entries, numbers[part]


DEALT = "slice long, bucket int, docs binary, entries binary, done binary"
DECIDED = "slice long, docs binary, whole binary, sought binary"


def decided(docs: DataFrame, length: int, buckets: int, known) -> DataFrame:
    """Packed by slice: its documents, places that are repeated whole, and places whose bytes need a comparison.

    ``known`` broadcasts the filter of shared names, or None for all. A slice's documents travel with one of its buckets.
    """
    schema, out_schema = arrow_schema(DEALT), arrow_schema(DECIDED)

    def packed(held: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        owners = np.concatenate(rows)
        number = xxhash.xxh3_64_intdigest(owners.tobytes()) >> 1
        entries, repeated = settled(np.concatenate(held))
        done, entries = placed(entries[repeated], PLACE), entries[~repeated]
        bucket = ((entries["name"] & NAME) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        present, cuts = np.unique(bucket[order], return_index=True)
        blobs = [entries[order[i:j]].tobytes() for i, j in stretches(cuts, len(order))]
        n = len(blobs)
        out = [[number] * (n + 1), [*present.tolist(), number % buckets], [None] * n + [owners.tobytes()], [*blobs, None], [None] * n + [done.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def pack(batches):
        shared = known.value
        held, rows, n_entries, n_rows = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = np.stack([part.column(i).to_numpy() for i in (0, 1)], axis=1).astype("<i8")
                rows.append(ids)
                for entries, number in found_anchors([t.encode("utf-8", "replace") for t in part.column(2).to_pylist()], length, shared, buckets):
                    entries["doc"], entries["row"] = ids[number, 0], number + n_rows
                    held.append(entries)
                    n_entries += len(entries)
                    if n_entries >= PACKED_NAMES:  # the rest of this part's texts go to the next slice with it
                        yield packed(held, rows)
                        held, rows, n_entries, n_rows = [], [ids], 0, 0
                n_rows += len(ids)
                if n_rows >= SLICE_DOCS:
                    if held:
                        yield packed(held, rows)
                    held, rows, n_entries, n_rows = [], [], 0, 0
        if held:
            yield packed(held, rows)

    def meet(batches):
        for _, rows in runs(batches, ["bucket"]):
            docs_rows = rows.filter(pc.is_valid(rows.column("docs")))
            yield from pa.table([docs_rows.column("slice"), docs_rows.column("docs"), docs_rows.column("done"), pa.nulls(docs_rows.num_rows, pa.binary())], schema=out_schema).to_batches()
            full = rows.filter(pc.is_valid(rows.column("entries")))
            blobs = full.column("entries").to_pylist()
            every = np.frombuffer(b"".join(blobs), dtype=ENTRY)
            if not len(every):
                continue
            origin = np.repeat(np.arange(len(blobs)), [len(b) // ENTRY.itemsize for b in blobs])
            name = every["name"] & NAME
            order = np.lexsort((every["doc"], every["whole"], name))
            entries, origin, name = every[order], origin[order], name[order]
            head = starts_of(name, entries["whole"])
            kind = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(entries))))
            repeated = entries["doc"] > entries["doc"][head][kind]
            # Of the different surroundings of a name, those that agree with others on a side.
            of, first = name[head], starts_of(name[head])
            kinds = np.diff(np.append(first, len(of)))
            group = np.repeat(np.arange(len(first)), kinds)
            low, high = (ends(entries["doc"], head[first]) for ends in (np.minimum.reduceat, np.maximum.reduceat))
            several = ((kinds > 1) & (low < high))[group]
            agrees = np.zeros(len(head), dtype=bool)
            for side in (entries["name"][head] >> np.uint64(48), entries["right"][head].astype(np.uint64)):
                rest = np.flatnonzero(several)
                rest = rest[np.lexsort((side[rest], of[rest]))]
                same = np.flatnonzero((of[rest][1:] == of[rest][:-1]) & (side[rest][1:] == side[rest][:-1]))
                agrees[rest[same]] = agrees[rest[same + 1]] = True
            compare = agrees[kind] & ~repeated
            sought = placed(entries[compare], SOUGHT)
            sought["name"], sought["manifold"] = name[compare], (kinds > COMMON_NAME)[group][kind][compare]
            for which, found, at in ((2, placed(entries[repeated], PLACE), origin[repeated]), (3, sought, origin[compare])):
                order = np.argsort(at, kind="stable")
                found, at = found[order], at[order]
                cuts = starts_of(at)
                out = [pa.array(full.column("slice").to_numpy()[at[cuts]]), *(pa.nulls(len(cuts), pa.binary()) for _ in range(3))]
                out[which] = pa.array([found[i:j].tobytes() for i, j in stretches(cuts, len(found))], pa.binary())
                yield pa.RecordBatch.from_arrays(out, schema=out_schema)

    packed_rows = with_arrow(docs.select("doc_id", "tid", "text"), pack, DEALT)
    return sorted_groups(packed_rows, ["bucket"], meet, DECIDED)


MARK = "doc_id long, tid long, first int, end int, sought binary"


def marks(decisions: DataFrame, length: int) -> DataFrame:
    """Ranges of documents that are repeated whole, merged, and, without a range, their places to compare."""
    schema = arrow_schema(MARK)

    def run(batches):
        for _, rows in runs(batches, ["slice"]):
            owners = np.frombuffer(next((d for d in rows.column("docs").to_pylist() if d), b""), dtype="<i8").reshape(-1, 2)
            whole, sought = (np.frombuffer(b"".join(x for x in rows.column(c).to_pylist() if x), dtype=kind) for c, kind in (("whole", PLACE), ("sought", SOUGHT)))
            # By row, then first byte, as one number: structured rows sort slowly.
            packed = np.unique(whole["row"].astype(np.uint64) << np.uint64(48) | whole["first"].astype(np.uint64) << np.uint64(16) | whole["more"])
            whole = np.empty(len(packed), dtype=PLACE)
            whole["row"], whole["first"], whole["more"] = packed >> np.uint64(48), packed >> np.uint64(16) & np.uint64(0xFFFFFFFF), packed & np.uint64(0xFFFF)
            if len(whole):
                end = whole["first"].astype(np.int64) + whole["more"] + length
                new = np.flatnonzero(np.concatenate([[True], (whole["row"][1:] != whole["row"][:-1]) | (whole["first"][1:] > end[:-1])]))
                last = np.append(new[1:], len(whole)) - 1
                ids = owners[whole["row"][new]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array(whole["first"][new].astype(np.int32)), pa.array(end[last].astype(np.int32)), pa.nulls(len(new), pa.binary())], schema=schema)
            if len(sought):
                sought = sought[np.argsort(sought["row"], kind="stable")]
                cuts = starts_of(sought["row"])
                ids = owners[sought["row"][cuts]]
                blobs = [sought[i:j].tobytes() for i, j in stretches(cuts, len(sought))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), *(pa.nulls(len(cuts), pa.int32()) for _ in range(2)), pa.array(blobs, pa.binary())], schema=schema)

    return sorted_groups(decisions, ["slice"], run, MARK)


ANCHOR_ROW = "name long, doc_id long, tid long, first int, context binary, manifold boolean"


def contexts(docs: DataFrame, sought: DataFrame, length: int) -> DataFrame:
    """The bytes around the places to compare."""
    schema = arrow_schema(ANCHOR_ROW)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                blobs = part.column(3).to_pylist()
                places = np.frombuffer(b"".join(blobs), dtype=SOUGHT)
                owner = np.repeat(np.arange(len(blobs)), [len(b) // SOUGHT.itemsize for b in blobs])
                begin, end = (x.tolist() for x in (places["first"], places["first"].astype(np.int64) + places["more"] + length))
                raw = [t.encode("utf-8", "replace") for t in part.column(2).to_pylist()]
                context = [raw[o][a:b] for o, a, b in zip(owner.tolist(), begin, end, strict=True)]
                doc_id, tid = (part.column(i).to_numpy()[owner] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(places["name"].astype(np.int64)), pa.array(doc_id, pa.int64()), pa.array(tid, pa.int64()), pa.array(places["first"].astype(np.int32)), pa.array(context, pa.binary()), pa.array(places["manifold"].copy())], schema=schema)

    return with_arrow(docs.select("doc_id", "tid", "text").join(sought, ["doc_id", "tid"]), run, ANCHOR_ROW)


def repeated_strings(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end): maximal runs of a row's strings that equal one in a row with a smaller doc_id."""
    contexts = rows.column("context").to_pylist()
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(contexts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[row] + within
    doc = rows.column("doc_id").to_numpy()[row]
    key = window_hashes(data, length)[at]
    order = np.lexsort((doc, key))
    key, at_sorted, doc_sorted = key[order], at[order], doc[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    window = np.lib.stride_tricks.sliding_window_view(data, length)
    blocks = np.array_split(np.flatnonzero(same), max(1, int(same.sum()) // 200_000))
    if not all((window[at_sorted[i]] == window[at_sorted[i - 1]]).all() for i in blocks):  # adjacent strings, byte by byte
        # Different strings have one hash: their ranks among all strings here take its place.
        key = np.unique(np.ascontiguousarray(window[at]).view(f"V{length}")[:, 0], return_inverse=True)[1].ravel()
        order = np.lexsort((doc, key))
        key, doc_sorted = key[order], doc[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    repeated = np.zeros(len(row), dtype=bool)
    repeated[order] = doc_sorted > doc_sorted[head]
    edge = repeated & ~np.concatenate([[False], repeated[:-1] & (row[1:] == row[:-1])])
    stop = repeated & ~np.concatenate([repeated[1:] & (row[1:] == row[:-1]), [False]])
    first, last = np.flatnonzero(edge), np.flatnonzero(stop)
    base = rows.column("first").to_numpy()[row[first]]
    return row[first], base + within[first], base + within[last] + length


RANGE_ROW = "doc_id long, tid long, first int, end int"


def compare_directly(rows: DataFrame, length: int) -> DataFrame:
    """Repeated ranges among anchors that meet by name, many names at once."""
    schema = arrow_schema(RANGE_ROW)

    def emit(tables):
        table = pa.concat_tables(tables)
        row, first, end = repeated_strings(table, length)
        return pa.RecordBatch.from_arrays([pa.array(table.column("doc_id").to_numpy()[row]), pa.array(table.column("tid").to_numpy()[row]), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], schema=schema)

    def run(batches):
        held, size = [], 0
        for _, group in runs(batches, ["name"]):
            if group.num_rows > 1:
                held.append(group)
                size += group.num_rows
            if size >= COMPARED:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return sorted_groups(rows, ["name"], run, RANGE_ROW)


def compare_by_join(rows: DataFrame, length: int) -> DataFrame:
    """Repeated ranges among anchors of names with very many surroundings, without gathering a name's rows anywhere."""
    start = F.explode(F.sequence(F.lit(0), F.octet_length("context") - length)).alias("start")
    strings = rows.select("doc_id", "tid", "first", "context", start).select("doc_id", "tid", (F.col("first") + F.col("start")).alias("first"), F.expr(f"substring(context, start + 1, {length})").alias("string"))
    strings, _ = stash(strings)
    earliest = strings.groupBy("string").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("earliest < latest").select("string", "earliest")
    return strings.join(earliest, "string").filter("doc_id > earliest").select("doc_id", "tid", "first", (F.col("first") + length).cast("int").alias("end"))


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """Cut out every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id and text (UTF-8 bytes; null: empty); other columns are ignored. Strings are judged on the
    input and never cross documents; overlaps count. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, ``with_text``, kept as binary; a row for each row of ``docs``. A row with a null id is
    neither cut nor a reason to cut; rows with one id never cut each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    usable = texts.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))

    # Whole copies need no anchors: all of a copy starts in its first document.
    digest = usable.select("doc_id", "tid", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    firsts, _ = stash(digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.sum("size").alias("size")))
    copies, _ = stash(digest.join(firsts.filter("n > 1"), "digest").filter("doc_id > least").select("doc_id", "tid").distinct())
    few = copies.count() <= COPIES_BROADCAST
    fresh = usable.join(F.broadcast(copies) if few else copies, ["doc_id", "tid"], "left_anti")
    total = firsts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    buckets = max(LEAST_BUCKETS, int(total / 16 / BUCKET_NAMES))
    shared, shared_path = stash(shared_names(fresh, length, buckets))
    n_shared = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = spark.sparkContext.broadcast(name_filter(shared, buckets) if n_shared <= SHARED_BROADCAST else None)
    found, _ = stash(marks(decided(fresh, length, buckets, known), length))
    rows, _ = stash(contexts(fresh, found.filter("sought is not null").select("doc_id", "tid", "sought"), length))
    direct = compare_directly(rows.filter("not manifold").drop("manifold"), length)
    apart = compare_by_join(rows.filter("manifold"), length)
    every = found.filter("sought is null").select("doc_id", "tid", "first", "end").unionByName(direct).unionByName(apart)
    unstash(spark, shared_path)
    ranges = every.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    all_of_it = copies.select("doc_id", "tid", F.array(F.struct(F.lit(0).alias("first"), F.lit(2**31 - 1).alias("end"))).alias("ranges"))
    cuts = ranges.unionByName(all_of_it)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    schema = arrow_schema(ddl)

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for doc_id, text, ranges in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw, kept, done, spans = text.encode("utf-8", "replace"), [], 0, 0
                    for a, b in sorted((r["first"], min(r["end"], len(raw))) for r in ranges or ()):
                        if a > done or spans == 0:
                            kept.append(raw[done:a])
                            spans += 1
                        done = max(done, b)
                    kept = b"".join([*kept, raw[done:]])
                    out.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return with_arrow(texts.join(cuts, ["doc_id", "tid"], "left").select("doc_id", "text", "ranges"), cut, ddl)
