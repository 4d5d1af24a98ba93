"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark item may differ from a passage by an error budget of edits. It is split into one piece more than
the budget, so at least one piece survives unchanged; an Aho-Corasick automaton finds exact piece hits, and Myers'
bit-parallel algorithm verifies the edit distance around each hit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right, insort

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import annotate, free_name, stash, unstash

NOT_WORD = re.compile(r"[\W_]+")
#: Characters of normalised items that one pass over the documents takes, for which a worker holds some 310 MB; more items mean
#: more passes.
PASS_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower-case words with single spaces, also at both ends; empty without a word."""
    words = NOT_WORD.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if words else ""


def split_pieces(item: str, budget: int) -> list[tuple[str, int]]:
    """``budget`` + 1 pieces of nearly equal length with their offsets."""
    n, parts = len(item), budget + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class MyersMatcher:
    """Least edit distance of a pattern to any substring of a text, bit-parallel over the pattern."""

    def __init__(self, pattern: str):
        self.size, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best = score
        for c in text:
            match = self.masks.get(c, 0)
            diagonal = (((match & plus) + plus) ^ plus) | match | minus
            up, down = minus | ~(diagonal | plus) & full, plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                best = min(best, score)
            up, down = up << 1 & full, down << 1 & full  # a match may start anywhere, so no carry comes in
            plus, minus = down | ~(diagonal | up) & full, up & diagonal
        return best


class PackedMatcher:
    """Myers' algorithm for many patterns at once: they lie in one long integer with a free bit between them, which takes the
    carries that would go from one to the next."""

    def __init__(self, patterns: list[str], budgets: list[int]):
        self.masks, at, self.full = {}, 0, 0
        places: dict[str, list[int]] = {}
        starts, ends = [], []
        for p in patterns:
            for i, c in enumerate(p):
                places.setdefault(c, []).append(at + i)
            self.full |= (1 << len(p)) - 1 << at
            starts.append(at)
            at += len(p) + 1
            ends.append(at - 1)
        for c, spots in places.items():
            bits = np.zeros(at, np.uint8)
            bits[spots] = 1
            self.masks[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        self.bytes, self.starts, tops = (at + 7) // 8, np.array(starts), np.array(ends) - 1
        self.tops, self.byte, self.shift = sum(1 << int(t) for t in tops), tops >> 3, (tops & 7).astype(np.uint8)
        self.quiet = min(len(p) - b for p, b in zip(patterns, budgets, strict=True)) - 1

    def heights(self, plus: int, minus: int) -> np.ndarray:
        """Each pattern's distance at this place: what its column rises by from bottom to top."""
        ups, downs = (np.unpackbits(np.frombuffer(b.to_bytes(self.bytes, "little"), np.uint8), bitorder="little") for b in (plus, minus))
        return np.add.reduceat(ups.astype(np.int64) - downs, self.starts)

    def distances(self, text: str) -> np.ndarray:
        """Each pattern's least edit distance to any substring of the text; where that exceeds its budget, some greater number.

        Before a text has as many characters as a pattern without its budget, no distance is within it, so none is read.
        """
        full, tops, plus, minus = self.full, self.tops, self.full, 0
        pick = lambda bits: np.frombuffer(bits.to_bytes(self.bytes, "little"), np.uint8)[self.byte] >> self.shift & 1
        score = best = None
        for i, c in enumerate(text):
            match = self.masks.get(c, 0)
            diagonal = (((match & plus) + plus) ^ plus | match | minus) & full
            up, down = minus | ~(diagonal | plus) & full, plus & diagonal
            if score is not None:
                rise, fall = up & tops, down & tops
                if rise:
                    score = score + pick(rise)
                if fall:
                    score = score - pick(fall)
                    best = np.minimum(best, score)
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(diagonal | up) & full, up & diagonal
            if score is None and i + 1 >= self.quiet:
                score = best = self.heights(plus, minus)
        return best if best is not None else self.heights(plus, minus)


#: Characters of items whose distances are found together; with fewer items than this each is looked at by itself.
PACK_CHARS, LEAST_PACKED = 131_072, 3


class Group:
    """Items that own the same pieces, with a piece at the same place in each: where one is looked for, all are."""

    def __init__(self, numbers: tuple[int, ...], items: list):
        self.numbers, self.tried, self.packs = numbers, [], None
        self.budget, self.size = max(items[n][2] for n in numbers), max(len(items[n][1]) for n in numbers)
        self.least = min(items[n][2] for n in numbers)

    def fresh(self, begin: int) -> bool:
        """Whether no window so far covers items that begin there; if so, this one will."""
        at = bisect_right(self.tried, (begin, math.inf))
        if at and self.tried[at - 1][1] >= begin:
            return False
        span = begin - self.least, begin + self.least
        insort(self.tried, span)
        if len(self.tried) > 1:  # spans that meet become one
            joined = []
            for a, b in self.tried[max(0, at - 1) : at + 2]:
                if joined and a <= joined[-1][1] + 1:
                    joined[-1] = joined[-1][0], max(b, joined[-1][1])
                else:
                    joined.append((a, b))
            self.tried[max(0, at - 1) : at + 2] = joined
        return True

    def distances(self, items: list, window: str):
        """(number, least distance to the window) of every item."""
        if len(self.numbers) < LEAST_PACKED:
            for n in self.numbers:
                yield n, items[n][3].distance(window)
            return
        packed = lambda part: PackedMatcher([items[m][1] for m in part], [items[m][2] for m in part])
        if self.packs is None:
            self.packs, part, chars = [], [], 0
            for n in self.numbers:
                if part and chars + len(items[n][1]) > PACK_CHARS:
                    self.packs.append((part, packed(part)))
                    part, chars = [], 0
                part.append(n)
                chars += len(items[n][1])
            self.packs.append((part, packed(part)))
        for part, matcher in self.packs:
            yield from zip(part, matcher.distances(window).tolist(), strict=True)


class ItemMatcher:
    """Finds the items that a text holds within their budgets."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items, pieces, groups = [], {}, {}
        for item_id, raw in items:
            if item := normalise(raw):
                budget = math.floor(error_rate * len(item))
                self.items.append((item_id, item, budget, MyersMatcher(item)))
                for piece, at in split_pieces(item, budget):
                    pieces.setdefault(piece, {}).setdefault(at, []).append(len(self.items) - 1)
        self.trie, self.empty = ahocorasick.Automaton(), not pieces
        for piece, owners in pieces.items():
            found = []
            for at, numbers in owners.items():
                numbers = tuple(numbers)
                found.append((at, groups.setdefault(numbers, Group(numbers, self.items))))
            self.trie.add_word(piece, (len(piece), found))
        if pieces:
            self.trie.make_automaton()

    def find(self, raw: str | None) -> dict[int, int]:
        """Item id to least edit distance, for the items within budget."""
        text, found, used = normalise(raw), {}, {}
        if not text or self.empty:
            return found
        for end, (size, owners) in self.trie.iter(text):
            for at, group in owners:
                begin = end - size + 1 - at  # where the items would start without an edit
                used[id(group)] = group
                if not group.fresh(begin):
                    continue
                only = self.items[group.numbers[0]]
                if len(group.numbers) == 1 and (found.get(only[0]) == 0 or text.startswith(only[1], max(0, begin))):
                    found[only[0]] = 0
                    continue
                # An item within budget that holds this piece starts at most ``budget`` from ``begin``; the window is
                # wide enough for every hit whose own start is as near again, so those need no look of their own.
                window = text[max(0, begin - 3 * group.budget) : max(0, begin + group.size + 3 * group.budget)]
                for number, distance in group.distances(self.items, window):
                    item_id, _, budget, _ = self.items[number]
                    if distance <= budget:
                        found[item_id] = min(distance, found.get(item_id, distance))
        for group in used.values():
            group.tried = []
        return found


def with_hits(docs: DataFrame, benchmark: DataFrame, error_rate: float, hits: str) -> DataFrame:
    """``docs`` with a column ``hits``: the items that each text holds, as id:distance, comma-joined.

    Each pass is a job of its own that writes its rows to the shared folder, so a worker holds one pass's automaton.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / PASS_CHARS))
    result, more, before = docs, free_name(docs, hits + "_more"), None
    for k in range(passes):
        part = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        shared = spark.sparkContext.broadcast(part)

        def make(shared=shared):
            matcher = ItemMatcher(shared.value, error_rate)
            return lambda text: {(more if k else hits): [",".join(f"{i}:{d}" for i, d in matcher.find(t).items()) for t in text]}

        result = annotate(result, ["text"], f"`{more if k else hits}` string", make)
        if k:
            result = result.withColumn(hits, F.concat_ws(",", F.nullif(hits, F.lit("")), F.nullif(more, F.lit("")))).drop(more)
        if k < passes - 1:
            result, path = stash(result)
            if before:
                unstash(spark, before)
            before = path
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05) -> DataFrame:
    """Which documents hold which benchmark items, each within ``error_rate`` edits a character.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Texts are compared
    as lower-case words. Returns doc_id, contaminated, n_items, item_ids (ascending, comma-joined) and
    least_distance (null without a match), a row for each row of ``docs``. Null or wordless texts match nothing, as
    do null or wordless items; repeated items count by id; an empty benchmark leaves every document clean. Items go
    to the tasks in passes of at most PASS_CHARS characters, so what is broadcast is bounded; documents never move.
    """
    pairs = F.expr("transform(filter(split(hits, ','), h -> h <> ''), h -> struct(cast(split(h, ':')[0] as long) as id, cast(split(h, ':')[1] as int) as distance))")
    ids = F.array_sort(F.array_distinct(F.col("p.id")))
    found = with_hits(docs.select("doc_id", "text"), benchmark, error_rate, "hits").select("doc_id", pairs.alias("p"))
    return found.select("doc_id", (F.size("p") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.array_min("p.distance").alias("least_distance"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    hits = free_name(docs, "hits")
    return with_hits(docs, benchmark, error_rate, hits).filter(F.col(hits) == "").drop(hits)
