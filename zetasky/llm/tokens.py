"""Token counts through a two-tier lookup of pre-token lengths, all on the map side.

Tier one is a compact table of frequent pre-tokens and their lengths, broadcast to every task; its size is bounded
by ``table_size`` whatever the input. Tier two is a bounded cache in each Python worker, filled by the library.
The table comes from mergeable heavy-hitter summaries of all documents: one bounded summary for each task, merged
in a tree, so no pre-token is ever shuffled. What is in either tier decides the speed and never the counts.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_columns, ship, with_arrow

#: Entries of a worker's cache and the longest pre-token that it or the table holds.
CACHE_SIZE, CACHED_CHARS = 300_000, 48
#: Summaries that one task merges.
FAN_IN = 24

#: A pre-token is a run of spaces with what follows up to the next space or line end, or a line end.
PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")


@lru_cache(maxsize=2)
def load_model(data: bytes) -> sentencepiece.SentencePieceProcessor:
    """The processor, after a proof that its merges never cross a pre-token border.

    No piece may hold a space mark behind another character, nor a line end: then no merge can join two
    pre-tokens and the count of a text is the sum of theirs.
    """
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            if "\n" in piece or "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} crosses a pre-token border")
    if model.encode("\n", out_type=str) != ["▁", "<0x0A>"]:
        raise ValueError("the model's normaliser changes line ends or the leading space mark")
    return model


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text with the model's leading space; the space mark itself counts as a space."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def piece_length(model: sentencepiece.SentencePieceProcessor, pre_token: str) -> int:
    """Tokens of a pre-token inside a text: a line end before it keeps the model's own leading space apart."""
    return len(model.encode("\n" + pre_token, num_threads=1)) - 2


class Lengths(dict):
    """Tier one; a miss goes to tier two, and a miss there to the library."""

    def __init__(self, table: dict[str, int], model):
        super().__init__(table)
        self.model, self.cache = model, {}

    def __missing__(self, pre_token: str) -> int:
        n = self.cache.get(pre_token)
        if n is None:
            n = piece_length(self.model, pre_token)
            if len(pre_token) <= CACHED_CHARS:
                if len(self.cache) >= CACHE_SIZE:
                    self.cache.clear()
                self.cache[pre_token] = n
        return n


def _shrink(counts: Counter, size: int) -> Counter:
    """The ``size`` largest counters, less the next one's count: a mergeable summary of bounded error."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    floor = top[-1][1]
    return Counter({k: v - floor for k, v in top[:-1] if v > floor})


def frequent_pre_tokens(docs: DataFrame, size: int) -> list[str]:
    """Pre-tokens that take the largest shares of all texts; at most ``size`` of them reach the driver."""
    pack = lambda c: zlib.compress(pickle.dumps(dict(c)), 1)

    def summarise(batches):
        counts, seen = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                counts.update(p for p in pre_tokens(text.as_py() or "") if len(p) <= CACHED_CHARS)
                if len(counts) > 16 * size:
                    counts = _shrink(counts, size)
                seen = 1
        if seen:
            yield pa.RecordBatch.from_pydict({"summary": [pack(_shrink(counts, size))]})

    def merge(table: pa.Table) -> pa.Table:
        counts = Counter()
        for packed in table.column("summary"):
            counts.update(pickle.loads(zlib.decompress(packed.as_py())))
        return pa.table({"summary": pa.array([pack(_shrink(counts, size))], pa.binary())})

    tasks = max(1, docs.rdd.getNumPartitions())
    level = with_arrow(docs.select("text"), summarise, "summary binary")
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        level = level.groupBy((F.monotonically_increasing_id() / F.lit(2**33)).cast("long") % tasks).applyInArrow(merge, "summary binary")
    counts = Counter()
    for row in level.toLocalIterator():
        counts = _shrink(counts + Counter(pickle.loads(zlib.decompress(bytes(row.summary)))), size)
    return [p for p, _ in counts.most_common(size)]


def count_tokens(docs: DataFrame, model_path: str, token_limit: int = 4096, table_size: int = 8192) -> DataFrame:
    """Tokens of every whole text as the sentencepiece library counts them, without added tokens.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_bytes (UTF-8), n_tokens and
    over_limit (n_tokens > ``token_limit``). A null text is an empty one: no bytes, no tokens, not over the limit.
    Rows with equal or null ids are kept each; an empty table gives no rows. Two narrow passes over the scan.
    """
    ship(docs.sparkSession)
    with open(model_path, "rb") as file:
        data = file.read()
    model = load_model(data)
    context = docs.sparkSession.sparkContext
    table = context.broadcast({p: piece_length(model, p) for p in frequent_pre_tokens(docs, table_size)})
    proto = context.broadcast(data)

    def make():
        lengths = Lengths(table.value, load_model(proto.value))

        def run(doc_id, text):
            n = [sum(map(lengths.__getitem__, pre_tokens(t or ""))) for t in text]
            return {"doc_id": doc_id, "n_bytes": [len((t or "").encode("utf-8")) for t in text], "n_tokens": n, "over_limit": [k > token_limit for k in n]}

        return run

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
