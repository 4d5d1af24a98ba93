"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that a pyahocorasick automaton over the vocabulary finds, in one pass,
the longest token that starts at each byte. The encoder takes longest matches and steps back to shorter ones
where two adjacent tokens could not both have survived the merges; that test depends on the two tokens alone and
is memoised. A position from which no encoding continues is marked once, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .util import map_columns

#: Bounds of the workers' caches, in entries; they are emptied when full, which never changes a result.
CACHE_PIECES, CACHE_PAIRS, CACHED_PIECE_CHARS = 300_000, 1_000_000, 48


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The token ranks in the bytes of a rank file: base64 token and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder for a rank vocabulary that holds all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = max(self.token) + 1
        self.length = [0] * self.size
        self.shorter = [-1] * self.size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * self.size
        self.pairs: dict[int, bool] = {}
        self.trie = ahocorasick.Automaton()
        for rank in sorted(self.token):
            token = self.token[rank]
            self.length[rank] = len(token)
            self.trie.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            self.halves[rank] = self._last_merge(rank, token)
        self.trie.make_automaton()

    def _last_merge(self, rank: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (itself, itself) for a byte or a token no merge makes."""
        for n in range(1, len(token)):
            left, right = self.ranks.get(token[:n], rank), self.ranks.get(token[n:], rank)
            if left < rank and right < rank and self._survive(left, right, rank):
                return left, right
        return rank, rank

    def _survive(self, left: int, right: int, limit: int) -> bool:
        """Whether the merges below ``limit`` leave ``left`` and ``right`` side by side.

        Undo the later of the two last merges again and again; the pair falls if, before that merge took place,
        the tokens then at the border would have merged with each other (at equal ranks the left one goes first).
        """
        token, ranks, halves = self.token, self.ranks, self.halves
        while True:
            across = ranks.get(token[left] + token[right])
            if across is not None and across < limit:
                return False
            whole_left, whole_right = halves[left][0] == left, halves[right][0] == right
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                limit, left = min(limit, left), halves[left][1]
            else:
                limit, right = min(limit, right + 1), halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._survive(left, right, self.size)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; a piece that is itself a token is that token."""
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        length, shorter, size = self.length, self.shorter, len(piece)
        longest = [-1] * size
        for end, rank in self.trie.iter(piece.decode("latin-1")):
            longest[end - length[rank] + 1] = rank  # ends only grow, so the last one written is the longest
        dead, out, at, rank = bytearray(size + 1), [], 0, longest[0]
        while at < size:
            while rank >= 0 and (dead[at + length[rank]] or (out and not self.compatible(out[-1], rank))):
                rank = shorter[rank]
            if rank >= 0:
                out.append(rank)
                at += length[rank]
                rank = longest[at] if at < size else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                rank = shorter[last]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PieceCache(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= CACHED_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def worker_cache(data: bytes) -> PieceCache:
    """One encoder and cache for each vocabulary in a Python worker, kept from task to task."""
    return PieceCache(ByteBPE(read_ranks(data)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``docs`` needs doc_id and text; other columns are ignored. ``ranks_path`` names a rank file (bounded: it is
    read here and broadcast), ``pattern`` splits a text into pre-tokens. Returns doc_id, n_tokens, ids_sha256 (ids
    as little-endian unsigned 32-bit integers), decoded_sha256 and, ``with_ids``, ids as binary in that form.
    A null or empty text has no tokens; rows with equal or null ids are kept each; an empty table gives no rows.
    One narrow map over the scan: no shuffle.
    """
    with open(ranks_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        cache, split = worker_cache(vocabulary.value), regex.compile(pattern)

        def run(doc_id, text):
            out = {"doc_id": doc_id, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for t in text:
                ids = b"".join(map(cache.__getitem__, split.findall(t or "")))
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(cache.bpe.decode(np.frombuffer(ids, dtype="<u4").tolist())).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return run

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, make)
