import base64
import hashlib
import random

import public_tokenizers as P
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from zetasky.llm import bpe, tokens

RANKS = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
OURS = bpe.ByteBPE(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MODEL = tokens.load_model(open(P.path("piece_bpe_32k.model"), "rb").read())
TEXTS = [None, "", " ", "\n", "a", "  two  spaces ", "x" * 5000, "the<s></s><|endoftext|>", "né ☃ 漢字 ▁x▁ ▁", "a\n\n b \n", "\u0000\t\r\n", "password=12ab " * 300, " " * 3000]
WORDS = ["the", "thing", "naïve", "123", "\n", "  ", "漢", "ﬀ", "▁", "'s", "don't", "zz" * 9, "\t", "é", "🙂", "́"]


def ids(text):
    return [i for m in regex.findall(P.PATTERN, text) for i in OURS.encode_piece(m.encode())]


def mixed(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", " ", chr(rng.randrange(32, 0x24F))]) for _ in range(60))


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert OURS.decode(ids(text)) == text.encode()


def test_bpe_on_raw_pieces():
    rng = random.Random(7)
    pool = list(RANKS)
    for k in range(3000):
        piece = bytes(rng.choices(b"aeinorst ", k=rng.randrange(1, 40))) if k % 2 else b"".join(rng.choices(pool, k=4))
        want = [RANKS[piece]] if piece in RANKS else LIBRARY._core_bpe.encode_single_piece(piece)
        assert OURS.encode_piece(piece) == want


def test_counts_equal_library_piecewise():
    for text in [*filter(None, TEXTS), *map(mixed, range(300))]:
        assert sum(tokens.piece_length(MODEL, p) for p in tokens.pre_tokens(text)) == len(MODEL.encode(text)), text


@given(st.text(max_size=120))
@settings(max_examples=300, deadline=None)
def test_counts_equal_library(text):
    assert sum(tokens.piece_length(MODEL, p) for p in tokens.pre_tokens(text)) == len(MODEL.encode(text))


def table(spark, texts):
    rows = [(i // 2 if i else None, t, "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_queries_on_odd_rows(spark):
    docs = table(spark, TEXTS * 2)
    got = encoded = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted((len(e := LIBRARY.encode_ordinary(t or "")), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in TEXTS * 2)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded) == want and len(got) == len(TEXTS) * 2
    counted = tokens.count_tokens(docs.repartition(60), P.path("piece_bpe_32k.model"), token_limit=100).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted((len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for t in TEXTS * 2)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == want


def test_empty_tables(spark):
    docs = table(spark, [])
    assert bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).count() == 0
    assert tokens.count_tokens(docs, P.path("piece_bpe_32k.model")).count() == 0


def test_rank_file_is_read_whole():
    first = open(P.path("byte_bpe_50k.tiktoken"), "rb").readline().split()
    assert RANKS[base64.b64decode(first[0])] == int(first[1]) and len(RANKS) == 50256
