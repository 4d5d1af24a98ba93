import hashlib
import random

import pyarrow as pa
import pytest

from zetasky.llm import suffixes


def brute(rows, length):
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            if d is not None:
                least[raw[i : i + length]] = min(d, least.get(raw[i : i + length], d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        cut = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if d is not None and least[raw[i : i + length]] < d:
                cut[i : i + length] = [True] * length
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((d, len(raw), sum(cut), spans, hashlib.sha256(bytes(b for b, c in zip(raw, cut, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(k)) for k in (9, 12, 30, 60)]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            text = list(rng.choice(rows)[1] or "x")
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = "Z"
            text = "".join(text)
        else:
            text = " ".join([word() for _ in range(rng.randrange(0, 30))] + [rng.choice(passages) for _ in range(rng.randrange(0, 3))] + [word() for _ in range(rng.randrange(0, 12))])
        rows.append((i, text))
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 400), (n + 3, "a" * 300), (n + 4, "ab" * 200), (5, rows[3][1]), (6, "b" * 120), (6, "b" * 130), (7, "b" * 60), (None, rows[2][1]), (n + 5, "z" * 49), (n + 6, "z" * 49)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, 1) for d, t in rows], "doc_id long, text string, tid int, first int")


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("length", [50, 21])
def test_cuts_equal_brute_force(spark, length):
    rows = corpus(length)
    assert result(suffixes.remove_repeats(frame(spark, rows), length)) == brute(rows, length)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_common_names_small_pieces_and_joins(spark, monkeypatch, broadcast):
    for name, value in {"COMMON_NAME": 3, "SLICE_DOCS": 40, "PACKED_NAMES": 50, "PIECE": 700, "SHARED_BROADCAST": broadcast, "COPIES_BROADCAST": broadcast, "COMPARED": 40}.items():
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(9, 120) + [(400, "q w e r t y u i o p " * 90 + "x"), (401, "q w e r t y u i o p " * 80 + "y")]
    assert result(suffixes.remove_repeats(frame(spark, rows))) == brute(rows, 50)


def test_kept_text_and_empty_table(spark):
    rows = [(1, "k" * 10 + "0123456789" * 6 + "é"), (2, "m" + "0123456789" * 6 + "n")]
    got = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(frame(spark, rows), with_text=True).collect()}
    assert got == {1: rows[0][1].encode(), 2: b"mn"}
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_equal_hashes_of_different_strings_are_told_apart(spark, monkeypatch):
    real = suffixes.window_hashes
    monkeypatch.setattr(suffixes, "window_hashes", lambda data, size: real(data, size) % 5 if size == 50 else real(data, size))
    line = "the same line of a licence that stands in many documents, word for word"
    rows = [(i, f"{i} begins {line} and {'x' * (i % 3)} ends {i}") for i in range(12)]
    table = pa.table({"context": [t.encode() for _, t in rows], "doc_id": [d for d, _ in rows], "first": pa.array([0] * len(rows), pa.int32())})
    row, first, end = suffixes.repeated_strings(table, 50)
    want = [(d, a, b) for d, t in rows for a, b in covered(rows, d, t)]
    assert sorted(zip(row.tolist(), first.tolist(), end.tolist(), strict=True)) == want


def covered(rows, doc, text):
    """Unions of starts of 50-byte strings that a document with a smaller id holds, as (first, end)."""
    hit = [any(text[i : i + 50] in t for d, t in rows if d < doc) for i in range(len(text) - 49)]
    edges = [i for i, h in enumerate(hit) if h and not (i and hit[i - 1])]
    return [(a, next((i for i in range(a, len(hit)) if not hit[i]), len(hit)) - 1 + 50) for a in edges]


@pytest.mark.parametrize("bits", [2**10, 2**29])
def test_a_full_filter_of_names_loses_none(spark, monkeypatch, bits):
    """Beyond what was broadcast before, anchors still meet only where the filter holds their names."""
    monkeypatch.setattr(suffixes, "FILTER_BITS", bits)
    rows, sent = corpus(11, 90), []
    real = suffixes.name_filter
    monkeypatch.setattr(suffixes, "name_filter", lambda shared, buckets: sent.append((real(shared, buckets), buckets)) or sent[-1][0])
    assert result(suffixes.remove_repeats(frame(spark, rows))) == brute(rows, 50)
    found, buckets = sent[0]
    assert 8 * len(found) <= max(bits, 8 * buckets)
    texts = [(t or "").encode() for t in {t for d, t in rows if d is not None}]
    every, some = (sum(len(e) for e, _ in suffixes.found_anchors(texts, 50, f, buckets)) for f in (None, found))
    assert 0 < some < every


def test_contexts_of_many_documents(spark):
    text = "0123456789" * 8
    docs = spark.createDataFrame([(i, i, text) for i in range(200)], "doc_id long, tid long, text string").coalesce(1)
    place = suffixes.np.zeros(2, dtype=suffixes.SOUGHT)
    place["first"], place["more"], place["name"] = [1, 7], [0, 3], [5, 6]
    sought = spark.createDataFrame([(i, i, bytearray(place.tobytes())) for i in range(200)], "doc_id long, tid long, sought binary").coalesce(1)
    got = sorted((r.doc_id, r.name, r.first, bytes(r.context).decode()) for r in suffixes.contexts(docs, sought, 50).collect())
    assert got == sorted((i, n, f, text[f : f + m + 50]) for i in range(200) for n, f, m in ((5, 1, 0), (6, 7, 3)))
