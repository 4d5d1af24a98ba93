import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zetasky.llm import pii

TEXTS = [
    None, "", " ", "mail bob.x@mail1.example.com, c%d@e.f+g@h.i x@y", "é☃🙂 42.144.35.254 1.2.3.4.5 999.1.1.1 000255.1.1.1 1.2.3", "4068516892505468 4068-5168-9250-5469 1 2 3 4",
    "+1 (863) 555-9426 +12 +1234567890123456789 +49 30 1234567.", "call (212) 555-0199 or 212-555-0188; SSN: 123-45-6789, IBAN DE89370400440532013000 ok", "9" * 30_000, "a" * 60_000, "1." * 20_000, "+" * 5000 + "1" * 5000,
    "x@a.b" * 40, "4539578763621486 4539 5787 6362 1486 5" * 3, "a.b@c.d@e.f 1.1.1.1.1.1.1.1", "ＡＢ١٢٣@x.y ٣.٤.٥.٦",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_by_hand(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))] if "." in text else []
    digits = lambda s: re.sub("[^0-9]", "", s)
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    spans = sorted((a, k, b) for k, found in enumerate((email, ip, card, phone)) for a, b in found)
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]


def test_base_spans_equal_plain_patterns(spark):
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, base int")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want, row = base_by_hand(t or ""), got[i if i != 4 else None]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:60], want[:5], row.spans[:200])
        assert set(want) <= set(row.spans.split(",")) | {""}
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in pii.BASE_KINDS)


def test_context_and_gazetteer_add_spans(spark):
    rows = [(i, f"word call (212) 555-01{i:02d} or ssn 123-45-67{i:02d} then iban DE893704004405320130{i:02d} end") for i in range(10, 60)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_added == 3 for r in got)
    plain = pii.find_personal_data(spark.createDataFrame([(i, f"part 000-00-{i:04d} of it") for i in range(50)], "doc_id long, text string")).collect()
    assert all(r.n_added == 0 for r in plain)


def test_em_learns_reliability():
    form, gazetteer, context = 1, 3, 9
    yes = lambda *on: sum(2 * d if d in on else d for d in (form, gazetteer)) + (18 if context in on else 0)
    counts = {(3, yes(form, gazetteer, context), 0): 900, (3, yes(form, gazetteer), 0): 300, (3, yes(), 0): 1000, (3, yes(context), 0): 400, (3, yes(form), 0): 100}
    model = pii.fit(counts)
    odds = {c: model.odds(c[0], c[1], c[2], lambda t, i: t[int(i)]) for c in counts}
    assert odds[3, yes(form, gazetteer, context), 0] > 3 and odds[3, yes(), 0] < -1.4
    reach = [e[pii.YES] - e[pii.NO] for e in model.evidence[:2]]
    assert reach[1] > model.evidence[2][pii.YES] - model.evidence[2][pii.ABSTAINS] and reach[0] > 0


def test_classifier_beats_the_majority():
    """One labeler is reliable, two guess, and two features tell true spans from others: what was learned finds more."""
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.4
    say = lambda accuracy, silent: np.where(rng.random(len(truth)) < silent, 0, np.where((rng.random(len(truth)) < accuracy) == truth, 2, 1))
    votes = say(0.9, 0.0) + 3 * say(0.55, 0.2) + 9 * say(0.58, 0.4)
    features = (rng.random(len(truth)) < np.where(truth, 0.8, 0.2)).astype(int) * 4 + (rng.random(len(truth)) < np.where(truth, 0.1, 0.6)).astype(int) * 8
    kinds = rng.integers(4, 7, len(truth))
    counts = Counter(zip(kinds.tolist(), votes.tolist(), features.tolist(), strict=True))
    model = pii.fit(counts)
    found = {c: model.odds(*c, lambda t, i: t[int(i)]) > 0 for c in counts}
    learned = np.array([found[c] for c in zip(kinds.tolist(), votes.tolist(), features.tolist(), strict=True)])
    cast = np.stack([votes // 3**i % 3 for i in range(3)])
    majority = (cast == 2).sum(axis=0) > (cast == 1).sum(axis=0)
    cells = Counter((c, t) for c, t in zip(zip(kinds.tolist(), votes.tolist(), features.tolist(), strict=True), truth.tolist(), strict=True))
    most = sum(max(cells[c, True], cells[c, False]) for c in counts) / len(truth)  # what a judge who knows every truth would reach
    assert (learned == truth).mean() > most - 0.01 and (learned == truth).mean() > (majority == truth).mean() + 0.05
    assert model.weights[2] > 0.5 and model.weights[3] < -0.5


@pytest.mark.parametrize("chunk", [3, 256])
def test_many_matches_in_one_text(spark, monkeypatch, chunk):
    monkeypatch.setattr(pii, "CHUNK", chunk)
    monkeypatch.setattr(pii, "MASK_BLOCK", 7 if chunk == 3 else 4096)
    n = 40 if chunk == 3 else 32_000
    text = "é🙂 " + " ".join(f"u{i}@mail.com and 10.0.0.{i % 300}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.find_personal_data(docs, keep=("text",)).select("*", pii.masked(F.col("kept.text"), F.col("span_list")).alias("clean")).first()
    assert time.perf_counter() - began < 60
    assert row.base_sha256 == hashlib.sha256(",".join(base_by_hand(text)).encode()).hexdigest()
    assert row.clean == re.sub(r"10\.0\.0\.(\d+)", lambda m: "[IP]" if int(m[1]) <= 255 else m[0], re.sub(r"u\d+@mail\.com", "[EMAIL]", text))


def test_kept_columns_may_have_the_results_names(spark):
    docs = spark.createDataFrame([(1, "write bob@mail.com", "mine", 7)], "doc_id long, text string, spans string, base int")
    row = pii.find_personal_data(docs, keep=("spans", "base", "text")).first()
    assert row.spans == "email:6:18" and (row.kept.spans, row.kept.base) == ("mine", 7)


def test_masking(spark):
    docs = spark.createDataFrame([(1, "é bob@mail.com x 42.144.35.254"), (2, "clean"), (3, None), (4, "")], "doc_id long, text string")
    got = pii.find_personal_data(docs, keep=("text",)).select("doc_id", pii.masked(F.col("kept.text"), F.col("span_list")).alias("text")).collect()
    assert dict(map(tuple, got)) == {1: "é [EMAIL] x [IP]", 2: "clean", 3: None, 4: ""}


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
