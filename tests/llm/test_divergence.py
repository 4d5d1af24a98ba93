"""The source audit against brute force, and its blocks at small sizes."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from zetasky.llm import divergence as dv


def plain(rows):
    """Every result row from (text, lang, source) rows, by whole integers."""
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = Counter(re.findall(dv.TERM, lower))
        groups[lang or "", source or ""].update(terms)
        held[lang or ""].update(terms.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= dv.LEAST_DOCS]
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s, p in shares.items():
            others = [(sum(abs(p[t] - o[t]) for t in kept), x) for x, o in shares.items() if x != s]
            terms = [(p[t] - q[t], t) for t in kept if mine[s][t] and p[t] > q[t]]
            for part, items, most in (("pair", others, None), ("term", terms, 50)):
                order = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:most]
                out |= {(lang, s, part, item, value, rank + 1) for rank, (value, item) in enumerate(order)}
    return out


def texts(n=900, seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "Übér", "ÜBÉR", "x\x00y", "a1b", "don't", "日本", "𝔘", "é\n", "rare"] + [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "Ä", "z" * 5])
        own = words if source != "s2" else words[3:9] * 5 + words
        yield (None if i % 40 == 0 else "" if i % 41 == 0 else " ".join(rng.choices(own, k=rng.randint(1, 30)))), lang, source
    yield "only few words", "xx", "s1"  # a language without kept terms
    yield "12 34 !?", "xx", "s9"


def test_audit_equals_brute_force(spark):
    rows = list(texts()) + [("Wax wax " * 20_000, "en", "s1")]
    docs = spark.createDataFrame([(t, lang, s, i, "x", 0) for i, (t, lang, s) in enumerate(rows)], "text string, lang string, source string, total long, term string, spread int")
    got = dv.audit_sources(docs.repartition(7))
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)
    assert {r[4] for r in found if r[0] == "xx"} == {0}


def test_empty_table_and_one_source(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert dv.audit_sources(docs).count() == 0
    one = spark.createDataFrame([("a b", "en", "s")] * 40, "text string, lang string, source string")
    assert dv.audit_sources(one).count() == 0  # no other source, and no term above the language's share


@pytest.mark.parametrize("held", [1, 3, 50, 10**6])
def test_blocks_of_any_size_give_the_same(monkeypatch, held):
    monkeypatch.setattr(dv, "HELD_ROWS", held)
    monkeypatch.setattr(dv, "SLICE_ROWS", 5)
    monkeypatch.setattr(dv, "SLICE_CHARS", 40 if held > 3 else 1 << 20)
    rows = list(texts(300))
    batch = lambda part: pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in part], pa.string()) for i, k in enumerate(("text", "lang", "source"))})
    counted = [r for i in range(0, len(rows), 70) for b in dv.count_terms(iter([batch(rows[i : i + 70])])) for r in b.to_pylist()]
    counted.sort(key=lambda r: (r["lang"].encode(), r["term"].encode()))
    split = lambda many, schema: iter(pa.Table.from_pylist(many, schema=dv.schema_of(schema)).to_batches(max_chunksize=4))
    kept = [r for b in dv.keep_common(split(counted, dv.COUNTED)) for r in b.to_pylist()]
    want = Counter()
    docs = Counter()
    for t, lang, s in rows:
        terms = Counter(re.findall(dv.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
        for term, n in terms.items():
            want[lang or "", s or "", term] += n
            docs[lang or "", term] += 1
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in kept} == {k: n for k, n in want.items() if docs[k[0], k[2]] >= dv.LEAST_DOCS}
    assert len(kept) == len({(r["lang"], r["source"], r["term"]) for r in kept}) and sum(r["first"] for r in kept) == len({(r["lang"], r["term"]) for r in kept})
    kept.sort(key=lambda r: (r["lang"].encode(), r["term"].encode()))
    rows = [{**{k: r[k] for k in ("lang", "source", "term", "n", "in_lang")}, "total": 100, "lang_total": 500, "kinds": 20} for r in kept]
    schema = "lang string, source string, term string, n long, in_lang long, total long, lang_total long, kinds long"
    sums = Counter()
    for b in dv.compare_sources(split(rows, schema)):
        for r in b.to_pylist():
            if r["part"] == "pair":
                sums[r["lang"], r["source"], r["item"]] += r["value"]
    p = lambda n: 1 + 10**9 * (n + 5) // 200
    by_term = defaultdict(list)
    for r in rows:
        by_term[r["lang"], r["term"]].append((r["source"], p(r["n"])))
    plainly = Counter()
    for (lang, _), many in by_term.items():
        for a, x in many:
            for b, y in many:
                if a < b:
                    plainly[lang, a, b] += abs(x - y) - abs(x - p(0)) - abs(p(0) - y)
    assert sums == plainly


def test_a_long_text_is_read_in_pieces_between_terms():
    text = "Ab-c ÄÖ\x00 " * 900_000 + "z" * 3_000_000
    assert "".join(dv.pieces(text)) == text and all(p[-1] in " -\x00" for p in list(dv.pieces(text))[:-1])
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text, "ab", None], pa.string()), "lang": ["en", None, "en"], "source": pa.array([None, None, None], pa.string())})
    got = {(r["lang"], r["source"], r["term"]): (r["docs"], r["n"]) for b in dv.count_terms(iter([batch])) for r in b.to_pylist()}
    assert got == {("en", "", t): (1, 900_000) for t in ("ab", "c", "ÄÖ")} | {("en", "", "z" * 3_000_000): (1, 1), ("", "", "ab"): (1, 1)}
