"""The pipeline and the language network against plain versions of themselves."""

import random
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from zetasky.llm import bpe, langid


def test_forward_pass_equals_loops():
    rng = np.random.default_rng(0)
    net = langid.ByteCNN.fresh(["a", "b", "c"], seed=3)
    net.weights["bias"] = rng.normal(size=net.weights["bias"].shape).astype(np.float32)
    window = rng.integers(0, 256, (2, 40))
    depth, got = net.weights["embed"].shape[1], net.forward(window)
    for w, row in zip(window, got, strict=True):
        pooled = []
        for f in range(net.mask.shape[1]):
            width = int(net.mask[:, f].sum()) // depth
            spots = [sum(float(net.weights["embed"][w[at + j], d]) * float(net.weights["conv"][j * depth + d, f]) for j in range(width) for d in range(depth)) for at in range(40 - len(net.mask) // depth + 1)]
            pooled.append(max(0.0, max(spots) + float(net.weights["bias"][f])))
        logits = np.array([sum(p * float(net.weights["out"][f, k]) for f, p in enumerate(pooled)) + float(net.weights["out_bias"][k]) for k in range(3)])
        assert np.allclose(row, logits - np.log(np.exp(logits).sum()), atol=1e-4)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def first_of_each(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, t) for i, (d, t) in enumerate(rows) if least[find(i)] == d]


def holds(text, item):
    """Whether some part of the text is within 5 % edits of the item: Sellers's table, row by row."""
    text, item = (" " + re.sub(r"[\W_]+", " ", x.lower()).strip() + " " for x in (text, item))
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= len(item) * 0.05


def test_pipeline_equals_plain_version(spark, tmp_path):
    rng = random.Random(5)
    vocab = {"en": "the thing over with house and that from under great".split(), "de": "der über schön mit haus und dass von unter groß".split()}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "s", "ing", "en", "ly"]) for _ in range(n))
    item = "which of these questions was held out of " + prose("en", 14)
    rows = []
    for i in range(110):
        lang, kind = rng.choice(["en", "de"]), rng.randrange(7)
        text = prose(lang, rng.randrange(20, 60))
        if kind < 3 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text += f" write to user{i}@mail.com or 10.1.2.{i} today"
        elif kind == 4 and i % 2:
            leak = list(item)
            for _ in range(rng.randrange(0, 9)):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            text += " " + "".join(leak) + " " + prose(lang, 4)
        rows.append((i, text if kind != 6 or i % 5 else "12 34 -- 56", lang))
    rng.shuffle(rows)
    spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    guess = model.predict([t for _, t, _ in rows])
    kept = [(d, t) for (d, t, _), (lang, score) in zip(rows, guess, strict=True) if lang != "und" and score >= 0.35]
    kept = [(d, t) for d, t in first_of_each(kept) if not holds(t, item)]
    assert 40 < len(kept) < 100
    clean = {d: re.sub(r"10\.1\.2\.\d+", "[IP]", re.sub(r"user\d+@mail\.com", "[EMAIL]", t)) for d, t in kept}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: library.encode_ordinary(t) for d, t in clean.items()}
