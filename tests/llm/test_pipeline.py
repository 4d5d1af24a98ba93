import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from zetasky.llm import bpe


def test_pipeline_on_planted_rows(spark, tmp_path):
    rng = random.Random(1)
    vocab = {"en": ["the", "thing", "over", "with", "house"], "de": ["der", "über", "schön", "mit", "haus"]}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "s", "ing", "en", "ly"]) for _ in range(n))
    docs = [(i, prose(lang := rng.choice(["en", "de"]), 80), lang, "s", 1) for i in range(120)]
    leak = "a held out question about " + prose("en", 20)
    docs += [(200, None, "en", "s", 1), (201, "123 ...", None, "s", 1), (202, docs[5][1], "en", "s", 1), (203, docs[6][1] + " end", "en", "s", 1), (204, prose("en", 30) + " " + leak + " " + prose("en", 9), "en", "s", 1), (205, prose("en", 30) + " write bob@mail.com now", "en", "s", 1), (5, docs[5][1], "de", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(120)) | {205}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    assert got[205].n_tokens == len(library.encode_ordinary(docs[125][1].replace("bob@mail.com", "[EMAIL]")))
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        read = stage(spark, read, str(tmp_path))
        assert read.columns == columns
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
