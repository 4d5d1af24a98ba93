"""The quality classifier against a plain fit, and its accuracy on rows that it has not seen."""

import zlib

import numpy as np
import pytest

from zetasky.llm import quality

SF = "/root/testdata/sf0.01"


def plain_model(texts, labels):
    """Class moments by numpy over all labelled rows outside the held-out fold."""
    x = [np.round(np.array(quality.statistics(t or "")) * quality.UNIT) for t, _ in texts]
    pick = lambda q: np.array([x[i] for i, (_, d) in enumerate(texts) if d is not None and zlib.crc32(str(d).encode()) % 3 != 1 for k in labels.get(d, []) if k == q]) / quality.UNIT
    classes = [pick(0), pick(1)]
    return quality.Discriminant.fit([len(c) for c in classes], np.stack([c.sum(0) for c in classes]), np.stack([c.T @ c for c in classes]))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.toPandas(), labels.toPandas(), quality.score_quality(docs, labels).toPandas()


def test_scores_equal_a_plain_discriminant(scored):
    docs, labels, got = scored
    marks = {}
    for r in labels.itertuples():
        marks.setdefault(r.doc_id, []).append(r.quality)
    model = plain_model(list(zip(docs.text, docs.doc_id, strict=True)), marks)
    vectors = np.array([np.round(np.array(quality.statistics(t or "")) * quality.UNIT) for t in docs.text]) / quality.UNIT
    want = []
    for v in vectors:  # log densities by solving with the covariances themselves
        logs = []
        for c in (0, 1):
            factor = np.linalg.inv(model.factors[c])
            gap, cov = v - model.means[c], factor @ factor.T
            logs.append(model.offsets[c] - 0.5 * gap @ np.linalg.solve(cov, gap))
        want.append(1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / len(v), -30, 30))))
    got = got.set_index("doc_id").loc[docs.doc_id]
    assert np.allclose(got.score, want, atol=1e-6)
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in docs.doc_id]).all()


def test_held_out_accuracy(scored):
    _, labels, got = scored
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(both) > 100 and (both.predicted == both.quality).mean() > 0.97
    ranks, good = both.score.rank(), both.quality == 1
    assert (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.98


def test_edges(spark):
    docs = "doc_id long, text string, quality int, score double, statistics string"
    rows = [(None, None), (1, ""), (1, ""), (2, "Fine words here."), (3, "$$ %% ## " * 30_000), (4, "日本語 " * 9)]
    docs = spark.createDataFrame([(i, t, 9, 0.1, "x") for i, t in rows], docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    bad = spark.createDataFrame([(i, 0, "x") for i in ids] + [(None, 1, "x"), (5, None, "x"), (6, 7, "x")], "doc_id long, quality int, text string")
    assert {r.score for r in quality.score_quality(docs, bad).collect()} == {0.0}
    both = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (4, 1), (4, 0), (1, 0), (0, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, both).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(docs.limit(0), both).count() == 0


def test_sums_are_exact_and_repeats_count(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 150_000, (5000, quality.SIZE))
    import pyarrow as pa

    times = rng.integers(0, 3, (2, 5000))
    batch = pa.RecordBatch.from_pydict({"statistics": x.tolist(), "bad": times[0].tolist(), "good": times[1].tolist()})
    for c, out in enumerate(quality.add_up(iter([batch.slice(0, 4500), batch.slice(4500)]))):
        got = [int(v) for v in out.column("total").to_pylist()]
        many = np.repeat(x, times[c], axis=0)
        assert got == [len(many), *many.sum(0).tolist(), *(many.T @ many).ravel().tolist()]
