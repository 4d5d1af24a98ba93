"""A quality classifier: regularised quadratic discriminant analysis over statistics of whole texts.

Each text becomes a short vector of transformed statistics in whole 4096ths. Both classes' means and covariances come from
exact integer sums over all labelled rows outside the held-out fold, so no sample is drawn and the model is the same on
every machine; covariances shrink towards the pooled one and its diagonal, and their Cholesky factors, inverted once,
give Mahalanobis distances, whose difference with that of the log determinants is the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import map_columns, stash, with_arrow

#: Fixed-point unit of a statistic; shrinkage towards the pooled covariance and of that towards its diagonal; least variance.
UNIT, TO_POOLED, TO_DIAGONAL, LEAST_VARIANCE = 4096, 0.2, 0.1, 1e-4
WORD = re.compile(r"\S+")
MARKS = re.compile(r"[^\w\s.,;:!?'\"()-]")
LAST = re.compile(r"[.!?][\"')]*$")


def shannon(counts) -> float:
    total = sum(counts)
    return -sum(n / total * math.log2(n / total) for n in counts if n) if total else 0.0


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; all but the sizes are 0 where a text has nothing that they could be of."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if x.strip()]
    chars, n_words, n_lines = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    letters = sum(map(str.isalpha, text))
    counts = Counter(words)
    data = text.encode("utf-8", "replace")
    odd = len(MARKS.findall(text))
    share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(1, b))))  # noqa: E731  evens out a share's variance
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        math.log1p(sum(map(len, words)) / n_words),
        math.log1p(max(map(len, words), default=0)),
        share(letters, chars),
        share(sum(map(str.isdigit, text)), chars),
        share(sum(map(str.isspace, text)), chars),
        share(sum(map(str.isupper, text)), letters),
        share(odd, chars),
        share(sum(1 for w in words if MARKS.search(w)), n_words),
        share(sum(n for w, n in counts.items() if len(w) <= 3), n_words),
        share(max(counts.values(), default=0), n_words),
        share(len(counts), n_words),
        share(len(lines) - len(set(lines)), n_lines),
        share(sum(1 for x in lines if LAST.search(x.rstrip())), n_lines),
        math.log1p(n_words / n_lines),
        math.log1p(max((sum(1 for _ in g) for _, g in groupby(words)), default=0)),
        shannon(np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist()) / 8,
        math.log1p(len(zlib.compress(data, 1)) / max(1, len(data))),
    ]


SIZE = len(statistics(""))


@dataclass
class Discriminant:
    """Means (2, d), inverted Cholesky factors (2, d, d), and each class's log prior less half its log determinant (2,)."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, counts: list[int], sums: np.ndarray, products: np.ndarray) -> Discriminant:
        """From each class's number of rows, sums of vectors (2, d) and of products (2, d, d), in units of a statistic."""
        n = np.array(counts, dtype=float)
        means = sums / n[:, None]
        scatter = products - means[:, :, None] * means[:, None, :] * n[:, None, None]
        pooled = scatter.sum(0) / n.sum()
        aim = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
        weight = np.maximum(TO_POOLED, means.shape[1] / (means.shape[1] + n))  # a small class leans on both
        covariances = (1 - weight)[:, None, None] * scatter / n[:, None, None] + weight[:, None, None] * aim
        factors = np.linalg.cholesky(covariances + LEAST_VARIANCE * np.eye(means.shape[1]))
        logs = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
        return cls(means, np.linalg.inv(factors), np.log(n / n.sum()) - logs)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """0 to 1 for (n, d) vectors: the log-density difference a statistic, through a logistic curve."""
        apart = np.einsum("cij,cnj->cni", self.factors, vectors[None] - self.means[:, None])
        density = self.offsets[:, None] - 0.5 * (apart**2).sum(2)
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / vectors.shape[1], -30, 30)))


def held_out() -> Column:
    """The fold that is never learned from: CRC-32 of the id as text leaves remainder 1 by 3; a null id is not in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text: one narrow map over the scan."""

    def make():
        return lambda doc_id, text: {"doc_id": doc_id, "statistics": [[round(x * UNIT) for x in statistics(t or "")] for t in text]}

    return map_columns(docs, ["doc_id", "text"], "doc_id long, statistics array<int>", make)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums for each class: its rows, its vectors and their products, as (quality, place, total)."""
    whole = np.zeros((2, 1 + SIZE + SIZE * SIZE), dtype=object)  # Python's integers: no sum is too great
    for batch in batches:
        x = np.array(batch.column("statistics").to_pylist(), dtype=np.int64).reshape(-1, SIZE)
        times = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bad", "good")]).astype(np.int64)
        for at in range(0, len(x), 4096):
            part, often = x[at : at + 4096], times[:, at : at + 4096].astype(object)
            rows = np.concatenate([np.ones((len(part), 1), dtype=np.int64), part, (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)], axis=1)
            for c in (0, 1):
                picked = often[c].astype(bool)
                plain = bool((often[c][picked] == 1).all())
                whole[c] += rows[picked].sum(0).astype(object) if plain else (often[c][picked] @ rows[picked].astype(object) if picked.any() else 0)
    for c in (0, 1):
        yield pa.RecordBatch.from_pydict({"quality": [c] * whole.shape[1], "place": list(range(whole.shape[1])), "total": [str(v) for v in whole[c]]}, schema=pa.schema([("quality", pa.int32()), ("place", pa.int32()), ("total", pa.string())]))


def train(statistics_of: DataFrame, labels: DataFrame) -> Discriminant | float:
    """Fit on all labelled rows outside the held-out fold; a constant score if a class has none.

    ``statistics_of`` has doc_id and statistics, ``labels`` doc_id and quality. Labels other than 0 and 1 or of a null id
    say nothing; an id's repeated labels count each, for each of its rows. The driver gets 2 x (1 + d + d * d) sums.
    """
    votes = labels.filter(~held_out()).groupBy("doc_id").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    known = statistics_of.join(votes.filter("bad + good > 0"), "doc_id").select("statistics", "bad", "good")
    sums = with_arrow(known, add_up, "quality int, place int, total string").groupBy("quality", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for r in sums.collect():
        found[r.quality, r.place] = float(r.total)
    counts = found[:, 0]
    if not counts.all():
        return float(counts[1] / counts.sum()) if counts.sum() else 0.5
    return Discriminant.fit(list(counts), found[:, 1 : 1 + SIZE] / UNIT, found[:, 1 + SIZE :].reshape(2, SIZE, SIZE) / UNIT**2)


def score_quality(docs: DataFrame, labels: DataFrame, model: Discriminant | float | None = None) -> DataFrame:
    """Score the quality of every whole text, as ``labels`` mark it.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality (1 good, 0 bad), which are read only where no ``model`` is
    given; other columns are ignored. Returns doc_id, held_out, score and predicted. A null text is an empty one, which is
    scored like others; without rows of both classes to learn from, all score their share of good ones, or 0.5; rows with
    equal or null ids are kept each; an empty table gives no rows. The model is some 7 kB whatever the input.
    """
    vectors, _ = stash(measured(docs))
    shared = docs.sparkSession.sparkContext.broadcast(train(vectors, labels) if model is None else model)

    def make():
        def run(doc_id, found):
            model = shared.value
            if isinstance(model, float):
                scores = [model] * len(found)
            else:
                scores = model.scores(np.array(found, dtype=float).reshape(-1, SIZE) / UNIT).round(9).tolist()
            return {"doc_id": doc_id, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return run

    scored = map_columns(vectors, ["doc_id", "statistics"], "doc_id long, score double, predicted int", make)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
