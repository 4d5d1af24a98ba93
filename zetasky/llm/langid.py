"""Language identification by a byte convolutional network written and trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's strongest answer is
pooled, and a softmax layer names the language. A text's windows cover all of it and vote by their log
probabilities. The network is fitted on a bounded sample of labelled texts; predictions see nothing but the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import annotate, free_name, map_columns, ship

#: Bytes of a window; windows that the network takes at a time.
WINDOW, BATCH = 256, 16
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


#: Weights are whole multiples of this from step to step.
GRID = 2.0**-14


def on_grid(values: np.ndarray) -> np.ndarray:
    """Values rounded to GRID: products that other machines sum in another order differ far behind it, so the next step begins
    from the same weights everywhere."""
    return np.round(values / GRID) * GRID


@dataclass
class ByteCNN:
    """Filters of all widths stand side by side in one matrix over grams of the greatest width; ``mask`` holds the
    narrower ones' unused bytes at zero, so one product answers for all of them."""

    languages: list[str]
    weights: dict[str, np.ndarray]
    mask: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], widths=(2, 3, 4), filters: int = 8, depth: int = 4, seed: int = 0) -> ByteCNN:
        rng, most = np.random.default_rng(seed), max(widths)
        mask = np.concatenate([np.repeat(np.arange(most * depth) < k * depth, filters).reshape(-1, filters) for k in widths], axis=1)
        weights = {
            "embed": rng.normal(0, 0.5, (256, depth)),
            "conv": rng.normal(0, (2 / (most * depth)) ** 0.5, mask.shape) * mask,
            "bias": np.zeros(mask.shape[1]),
            "out": rng.normal(0, 0.1, (mask.shape[1], len(languages))),
            "out_bias": np.zeros(len(languages)),
        }
        return cls(languages, {k: on_grid(v) for k, v in weights.items()}, mask.astype(float))

    def ready(self) -> ByteCNN:
        """The network as predictions use it, in single precision."""
        return ByteCNN(self.languages, {k: v.astype(np.float32) for k, v in self.weights.items()}, self.mask.astype(np.float32))

    def grams(self, windows: np.ndarray) -> np.ndarray:
        """(n, spots, width * depth): the embedded bytes under the filters at each spot."""
        embedded = self.weights["embed"][windows]
        n, size, depth = embedded.shape
        spots = size - len(self.mask) // depth + 1
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (n, spots, len(self.mask)), embedded.strides))

    def head(self, peak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled features and log probabilities."""
        features = np.maximum(peak + self.weights["bias"], 0)
        logits = features @ self.weights["out"] + self.weights["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return features, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def forward(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of (n, WINDOW) bytes."""
        grams = self.grams(windows)
        answers = (grams.reshape(-1, len(self.mask)) @ self.weights["conv"]).reshape(*grams.shape[:2], -1)
        while (spots := answers.shape[1]) > 1:  # the maximum by halves is far faster than along a short axis
            half = np.maximum(answers[:, : spots // 2], answers[:, spots - spots // 2 :])
            answers = half if spots % 2 == 0 else np.concatenate([half, answers[:, spots // 2 : spots // 2 + 1]], axis=1)
        return self.head(answers[:, 0])[1]

    def gradient(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        grams = self.grams(windows)
        answers = grams @ self.weights["conv"]
        spot = answers.argmax(axis=1)
        features, chance = self.head(np.take_along_axis(answers, spot[:, None], axis=1)[:, 0])
        slope = (np.exp(chance) - target) / len(windows)
        d = slope @ self.weights["out"].T * (features > 0)
        best = np.take_along_axis(grams, spot[:, :, None], axis=1)  # n, filters, width * depth
        grad = {"out": features.T @ slope, "out_bias": slope.sum(0), "bias": d.sum(0), "embed": np.zeros_like(self.weights["embed"])}
        grad["conv"] = np.einsum("nf,nfd->df", d, best) * self.mask
        into, depth = d[:, :, None] * self.weights["conv"].T[None], grad["embed"].shape[1]
        for j in range(len(self.mask) // depth):
            chars = np.take_along_axis(windows, spot + j, axis=1)
            np.add.at(grad["embed"], chars.ravel(), into[:, :, j * depth : (j + 1) * depth].reshape(-1, depth))
        return grad

    def fit(self, windows: np.ndarray, labels: np.ndarray, share: np.ndarray, epochs: int, draws: int, rate: float = 0.01, batch: int = 64, seed: int = 0) -> None:
        """Adam on softmax cross-entropy over ``draws`` windows an epoch, each drawn with its ``share`` as chance.

        In double precision, with weights on a grid, so that a fit is the same on every machine.
        """
        rng, step = np.random.default_rng(seed), 0
        target = np.eye(len(self.languages))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for _ in range(epochs):
            drawn = rng.choice(len(labels), draws, p=share)
            for i in range(0, len(drawn), batch):
                pick, step = drawn[i : i + batch], step + 1
                for k, g in self.gradient(windows[pick], target[labels[pick]]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    pace = rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                    self.weights[k] = on_grid(self.weights[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability for whole texts, with windows of many texts in one batch."""
        usable = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        data = [to_windows(texts[i]) for i in usable]
        if not data:
            return out
        counts = [len(d) for d in data]
        windows = np.concatenate(data)
        scores = np.concatenate([self.forward(windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        votes = np.add.reduceat(scores, starts, axis=0) / np.array(counts)[:, None]
        chance = np.exp(votes - votes.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        for i, row in zip(usable, chance, strict=True):
            out[i] = (self.languages[int(row.argmax())], round(float(row.max()), 6))
        return out


def to_windows(text: str) -> np.ndarray:
    """All bytes of a text in windows one after the other; a short last window repeats the text's own bytes."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(data) < WINDOW:
        return np.resize(data, (1, WINDOW))
    whole = data[: len(data) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return whole if len(data) % WINDOW == 0 else np.concatenate([whole, data[None, -WINDOW:]])


def held_out() -> Column:
    """The fold that is never learned from: CRC-32 of the id as text leaves remainder 2 by 4; a null id is not in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_docs: int = 1500, max_bytes: int = 64 << 20, epochs: int = 5, epoch_windows: int = 8192) -> ByteCNN | None:
    """Fit the network on at most ``max_docs`` labelled texts outside the held-out fold, all windows of each.

    The sample is the texts whose salted id hashes lowest, so the same rows are drawn on every run, as far as ``max_bytes``
    of text reach: the driver gets no more, and a text of over a sixteenth of that is not drawn. An epoch draws
    ``epoch_windows`` windows, languages and the texts of a language being as likely as each other. None without a
    labelled text.
    """
    ship(docs.sparkSession)
    labelled = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes // 16))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2**31))
    below = int(min(1.0, 2 * max_docs / max(1, labelled.count())) * 2**31)  # so tasks send few rows, however many there are
    drawn = labelled.select("lang", "text", lot.alias("lot")).filter(F.col("lot") < below)
    total = F.sum(F.octet_length("text")).over(Window.orderBy("lot", "lang", "text").rowsBetween(Window.unboundedPreceding, 0))
    first = drawn.orderBy("lot", "lang", "text").limit(max_docs).withColumn("total", total).filter(F.col("total") <= max_bytes)
    sample = [r for r in first.select("lang", "text").collect() if LETTER.search(r.text)]
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    model, windows = ByteCNN.fresh(languages), [to_windows(r.text) for r in sample]
    counts, label = np.array([len(w) for w in windows]), np.array([languages.index(r.lang) for r in sample])
    share = (1 / np.bincount(label)[label] / counts).repeat(counts)
    model.fit(np.concatenate(windows), label.repeat(counts), share / share.sum(), epochs, epoch_windows)
    return model.ready()


def identify(docs: DataFrame, model: ByteCNN | None = None) -> DataFrame:
    """Predict the language of every whole text.

    ``docs`` needs doc_id, text and, for training where no ``model`` is given, lang; other columns are ignored.
    Returns doc_id, held_out, lang_pred and score. A null text or one without a letter is ``und`` with score 0, as
    is everything if nothing could be learned; rows with equal or null ids are kept each; an empty table gives no
    rows. The model is some 30 kB whatever the input; prediction is one narrow map over the scan.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    found = map_columns(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", lambda: predictor(shared))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def predictor(shared):
    def run(doc_id, text):
        found = shared.value.predict(text) if shared.value else [(UNKNOWN, 0.0)] * len(text)
        return {"doc_id": doc_id, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return run


def keep_identified(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text gets a language with ``least_score`` at least.

    Texts without a letter, null or empty ones go, and those that the network can place nowhere. Without a labelled
    text to learn from, every text with a letter stays.
    """
    model = train(docs)
    if model is None:
        return docs.filter(F.rlike("text", F.lit(r"\p{L}")))
    shared, fit = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "fit")

    def make():
        predict = predictor(shared)

        def run(text):
            found = predict(None, text)
            return {fit: [lang != UNKNOWN and score >= least_score for lang, score in zip(found["lang_pred"], found["score"], strict=True)]}

        return run

    return annotate(docs, ["text"], f"`{fit}` boolean", make).filter(F.col(fit)).drop(fit)
