"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes. Each passage becomes shares of character classes and measures of its
words, is encoded by one hidden layer, and gets a gated attention weight, softmax over the document of
w . (tanh(V h) * sigmoid(U h)). The weighted passage representation is scored by a logistic unit. Only document labels
are learned from; the attention finds the passages that decide.

Defined results: null and empty texts are one passage of zeros; repeated rows are scored alike; rows without a usable label
teach nothing; with one label or none the score is that label's smoothed rate, one half without any. Further columns are
ignored; empty tables give empty results. The fit reads at most `sample` labelled rows (smallest hashes of the id first)
and their whole texts; every text is scored whole, one document at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.llm.common import Scratch, per_batch, text_or_empty
from populi.llm.toxicity import labelled

PASSAGE = 512  # bytes
SAMPLE = 6_000  # labelled rows that the fit may read
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4

# Classes of bytes; all others, above 127, are letters of other scripts.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".,;:", "!?", "|", "%$#&*@^~", "<>{}[]=/\\_+", "\"'`()-")
TABLE = np.full(256, len(CLASSES), np.uint8)
for _k, _signs in enumerate(CLASSES):
    TABLE[list(_signs.encode())] = _k
WORD_MEASURES = 6
WIDTH = len(CLASSES) + 1 + WORD_MEASURES + 1


def passages(text: str) -> np.ndarray:
    """Features of each passage, a row each."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    if not data:
        return out
    kinds = len(CLASSES) + 1
    at = np.arange(len(data)) // PASSAGE * kinds + TABLE[np.frombuffer(data, np.uint8)]
    counts = np.bincount(at, minlength=n * kinds).reshape(n, kinds)
    out[:, :kinds] = counts / counts.sum(axis=1, keepdims=True)
    for i in range(n):
        words = data[i * PASSAGE:(i + 1) * PASSAGE].split()
        if words:
            distinct = len(set(words))
            same = sum(map(bytes.__eq__, words, words[1:]))
            length = sum(map(len, words)) / len(words)
            out[i, kinds:kinds + WORD_MEASURES] = (distinct / len(words), same / len(words), min(length, 40) / 10, np.log1p(len(words)) / 5,
                                                   len(set(map(bytes.lower, words))) / len(words), max(map(len, words)) / 50)
    lines = data.split(b"\n")
    out[:, -1] = len(set(lines)) / len(lines)  # of the whole document
    return out


class Model:
    """Weights of the encoder, the gated attention and the scorer; rows are standardised first."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale, self.constant = mean, scale, None
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION),
                  "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all documents; starts: first passage of each document."""
        p, s = self.p, {"x": (x - self.mean) / self.scale}
        n = np.diff(np.r_[starts, len(x)])
        s["bag"] = np.repeat(np.arange(len(starts)), n)
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["v"], s["u"] = np.tanh(s["h"] @ p["V"]), 1 / (1 + np.exp(-s["h"] @ p["U"]))
        e = (s["v"] * s["u"]) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[s["bag"]])
        s["a"] = e / np.add.reduceat(e, starts)[s["bag"]]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], starts)
        s["y"] = 1 / (1 + np.exp(-np.clip(s["z"] @ p["c"] + p["d"], -30, 30)))
        return s

    def gradients(self, s: dict[str, np.ndarray], starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, g, bag = self.p, {}, s["bag"]
        dz = ((s["y"] - y) / len(y))[:, None]
        g["c"], g["d"] = (s["z"] * dz).sum(0), dz.sum(0)
        dbag = (dz * p["c"])[bag]
        da = (dbag * s["h"]).sum(1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, starts)[bag])  # through the softmax
        g["w"] = (s["v"] * s["u"] * de[:, None]).sum(0)
        dv = de[:, None] * p["w"] * s["u"] * (1 - s["v"] ** 2)
        du = de[:, None] * p["w"] * s["v"] * s["u"] * (1 - s["u"])
        g["V"], g["U"] = s["h"].T @ dv, s["h"].T @ du
        dh = (dbag * s["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - s["h"] ** 2)
        g["W"], g["b"] = s["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> None:
        """Adam on shuffled batches of documents; deterministic."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                part = order[i:i + BATCH]
                x = np.concatenate([bags[k] for k in part])
                starts = np.cumsum([0, *[len(bags[k]) for k in part[:-1]]])
                g = self.gradients(self.forward(x, starts), starts, y[part])
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in self.p:
                    g[k] = g[k] + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(self.forward(passages(text), np.array([0]))["y"][0])


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows for which `usable` (a condition on doc_id) holds."""
    scratch = Scratch(docs.sparkSession, "quality")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [passages(t).ravel() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(label), pa.array([h.tobytes() for h in held], pa.binary())],
                                          names=["doc_id", label, "x"])
    rows = scratch.write(labelled(docs, labels, label, usable, sample).select("doc_id", label, "text")
                         .mapInArrow(per_batch(encode), f"doc_id long, {label} int, x binary"), "sample")
    got = rows.toPandas().sort_values(["doc_id", "x"], kind="stable")  # at most `sample` rows
    scratch.drop("sample")
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x in got["x"]]
    y = got[label].to_numpy(float)
    if len(set(y)) < 2:
        model = Model(np.zeros(WIDTH), np.ones(WIDTH))
        model.constant = float((y.sum() + 0.5) / (len(y) + 1))
        return model
    x = np.concatenate(bags)
    model = Model(x.mean(0), x.std(0) + 1e-3)
    model.fit(bags, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in batch.column("text").to_pylist()], pa.float64())],
                                          names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(per_batch(one), "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame, held: F.Column) -> DataFrame:
    model = train(docs, labels, ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
