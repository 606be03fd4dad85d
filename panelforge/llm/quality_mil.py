"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each, the last may be shorter; every word of the text is in one). A passage
is described by shares of its characters and words; a learned layer encodes it, gated attention (tanh times sigmoid)
weighs the encodings, and a logistic layer scores the weighted sum. Only documents have labels. Training is plain
gradient descent (Adam) in numpy on the driver, on at most `limit` labelled rows chosen by the least hash of their id;
scoring covers every word of every row.

Defined results: a null, empty or blank text is one passage of zeros, scored like any other; null doc_ids are neither
trained on nor held out; repeated rows get equal scores; without labels of both classes every score is 1 (nothing is
rejected); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import read, small_batches, text_of, word_hashes
from panelforge.llm.toxicity import held_out, training_rows

PASSAGE, ENCODED, GATE = 64, 12, 8
LIMIT, THRESHOLD = 8000, 0.3
#: Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 dashes and quotes, 7 bars and
#: brackets, 8 other symbols, 9 non-ASCII.
_CLASS = np.full(256, 8, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"-'\"()", b"|[]{}<>/\\")):
    _CLASS[list(_chars)] = _k
_CLASS[ord("!")] = 8
_CLASS[128:] = 9
CLASSES = 10
WIDTH = CLASSES + 9


def passages(text: str | None) -> np.ndarray:
    """One row of WIDTH numbers for each passage of the whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH), dtype=np.float32)
    space = raw <= 32
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])[: n]
    first = np.arange(0, n, PASSAGE)
    cut = start[first]
    cut[0] = 0
    sizes = np.diff(cut, append=len(raw))
    part = np.repeat(np.arange(len(first)), sizes)
    share = np.bincount(part * CLASSES + _CLASS[raw], minlength=len(first) * CLASSES).reshape(-1, CLASSES) / sizes[:, None]
    count = np.diff(first, append=n)
    group = np.repeat(np.arange(len(first)), count)
    same = np.r_[False, words[1:] == words[:-1]]
    last = np.r_[start[1:] - 1, len(raw) - 1]
    final = _CLASS[raw[np.maximum(start, last - 1)]]
    per = lambda x: np.bincount(group, weights=x, minlength=len(first)) / count
    order = np.lexsort((words, group))
    g, w = group[order], words[order]
    fresh = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
    distinct = np.bincount(g[fresh], minlength=len(first)) / count
    overall = len(np.unique(words)) / n
    letters = share[:, 0] + share[:, 1] + share[:, 9]
    out = np.column_stack([
        share, sizes / count / 16, distinct, np.full(len(first), overall), per(same.astype(float)), per(final == 8), per(final == 1),
        share[:, 1] / np.maximum(letters, 1e-6), np.log1p(count) / 4.2, np.full(len(first), np.log1p(n) / 10),
    ])
    return out.astype(np.float32)


@dataclass(frozen=True)
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray] | None

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        if self.w is None:
            return np.ones(len(bags))
        x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
        return _forward(self.w, (x - self.mean) / self.scale, starts)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-h @ w["U"]))
    a = (t * s) @ w["a"]
    sizes = np.diff(starts, append=len(x))
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    a = a / np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"][0], -30, 30)))
    return {"h": h, "t": t, "s": s, "alpha": a, "z": z, "p": p, "sizes": sizes}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    d = (f["p"] - y) * weight / len(y)
    dz = np.repeat(d[:, None] * w["c"], f["sizes"], axis=0)
    alpha, h = f["alpha"], f["h"]
    inner = (dz * h).sum(axis=1)
    da = alpha * (inner - np.repeat(np.add.reduceat(alpha * inner, starts), f["sizes"]))
    gate = da[:, None] * w["a"]
    dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
    dh = (alpha[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], label: np.ndarray, epochs: int = 40, batch: int = 128, seed: int = 7) -> MilModel:
    """Train on bags of passages; both classes weigh the same up to a factor of three."""
    if not bags or not 0 < label.sum() < len(label):
        return MilModel(np.zeros(WIDTH), np.ones(WIDTH), None)
    everything = np.concatenate(bags).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 0.02
    bags = [((b - mean) / scale) for b in bags]
    rng = np.random.default_rng(seed)
    shape = {"E": (WIDTH, ENCODED), "e": (ENCODED,), "V": (ENCODED, GATE), "U": (ENCODED, GATE), "a": (GATE,), "c": (ENCODED,), "b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k.isupper() or k in "ac" else np.zeros(s) for k, s in shape.items()}
    m, v = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    weight = np.where(label == 0, min(3.0, max(1.0, label.sum() / max(1, (label == 0).sum()))), 1.0)
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            x = np.concatenate([bags[j] for j in own])
            starts = np.cumsum([0, *(len(bags[j]) for j in own[:-1])])
            step += 1
            for k, g in _gradient(w, x, starts, label[own], weight[own]).items():
                g = g + 1e-5 * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> MilModel:
    """Passages are described on the executors; the driver gets numbers of the bounded sample only."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "quality", ~held_out(5, 0), limit)

    @F.pandas_udf("binary")
    def described(text: pd.Series) -> pd.Series:
        return pd.Series([passages(t).tobytes() for t in text])

    got = rows.select(described("text").alias("x"), "label").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    bags = [np.frombuffer(bytes(r["x"]), dtype=np.float32).reshape(-1, WIDTH) for r in got]
    return fit(bags, np.array([float(r["label"]) for r in got]))


def quality_score(spark: SparkSession, model: MilModel):
    """A column function text -> score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([passages(t) for t in text]), dtype="float64")

    return score


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = quality_score(spark, train(docs, read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out(5, 0).alias("held_out"), score(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
