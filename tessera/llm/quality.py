"""Quality classifier from compression.

A zstandard dictionary is built from texts labelled good and one from texts labelled bad. A text is
compressed with each; the normalised difference of the sizes, (bad - good) / (bad + good), says which
dictionary knows its language better. Logistic regression on that difference, its square and the
ratios of the compressed sizes to the text's size calibrates it to a probability.

``fit`` uses a bounded sample of labelled rows (``rows`` of each class, whole texts, until
``sample_bytes`` of each class are gathered), drawn by a hash of the id: one half builds the
dictionaries, the other calibrates. ``score`` reads whole texts only; labels, language, source and
id are no inputs.

Defined cases: a null text counts as empty; an empty text scores by its size features like any other;
an id whose labels contradict each other, or whose label is null, teaches nothing; where a class has no
labelled row, every score is the share of the other (0.5 without any label); null and repeated ids
keep their rows; an empty table gives an empty result; further columns are passed on by ``keep``
and ignored by ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Model:
    """Two dictionaries, weights of the features (the constant first), and the training share of good rows."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    level: int = 3


def features(model: Model, texts: list[bytes]) -> np.ndarray:
    """A row of features for each text."""
    g, b, p = _compressors(model.good, model.bad, model.level)
    size = np.array([len(t) for t in texts], np.float64)
    good = np.array([len(g.compress(t)) for t in texts], np.float64)
    bad = np.array([len(b.compress(t)) for t in texts], np.float64)
    plain = np.array([len(p.compress(t)) for t in texts], np.float64)
    d = (bad - good) / (bad + good)
    whole = size + 16
    return np.stack([np.ones(len(texts)), 8 * d, 32 * d * d, good / whole, bad / whole, plain / whole, np.log((plain + 16) / whole), np.log(whole) / 8], axis=1)


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes, level: int):
    import zstandard as z

    def made(data: bytes):
        return z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(data) if data else None, write_content_size=False, write_checksum=False, write_dict_id=False)

    return made(good), made(bad), made(b"")


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the texts themselves as raw content where there are too few to train."""
    import zstandard as z

    try:
        return z.train_dictionary(size, texts).as_bytes()
    except z.ZstdError:
        return b"\n".join(texts)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) / 10
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w / 10)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(good: list[bytes], bad: list[bytes], dict_size: int = 112_640, level: int = 3) -> Model:
    """A model from labelled texts: even places build the dictionaries, odd ones calibrate."""
    n = len(good) + len(bad)
    prior = len(good) / n if n else 0.5
    if not good or not bad:
        return Model(b"", b"", (), prior, level)
    half = [x if len(x) > 1 else x * 2 for x in (good, bad)]
    model = Model(_dictionary(half[0][::2], dict_size), _dictionary(half[1][::2], dict_size), (), prior, level)
    x = features(model, half[0][1::2] + half[1][1::2])
    y = np.r_[np.ones(len(half[0][1::2])), np.zeros(len(half[1][1::2]))]
    return Model(model.good, model.bad, tuple(_logistic(x, y).tolist()), prior, level)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, sample_bytes: int = 12 << 20, dict_size: int = 112_640) -> Model:
    """The model of a bounded sample of the labelled documents (labels: doc_id, quality)."""
    agreed = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    agreed = agreed.filter("quality = most").select(F.col("doc_id").alias("id"), "quality", F.xxhash64("doc_id").alias("h"))
    texts: list[list[bytes]] = [[], []]
    for q in (0, 1):
        # at most `rows` ids: their bound makes the broadcast safe
        chosen = F.broadcast(agreed.filter(F.col("quality") == q).orderBy("h", "id").limit(rows))
        found = docs.select(F.col("doc_id").alias("id"), "text").filter("text is not null").join(chosen, "id").select("h", "id", F.col("text").cast("binary").alias("text"))
        total = 0
        for row in found.orderBy("h", "id", F.xxhash64("text")).toLocalIterator():
            texts[q].append(bytes(row.text))
            total += len(row.text)
            if total >= sample_bytes:
                break
    return train(texts[1], texts[0], dict_size)


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    return 1 / (1 + np.exp(-np.clip(features(model, texts) @ np.array(model.weights), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each whole text: the probability that its label is 1."""

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(model, texts))], ["doc_id", "score"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id")], "doc_id long, score double", f)


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with all their columns."""

    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = common.text_bytes(batch.column(at))
            mask = np.concatenate([np.zeros(0, bool), *(probabilities(model, texts[a:b]) >= least for a, b in common.grouped([len(t) for t in texts]))])
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)
