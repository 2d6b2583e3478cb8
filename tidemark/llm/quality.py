"""Quality classifier: supervised subword embeddings in numpy.

Hashed vectors of words, of pairs of neighbouring words and of byte n-grams
(3 to 5 bytes, spaces included) are averaged over a document; a softmax over the average gives the class. Training
is plain stochastic gradient descent on a bounded, documented sample of
labelled rows. As average and output are linear, scoring a text is a mean of
one learned number a feature, over the whole text.

A null or empty text has no features and gets the score of the bias alone.
Labels other than 0 and 1 are ignored, as are labels without a document. With
no usable labels every score is 0.5. Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Hasher, giving_back, mix, text_bytes, text_chunks

BITS, DIM, GRAMS = 16, 8, (3, 4, 5)
SAMPLE, EPOCHS, RATE, SEED = 3000, 8, 1.0, 7
THRESHOLD = 0.3


def gram_tables() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 32, (max(GRAMS), 256), dtype=np.uint32)


def features(hasher: Hasher, tables: np.ndarray, data: np.ndarray, offs: np.ndarray):
    """(feature ids, first feature of each text, one past its last) for words, neighbouring words and each n."""
    _, _, h, w = hasher.words(data, offs)
    yield (h >> U64(64 - BITS)).astype(np.int64), w[:-1], w[1:]
    pair = mix(h[:-1] ^ h[1:]) >> U64(64 - BITS)  # unordered, so that all repeated words share one feature
    yield pair.astype(np.int64), w[:-1], np.maximum(w[:-1], w[1:] - 1)
    total = np.zeros(len(data), np.uint32)
    for j in range(max(GRAMS)):
        total = total[: max(0, len(data) - j)] + tables[j][data[j:]]
        if (n := j + 1) in GRAMS:
            ids = ((total ^ np.uint32(n * 0x1E3779B9)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            yield ids, offs[:-1], np.maximum(offs[:-1], offs[1:] - n + 1)


def document_features(hasher, tables, data, offs) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their shares."""
    parts = list(features(hasher, tables, data, offs))
    out = []
    for k in range(len(offs) - 1):
        ids, n = np.unique(np.concatenate([p[a[k] : b[k]].astype(np.int64) for p, a, b in parts]), return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: list, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The weight of each feature and the bias, of class 1 against class 0."""
    if len(labels) == 0:
        return np.zeros(1 << BITS, np.float32), 0.0
    hasher, tables = Hasher(), gram_tables()
    docs = [document_features(hasher, tables, *text_bytes(pa.array([t], pa.string())))[0] for t in texts]
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)).tolist():
            ids, share = docs[k]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = emb[ids]
            mean = share @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[int(labels[k])] -= 1
            back = out @ err
            out -= rate * np.outer(mean, err)
            bias -= 0.1 * rate * err
            # shares are far below 1, so a vector's own step is scaled up to its document's number of features
            emb[ids] = rows - np.outer(rate * np.minimum(1, share * len(ids)), back)
    return emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on at most ``sample`` labelled documents, those with the smallest hash of their key; one task holds them."""
    chosen = labels.select(key, F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)").groupBy(key).agg(F.max("_label").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), key)
    rows = rows.groupBy(key).agg(F.min(text).alias("_text"), F.first("_label").alias("_label"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        weights, bias = fit(pdf["_text"].tolist(), pdf["_label"].to_numpy())
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    found = rows.groupBy(F.lit("all").alias("_all")).applyInPandas(giving_back(learn), "weights binary, bias double").collect()
    if not found:
        return fit([], np.zeros(0))
    return np.frombuffer(found[0]["weights"], "<f4"), found[0]["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", keep: tuple = (), score: str = "score") -> DataFrame:
    """key, the columns in ``keep`` and the score, in a column named ``score``, of every document; the model is 256 KB whatever the input."""
    weights, bias = model
    names = [key, *(c for c in keep if c != key)]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + f", `{score}` double"

    def run(batches):
        hasher, tables = Hasher(), gram_tables()
        for cols, data, offs in text_chunks(batches, names, text):
            total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
            for ids, a, b in features(hasher, tables, data, offs):
                sums = np.zeros(len(ids) + 1)
                np.cumsum(weights[ids], out=sums[1:])
                a, b = np.minimum(a, len(ids)), np.minimum(np.maximum(a, b), len(ids))
                total += sums[b] - sums[a]
                count += b - a
            z = total / np.maximum(count, 1) + bias
            yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], [*names, score])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def accepted(score, threshold: float = THRESHOLD):
    return (score >= threshold).cast("int")
