"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and
skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import batches, mix, window_hashes, words
from .storage import drop, written

#: Feature space, and the bounds of what the fit reads: rows of each class, and
#: features (4 bytes each) of all of them.
BITS, FIT_ROWS, FIT_FEATURES = 20, 4000, 16 << 20
#: Words taken together: one, two neighbours, two with one or two between.
GRAMS = ((), (1,), (2,), (3,))


def _hashed(texts: list[bytes]):
    """(text, feature) arrays, one pair for each kind of feature; features may
    repeat."""
    h, bounds = words(texts, plain=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    cut = np.uint64(64 - BITS)
    for g in GRAMS:
        f = window_hashes(h, g) if g else mix(h)
        near = doc[: len(f)] == doc[len(doc) - len(f) :]
        yield doc[: len(f)][near], (f[near] >> cut).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for all distinct features of each text."""
    docs, found = zip(*_hashed(texts))
    both = np.unique(np.concatenate(docs) << BITS | np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    """Nonzero weights alone."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the class for each text, each feature once."""
        dense = np.zeros(1 << BITS, bool)
        dense[self.index] = True
        docs, found = zip(*((d[hit], f[hit]) for d, f in _hashed(texts) for hit in [dense[f]]))
        both = np.unique(np.concatenate(docs) << BITS | np.concatenate(found))
        w = self.weight[np.searchsorted(self.index, both & ((1 << BITS) - 1))] if len(self.index) else np.zeros(0)
        z = self.bias + np.bincount(both >> BITS, w, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (index, value) and bias after ``epochs`` passes in a fixed
    shuffled order. Each coordinate has its own rate, falling with the square
    sum of its gradients; weights whose sum stays under ``l1`` are 0. The bias
    isn't penalised."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    lam1 = np.full(size + 1, l1)
    lam1[size] = 0
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = rows[r]
            zi, root = z[i], np.sqrt(n[i])
            w = -np.sign(zi) * np.maximum(np.abs(zi) - lam1[i], 0) / ((beta + root) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[r]
            up = np.sqrt(n[i] + g * g)
            z[i] += g - (up - root) / alpha * w
            n[i] += g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - lam1, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    index = np.flatnonzero(w[:size])
    return index, w[index], float(w[size])


def train(t: pa.Table, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> pa.Table:
    """One row: weights, bias, toxic rows and rows of a table (id, y, found:
    features as 32-bit numbers), in the order of the ids.

    While a weight is 0, its sum moves by at most 1 a row and pass. So features
    of at most l1 / epochs rows never get one and are left out beforehand."""
    t = t.sort_by("id")
    y = t.column("y").to_numpy()
    rows = [np.frombuffer(f.as_py(), "<i4") for f in t.column("found")]
    often = np.zeros(1 << BITS, np.int64)
    for r in rows:
        often[r] += 1
    rows = [np.append(r[often[r] * epochs > l1], 1 << BITS) for r in rows]
    index, weight, bias = ftrl(rows, y, epochs, alpha, beta, l1, l2)
    return pa.table(
        [pa.array([index.tobytes()]), pa.array([weight.tobytes()]), pa.array([bias]), pa.array([int(y.sum())]), pa.array([len(y)])],
        ["index", "weight", "bias", "ones", "n"]
    )


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0,
    l2: float = 0.1
) -> Model:
    """A model from at most ``fit_rows`` labelled rows of each class for which
    ``usable`` (a condition on the id) holds, and of these as many as have
    about ``fit_features`` features together, both picked by hash of the id.

    The bounds make the sample small enough to be broadcast for finding its
    texts, and its features for one task to go through them in order; the
    texts become features where they are read. The bias is shifted by what the
    sampling changed of the odds. Ids labelled twice count as toxic if one
    label says so; null ids, labels and texts are left out. Without rows of
    both classes the score is the rate of the labels (0 without any).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    count = {r["y"]: r["count"] for r in known.where(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    rate = count.get(1, 0) / max(1, sum(count.values()))
    flat = Model(np.empty(0, np.int64), np.empty(0), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
    if not count.get(0) or not count.get(1):
        return flat
    order = (F.xxhash64(F.lit("sample"), "id"), "id")
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(fit_rows) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text")
    ).join(sample, F.col("doc") == F.col("id")).where("text IS NOT NULL").select("id", F.col("y").cast("double").alias("y"), "text")

    def found(it):
        for b in it:
            for first, texts in batches(b.column(2)):
                d, f = features(texts)
                cuts = np.searchsorted(d, np.arange(len(texts) + 1))
                own = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), own.column(1), pa.array(np.diff(cuts), pa.int64()),
                        pa.array([f[p:q].astype("<i4").tobytes() for p, q in zip(cuts[:-1], cuts[1:])], pa.binary())
                    ],
                    ["id", "y", "n", "found"]
                )

    feats = written(rows.mapInArrow(found, "id long, y double, n long, found binary"), "features")
    share = min(1.0, fit_features / (feats.agg(F.sum("n")).first()[0] or 1))
    kept = feats.where(F.pmod(F.xxhash64(F.lit("features"), "id"), F.lit(1 << 20)) < share * (1 << 20))
    got = kept.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: train(t.select(["id", "y", "found"]), epochs, alpha, beta, l1, l2),
        "index binary, weight binary, bias double, ones long, n long"
    ).first()
    drop(feats)
    if got is None or not 0 < got["ones"] < got["n"]:
        return flat
    shift = np.log(rate / (1 - rate)) - np.log(got["ones"] / (got["n"] - got["ones"]))
    return Model(np.frombuffer(got["index"], np.int64), np.frombuffer(got["weight"], np.float64), got["bias"] + float(shift))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold``) of every row, each
    text as a whole, however long. Null texts count as empty: their score is
    the bias alone. Null and repeated ids are rows like others; other columns
    of any name go. Empty table: no rows. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            done = [shared.value.scores(texts) for _, texts in batches(b.column(1))]
            if done:
                s = np.concatenate(done)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, score double, predicted int")
