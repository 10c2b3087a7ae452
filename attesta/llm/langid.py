"""Language identification by error-correcting output codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import _LOWER, _PUNCT, batches
from .storage import free_names

#: Feature space of the byte n-grams; rows of each language that the fit reads,
#: of which one in TRUST measures the bits instead of teaching them.
BITS, FIT_ROWS, TRUST = 14, 2000, 5
ADDED = ("lang_pred", "lang_score", "lang_ambiguous")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 2- and 3-grams of all texts, in order, and where each text's
    start (with the end). ASCII letters are lowered; ASCII digits and marks
    count as one blank; a blank stands before and after each text."""
    a = _LOWER[np.frombuffer(b"  " + b"   ".join(texts) + b"   ", np.uint8)].astype(np.uint32)
    blank = _PUNCT.copy()
    blank[48:58] = True
    a[blank[a]] = 32
    h2 = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
    h3 = h2[:-1] * np.uint32(0x27D4EB2F) + a[2:] * np.uint32(0xC2B2AE3D)
    both = np.empty((len(h3), 2), np.uint32)
    both[:, 0], both[:, 1] = h2[:-1], h3
    both ^= both >> np.uint32(15)
    both *= np.uint32(0x2C1B3C6D)
    size = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    return (both >> np.uint32(32 - BITS)).ravel(), 2 * np.minimum(np.concatenate(([0], np.cumsum(size))), len(h3))


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of 1 and -1. Up to 7 languages: every split of them into two
    parts; more: random columns, of several draws the one whose two nearest
    rows lie furthest apart."""
    if n <= 7:
        cols = [[1] + [1 if s >> k & 1 else -1 for k in range(n - 1)] for s in range(2 ** max(n - 1, 0) - 1)]
        return np.array(cols or [[1] * n]).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(50):
        m = rng.choice([-1, 1], (n, 15 * int(np.ceil(np.log2(n)))))
        d = m.shape[1] - (m @ m.T)
        np.fill_diagonal(d, 1 << 30)
        if d.min() > far:
            best, far = m, d.min()
    return best


@dataclass
class Model:
    """Per bit, weights of the n-grams and of the bit in decoding."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language, share of it) by loss-weighted decoding: the codeword of
        least total loss log(1 + exp(-bit * margin)), each bit weighted by
        trust. The share is that of exp(-loss) among all languages."""
        g, cuts = grams(texts)
        n = np.maximum(np.diff(cuts), 1)
        margin = np.stack([np.add.reduceat(w[g], cuts[:-1]) / np.sqrt(n) for w in self.weights], 1)
        loss = np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(1) for row in self.code], 1)
        order = np.argmin(loss, axis=1)
        share = np.exp(loss.min(1)[:, None] - loss)
        return order, 1 / share.sum(1)


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """A model from about ``fit_rows`` rows of each language (all, if fewer)
    for which ``usable`` holds, picked by hash of the id; null texts and
    languages are left out.

    Tasks count n-grams per language; the sums make, for every bit of the
    code, a classifier of the log odds of n-grams between the languages on
    either side. One in TRUST of the sampled texts is kept from that: the rate
    of these that a bit gets right, (right + 1) / (texts + 2), is its trust.
    Nothing of the kind usable: a model without languages.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    count = {r["l"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("l")).count().collect()}
    langs = sorted(count)
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((1, 1 << BITS)), np.ones(1))
    share = F.create_map(*[x for k, v in count.items() for x in (F.lit(k), F.lit(min(1.0, fit_rows / v)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) / float(1 << 20)
    kept_back = F.pmod(F.xxhash64(F.lit("trust"), id_col), F.lit(TRUST)) == 0
    sample = known.where(draw < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"), F.coalesce(kept_back, F.lit(False)).alias("back")
    )

    def counts(it):
        sums: dict[str, np.ndarray] = {}
        for b in it:
            names = np.array(b.column(0).to_pylist(), object)
            for first, texts in batches(b.column(1)):
                g, cuts = grams(texts)
                of = names[first : first + len(texts)]
                for lang in set(of):
                    own = np.concatenate([g[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(of == lang)])
                    sums[lang] = sums.get(lang, 0) + np.bincount(own, minlength=1 << BITS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "gram", "n"])

    table = np.zeros((len(langs), 1 << BITS))
    total = sample.where("NOT back").mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    where = {k: i for i, k in enumerate(langs)}
    for b in total.toArrow().to_batches():  # 2**BITS sums a language at most
        table[[where[x] for x in b.column("lang").to_pylist()], b.column("gram").to_numpy()] = b.column("n").to_numpy()
    freq = table / np.maximum(table.sum(1, keepdims=True), 1)
    code = codewords(len(langs))
    floor = 0.5 / max(1.0, table.sum() / len(langs))
    weights = np.stack(
        [np.log((freq[col > 0].mean(0) if (col > 0).any() else 0) + floor) - np.log((freq[col < 0].mean(0) if (col < 0).any() else np.zeros(1 << BITS)) + floor) for col in code.T]
    )
    model = Model(langs, code, weights, np.ones(code.shape[1]))
    if len(langs) > 1:
        model.trust = _trust(sample.where("back"), model, spark)
    else:
        model.weights = np.zeros_like(weights)
    return model


def _trust(sample: DataFrame, model: Model, spark) -> np.ndarray:
    shared = spark.sparkContext.broadcast(model)

    def right(it):
        m = shared.value
        where = {k: i for i, k in enumerate(m.langs)}
        for b in it:
            names = b.column(0).to_pylist()
            for first, texts in batches(b.column(1)):
                g, cuts = grams(texts)
                bits = m.code[[where[x] for x in names[first : first + len(texts)]]]
                margin = np.stack([np.add.reduceat(w[g], cuts[:-1]) for w in m.weights], 1)
                ok = (margin * bits > 0).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ok))), pa.array(ok), pa.array([len(texts)] * len(ok))], ["bit", "ok", "n"])

    rate = np.full(model.code.shape[1], 0.5)
    for r in sample.mapInArrow(right, "bit long, ok long, n long").groupBy("bit").agg(((F.sum("ok") + 1) / (F.sum("n") + 2)).alias("rate")).collect():
        rate[r["bit"]] = r["rate"]
    return rate


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, sure: float = 0.6) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, lang_score (0 to 1)
    and lang_ambiguous, or, where these names are taken, with what
    ``free_names`` makes of them; the columns kept stay as they are.

    Null texts and those without a letter are ``und`` with score 0, and so is
    everything without learned languages. A prediction is ambiguous if its
    share among all languages is below ``sure``. Rows that repeat an id are
    rows like others; an empty table gives an empty one. Each text counts as a
    whole, however long. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    added = list(free_names(kept, ADDED).values())
    schema = docs.select(*[f"`{c}`" for c in kept]).schema
    at, text_at = len(kept), kept.index(text_col) if text_col in kept else len(kept) + 1
    for n, t in zip(added, ("string", "double", "boolean")):
        schema = schema.add(n, t)

    def run(it):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in it:
            letters = np.array(b.column(at).to_pylist(), bool)
            best, share = [], []
            for _, texts in batches(b.column(text_at)) if m.langs else []:
                x, s = m.decode(texts)
                best.append(x)
                share.append(s)
            best = np.concatenate(best) if best else np.zeros(b.num_rows, int)
            share = np.concatenate(share) if share else np.zeros(b.num_rows)
            known = letters & bool(m.langs)
            pred, score = np.where(known, names[best], "und"), np.where(known, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:at], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(~known | (score < sure))], [*kept, *added]
            )

    letter = F.coalesce(F.col(f"`{text_col}`").rlike("\\p{L}"), F.lit(False))
    more = [] if text_col in kept else [F.col(f"`{text_col}`").alias("__text")]
    return docs.select(*[f"`{c}`" for c in kept], letter.alias("__letter"), *more).mapInArrow(run, schema)
