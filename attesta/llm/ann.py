"""Approximate nearest neighbours by adaptive dimension scan.

An inverted file over k-means lists holds every vector. Inside a probed list
the randomly rotated vectors are read in blocks of columns; after each block a
hypothesis test compares the distance extrapolated from the columns so far
with the distance that the k-th best inner product so far allows this
candidate, and abandons the losers.

A first pass scans each query's nearest list; the k-th best score found there
travels with the query to its other lists, which so abandon early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import written

#: The centroids are fitted on so many vectors at most, and so many bytes; a
#: list has so many of them at least.
FIT_ROWS, FIT_BYTES, FIT_LIST = 65536, 32 << 20, 16
MAX_LISTS = 4096
#: Bytes of a list's vectors that one task holds; pairs it compares at once.
CHUNK_BYTES, PAIRS = 16 << 20, 1 << 21
HITS = "query_row long, query_id long, row long, vec_id long, score double"


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, vec): the rows that take part, as a table in the shared
    folder, so that ``row`` names each of them for good.

    Null ids, null and zero vectors and those with a null or non-finite
    component take no part. Rows that repeat an id, or id and vector, are
    vectors of their own. Other columns go, whatever their names.
    """
    element = getattr(df.schema[vec_col].dataType, "elementType", None)
    kind = "float" if element is not None and element.typeName() == "float" else "double"
    v = F.col("vec")
    ok = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast(f"array<{kind}>").alias("vec")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(
            v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)
        ) & F.exists(v, lambda x: x != 0)
    )
    return written(ok.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec"), "vectors")


class Index:
    """Rotation and centroids; what tasks need to place and scan vectors.

    Vectors are scaled by the longest norm. For placing them, one more
    coordinate gives all of them norm 1, so that the largest inner product is
    the smallest distance; the scan works on their own coordinates.
    """

    def __init__(self, sample: np.ndarray, longest: float, lists: int, k: int, recall: float, seed: int = 7):
        self.dim, self.longest = sample.shape[1], longest
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        x = self.lifted(sample)
        self.centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            at = self.nearest(x, 1)[:, 0]
            order = np.argsort(at, kind="stable")
            own, first = np.unique(at[order], return_index=True)
            self.centroids[own] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        self.probes = self._probes(sample / longest, x, k, recall)

    def lifted(self, vecs: np.ndarray, query: bool = False) -> np.ndarray:
        v = vecs / self.longest
        return np.column_stack([v, np.zeros(len(v)) if query else np.sqrt(np.maximum(1 - (v * v).sum(1), 0))])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argmin(d, axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]

    def _probes(self, v: np.ndarray, x: np.ndarray, k: int, recall: float) -> int:
        """Fewest lists that hold ``recall`` of the k nearest inside the sample."""
        q = v[:1024]
        s = q @ v.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(v) - 1)
        if k < 1:
            return 1
        true = np.argpartition(-s, k - 1, axis=1)[:, :k]
        rank = np.argsort(self.nearest(self.lifted(q * self.longest, True), len(self.centroids)), axis=1)
        need = np.take_along_axis(rank, self.nearest(x, 1)[:, 0][true], axis=1) + 1
        return int(np.quantile(need, recall, method="higher"))


def fit(vectors: DataFrame, dim: int, n: int, longest: float, k: int = 20, recall: float = 0.95, fit_rows: int = FIT_ROWS) -> Index:
    """Centroids for the ``n`` vectors of length ``dim``, from a sample of 8192
    or FIT_LIST * 2 a list, bounded by ``fit_rows`` and FIT_BYTES, picked by
    hash. The number of probes is the least that finds ``recall`` of each
    sampled vector's neighbours in the sample: as many as the sample's share
    of k, one at least."""
    lists = int(np.clip(np.sqrt(n) / 4, 1, MAX_LISTS))
    limit = max(64, min(fit_rows, max(8192, 2 * FIT_LIST * lists), FIT_BYTES // (8 * dim)))
    rows = vectors.where(F.size("vec") == dim).orderBy(F.xxhash64("row", "vec_id"), "row").limit(limit).collect()
    near = max(1, -(-k * len(rows) // n))
    return Index(np.array([r["vec"] for r in rows], float), longest, min(lists, max(1, len(rows) // FIT_LIST)), near, recall)


def _dots(x: np.ndarray, xi: np.ndarray, q: np.ndarray, qi: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(xi)), max(1, (4 << 20) // (8 * x.shape[1]))
    for a in range(0, len(xi), step):
        out[a : a + step] = np.einsum("ij,ij->i", x[xi[a : a + step]], q[qi[a : a + step]])
    return out


class Block:
    """Vectors of one list, by columns, as one task holds them. Of vectors
    equal in all components the k + 1 of smallest id are enough for any query,
    as ties go to the smaller id."""

    def __init__(self, index: Index, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int, width: int = 16):
        same = np.unique(np.ascontiguousarray(vecs).view(f"V{vecs.itemsize * vecs.shape[1]}").ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((rows, ids, same))
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        keep = np.sort(order[place <= k])
        self.index, self.rows, self.ids, self.vecs = index, rows[keep], ids[keep], vecs[keep].astype(float)
        self.by_row = np.argsort(self.rows, kind="stable")
        self.x = (self.vecs / index.longest) @ index.turn
        full = index.dim
        self.cuts = [*range(width, full, width), full]
        self.cols = [np.ascontiguousarray(self.x[:, a:b].T) for a, b in zip([0, *self.cuts], self.cuts)]
        self.head = np.cumsum([(c * c).sum(0) for c in self.cols], axis=0)

    def scan(
        self, qrows: np.ndarray, vecs: np.ndarray, bound: np.ndarray, k: int, strict: float = 1.2, stats: dict | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of the k best for each query, its own row
        left out. ``bound``: scores below it aren't wanted (-inf: none known).

        For an inner product of at least t, a candidate x of query q may have
        the squared distance |x|^2 + |q|^2 - 2 t. Its distance in the first d
        of D rotated columns, times D / d, estimates the whole one; above
        (1 + strict / sqrt(d))^2 times what is allowed it is abandoned. A
        query without a bound takes that of the best of 4 k candidates seeded
        by the first block's estimate, which are never abandoned.
        """
        ix, full, n = self.index, self.index.dim, len(self.rows)
        q = (vecs / ix.longest) @ ix.turn
        qhead = np.cumsum([(q[:, a:b] ** 2).sum(1) for a, b in zip([0, *self.cuts], self.cuts)], axis=0)
        at = self.by_row[np.minimum(np.searchsorted(self.rows[self.by_row], qrows), n - 1)]
        own = np.flatnonzero(self.rows[at] == qrows)
        s = q[:, : self.cuts[0]] @ self.cols[0]
        alive = np.ones(s.shape, bool)
        alive[own, at[own]] = False
        tau = bound / ix.longest / ix.longest
        seeds = np.zeros(s.shape, bool)
        blind = np.flatnonzero(~np.isfinite(tau))
        if len(blind):
            few = min(n, 4 * k)
            part = self.head[0] - 2 * s[blind]  # the query's own share is the same for all
            guess = part * (full / self.cuts[0]) - self.head[-1]
            guess[~alive[blind]] = np.inf
            pick = np.argpartition(guess, few - 1, axis=1)[:, :few]
            seeds[blind[:, None], pick] = alive[blind[:, None], pick]
            exact = np.where(seeds[blind[:, None], pick], _dots(self.x, pick.ravel(), q, np.repeat(blind, few)).reshape(pick.shape), -np.inf)
            tau[blind] = np.partition(exact, few - k, axis=1)[:, few - k] if few >= k else -np.inf
        tau = tau - 1e-12
        qi = xi = None
        for b, done in enumerate(self.cuts):
            if b and qi is None:
                s += q[:, self.cuts[b - 1] : done] @ self.cols[b]
            elif b:
                s = s + _dots(self.x[:, self.cuts[b - 1] : done], xi, q[:, self.cuts[b - 1] : done], qi)
            if stats is not None:
                width = done - (self.cuts[b - 1] if b else 0)
                stats["read"] = stats.get("read", 0) + width * (int(alive.sum()) if qi is None else len(qi))
                stats["all"] = stats.get("all", 0) + width * alive.size
            if qi is None:
                if done < full:
                    allowed = (self.head[-1] + (qhead[-1] - 2 * tau)[:, None]) * ((1 + strict / np.sqrt(done)) ** 2 * done / full)
                    alive &= (self.head[b] + qhead[b][:, None] - 2 * s <= allowed) | seeds
                else:
                    alive &= s >= tau[:, None]
                if done == full or np.count_nonzero(alive) < 0.2 * alive.size:
                    qi, xi = np.nonzero(alive)
                    s = s[qi, xi]
            else:
                if done < full:
                    allowed = (self.head[-1][xi] + (qhead[-1] - 2 * tau)[qi]) * ((1 + strict / np.sqrt(done)) ** 2 * done / full)
                    ok = (self.head[b][xi] + qhead[b][qi] - 2 * s <= allowed) | seeds[qi, xi]
                else:
                    ok = s >= tau[qi]
                qi, xi, s = qi[ok], xi[ok], s[ok]
        score = _dots(self.vecs, xi, vecs, qi)
        order = np.lexsort((self.rows[xi], self.ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        return qi[keep], xi[keep], score[keep]


def _vectors(column: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _search(vectors: DataFrame, queries: DataFrame, index: Index, n: int, k: int) -> DataFrame:
    """HITS among the vectors of the index's length. Every vector is placed
    and shuffled once a pass; a query goes to the lists it probes. Lists of
    more than CHUNK_BYTES are cut into parts by hash, and a task streams the
    queries of a part past its vectors."""
    spark, dim = vectors.sparkSession, index.dim
    shared = spark.sparkContext.broadcast(index)
    kind = "<f4" if vectors.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"

    def place(first: int, last: int, query: bool):
        def run(it):
            ix = shared.value
            for b in it:
                for a in range(0, b.num_rows, 1024):
                    part = b.slice(a, 1024)
                    vec = np.array(part.column("vec").flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)
                    near = ix.nearest(ix.lifted(vec.astype(float), query), last)[:, first:]
                    times = near.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(near.ravel().astype(np.int32)),
                            *(pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), times)) for c in ("row", "vec_id", "bound")),
                            pa.array([v.tobytes() for v in vec for _ in range(times)], pa.binary())
                        ], ["list", "row", "id", "bound", "raw"]
                    )

        return run

    own = F.size("vec") == dim
    free = F.lit(float("-inf")).alias("bound")
    placed = "list int, row long, id long, bound double, raw binary"
    base = written(vectors.where(own).select("row", "vec_id", free, "vec").mapInArrow(place(0, 1, False), placed), "placed")
    most = max(1, CHUNK_BYTES // (dim * np.dtype(kind).itemsize))
    big = {r["list"]: -(-r["count"] // most) for r in base.groupBy("list").count().where(F.col("count") > most).collect()}  # lists: MAX_LISTS at most
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in big.items() for x in kv])[F.col("list")], F.lit(1)) if big else F.lit(1)

    def both(it):
        ix, key, held, block = shared.value, None, [], None
        for b in it:
            at = np.stack([b.column(c).to_numpy() for c in ("list", "part", "kind")])
            edge = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *edge], [*edge, b.num_rows]):
                if lo == hi:
                    continue
                run, here = b.slice(lo, hi - lo), tuple(at[:2, lo])
                if here != key:
                    key, held, block = here, [], None
                if at[2, lo] == 0:
                    held.append(run)
                    continue
                if block is None and held:
                    t = pa.Table.from_batches(held)
                    held, block = [], Block(ix, t.column("row").to_numpy(), t.column("id").to_numpy(), _vectors(t.column("raw"), dim, kind), k)
                step = max(1, PAIRS // len(block.rows)) if block else hi - lo
                for a in range(0, hi - lo if block else 0, step):
                    part = run.slice(a, step)
                    rows, ids = part.column("row").to_numpy(), part.column("id").to_numpy()
                    qi, xi, score = block.scan(rows, _vectors(part.column("raw"), dim, kind).astype(float), part.column("bound").to_numpy(), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[qi]), pa.array(ids[qi]), pa.array(block.rows[xi]), pa.array(block.ids[xi]), pa.array(score)],
                        ["query_row", "query_id", "row", "vec_id", "score"]
                    )

    def scanned(asked: DataFrame) -> DataFrame:
        left = base.select("list", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "row", "id", "bound", "raw")
        right = asked.select(
            "list", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), F.lit(1).alias("kind"), "row", "id", "bound",
            "raw"
        )
        return left.union(right).repartition("list", "part").sortWithinPartitions("list", "part", "kind").mapInArrow(both, HITS)

    asked = queries.where(own)
    hits = written(scanned(asked.select("row", "vec_id", free, "vec").mapInArrow(place(0, 1, True), placed)), "hits")
    if index.probes == 1:
        return hits
    best = _best(hits, k).groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") == k)
    known = asked.join(best, F.col("row") == F.col("query_row"), "left").select(
        "row", "vec_id", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), "vec"
    )
    return hits.union(scanned(known.mapInArrow(place(1, index.probes, True), placed)))


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The k best of ``vectors`` for each of ``queries`` (rows of the same
    table, as from ``valid_vectors``): query_id, rank, vec_id, score. The score
    is the inner product of the original vectors in double precision; ties go
    to the smaller id. Candidates are all rows but the query's own, so copies
    under its id count. A vector meets those of its own length alone; each
    length has its index. Fewer candidates than k: all that were found; none:
    no rows. A query whose id repeats gets its ranks for each of its rows.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("peak")) * (x / F.col("peak")))) * F.col("peak")
    facts = vectors.select(
        F.size("vec").alias("dim"), F.array_max(F.transform("vec", F.abs)).cast("double").alias("peak"), "vec"
    ).groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("longest"))
    hits = vectors.sparkSession.createDataFrame([], HITS)
    for f in facts.orderBy("dim").collect():
        hits = hits.union(_search(vectors, queries, fit(vectors, f["dim"], f["n"], f["longest"], k, recall, fit_rows), f["n"], k))
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")
