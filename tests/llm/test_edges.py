"""Output contracts, odd inputs and brute-force versions of the operators."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import ann, langid, line_dedup, media, mixing, packing, queries, sharding, token_counts, toxicity
from attesta.llm.storage import free_names

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ann": "query_id rank vec_id score",
    "op2_line_dedup": "doc_id n_lines lines_removed kept_chars kept_md5",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_token_counts": "doc_id section start length tokens doc_tokens",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_langid": "doc_id held_out lang_pred score",
    "op10_jaccard": "doc_id n_shingles component_id",
}
#: Every name an operator adds, as columns of the user.
TAKEN = ["n_lines", "lines_removed", "size", "source_size", "times", "taken", "target", "copy", "shard", "slot", "lang_pred", "Lang_Score", "lang_ambiguous", "key", "hash", "id", "th", "row", "dim", "k0"]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_contract(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert list(got.columns)[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    if name != "op1_ann":
        assert set(got.doc_id) == set(docs.doc_id)
    if name not in ("op1_ann", "op4_token_counts", "op5_packing"):
        assert len(got) == len(docs)
    if name in queries.ORACLES:
        db = duckdb.connect()
        for f in os.listdir(SF):
            db.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        want = db.sql(queries.ORACLES[name]).df()
        key = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False, rtol=1e-12)


def test_free_names():
    assert free_names(["A", "a_"], ["a", "b", "B"]) == {"a": "a__", "b": "b", "B": "B_"}


# --- nearest neighbours ---


def brute(x, ids, k):
    score = x[np.flatnonzero(ids % 20 == 0)] @ x.T
    own = np.flatnonzero(ids % 20 == 0)
    score[np.arange(len(own)), own] = -np.inf
    return {(int(ids[q]), n): [int(i) for i in ids[np.lexsort((ids, -row))[:k]]] for n, (q, row) in enumerate(zip(own, score))}


@pytest.mark.parametrize("kind", ["random", "uneven", "clustered"])
def test_ann_recall_beyond_the_sample(spark, kind):
    rng = np.random.default_rng(4)
    n = 5000
    x = rng.standard_normal((n, 48))
    if kind == "uneven":
        x *= np.exp(rng.standard_normal((n, 1)))
        x[5] *= 20
    if kind == "clustered":
        x = x / 2 + rng.standard_normal((100, 48))[rng.integers(0, 100, n)]
    v = ann.valid_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = ann.search(v, v.where("vec_id % 20 = 0"), 20, fit_rows=1500).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == n // 20
    found = got.groupby("query_id").vec_id.apply(set)
    assert np.mean([len(found[q] & set(w)) / 20 for (q, _), w in brute(x, np.arange(n), 20).items()]) >= 0.9


def test_ann_takes_every_row(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (7, [0.5, 0.5]), (8, [3.0]), (40, [2.0])]
    v = ann.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(v, v.where("vec_id % 20 = 0"), 20).collect()
    first = sorted((r.vec_id, r.score) for r in got if r.query_id == 20)
    # the row (1, 0) meets both others of its id; each of those meets its copy
    assert first == sorted([(20, 0.0), (20, 0.0), (7, 0.5)] + 2 * [(20, 0.0), (20, 1.0), (7, 0.5)])
    assert [(r.vec_id, r.score) for r in got if r.query_id == 40] == [(8, 6.0)]  # its own length alone
    same = ann.valid_vectors(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<double>"))
    ties = ann.search(same, same.where("vec_id % 20 = 0"), 20).toPandas()
    assert all(g.vec_id.tolist() == [i for i in range(21) if i != q][:20] for q, g in ties.sort_values("rank").groupby("query_id"))


def test_scan_abandons_and_never_itself():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 64))[rng.integers(0, 20, 3000)] * 3 + rng.standard_normal((3000, 64))
    longest = np.sqrt((x * x).sum(1).max())
    index, rows, stats = ann.Index(x[:1000], longest, 1, 10, 0.95), np.arange(3000), {}
    block = ann.Block(index, rows, rows, x, 10)
    q = np.arange(0, 3000, 30)
    qi, xi, score = block.scan(q, x[q], np.full(len(q), -np.inf), 10, stats=stats)
    true = brute(x, rows * 20 // 20, 10)
    assert not (block.rows[xi] == q[qi]).any() and (np.bincount(qi) == 10).all()
    assert stats["read"] < 0.6 * stats["all"] and len(true)
    assert np.allclose(score, (x[q[qi]] * x[block.rows[xi]]).sum(1))


# --- texts that are long or odd ---


@pytest.mark.parametrize("text", [" " * 1_500_000, "\n" * 1_000_000, "x" * 1_000_000, "word word\nline two\n" * 80_000, "é漢 a\n" * 30_000], ids=["blanks", "lines", "letter", "words", "wide"])
def test_long_texts_have_the_tokenizers_ids(spark, text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    p = packing.decompose(df, queries.tokenizer_path()).orderBy("start").collect()
    assert b"".join(r.ids for r in p) == np.array([*own.ids, 0], "<u4").tobytes()
    c = token_counts.count_tokens(df, queries.tokenizer_path()).orderBy("section").toPandas()
    starts = np.array([s for s, _ in own.offsets])
    lines = np.cumsum([0, *(len(x) for x in text.splitlines(keepends=True))])
    assert c.start.tolist() == lines[:-1].tolist() and c.tokens.tolist() == np.bincount(np.searchsorted(lines, starts, "right") - 1, minlength=len(lines) - 1).tolist()
    assert line_dedup.dedup_lines(df).count() == 1 and mixing.mix(df.withColumn("source", F.lit("s"))).count() == 1


def test_user_columns_survive(spark):
    taken = "".join(f", {c} string" for c in TAKEN)
    rows = [(i, f"line a {i % 3}\nline b\nline c\nend of {i}", "en", "s", *(f"{c}{i}" for c in TAKEN)) for i in range(30)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string{taken}")
    model = langid.fit(df, F.lit(True))
    cut = lambda d: sharding.kd_shards(d, [F.length("text")], F.length("text"), F.xxhash64("text"), F.xxhash64("doc_id"), shards=4)
    for f in (line_dedup.dedup_lines, mixing.mix, lambda d: langid.identify(d, model), cut):
        got = f(df)
        assert got.columns[: len(df.columns)] == df.columns and len({c.lower() for c in got.columns}) == len(got.columns)
        kept = {r.doc_id: tuple(r[c] for c in TAKEN) for r in got.collect()}
        assert kept == {r[0]: r[4:] for r in rows}
    labels = spark.createDataFrame([(i, i % 2, i % 2, 1) for i in range(30)], "doc_id long, quality int, toxic int, size int")
    assert toxicity.score(df, toxicity.fit(df, labels, F.lit(True))).count() == 30 == media.media_columns(df).count()
    assert ann.search(*[ann.valid_vectors(df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), "dim", "row"))] * 2, 3).count() == 90


# --- line deduplication ---


def test_repeated_rows_are_later_occurrences(spark):
    text = "a b\nc d\n\ne f\ng h"
    rows = [(1, text), (1, text), (2, "c d\ne f\ng h\nnew"), (None, text), (3, "x\ny")]
    got = sorted((r.doc_id or 0, r.text, r.lines_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # null ids come first, so all others are later
    assert got == [(0, text, 0), (1, "", 4), (1, "", 4), (2, "new", 3), (3, "x\ny", 0)]
    got = sorted((r.text, r.lines_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect())
    assert got == [("", 4), (text, 0)]


# --- shards ---


def test_shards_against_a_plain_tree(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x, y, size = rng.normal(0, 1, n), rng.exponential(1, n), rng.integers(1, 50, n)
    df = spark.createDataFrame([(i, float(a), float(b), int(s), f"{i}") for i, (a, b, s) in enumerate(zip(x, y, size))], "doc_id long, x double, y double, size int, shard string")
    for shards in (7, 24):
        got = sharding.kd_shards(df, [F.col("x"), F.col("y")], F.col("size"), F.xxhash64("doc_id"), F.xxhash64("doc_id", "x"), shards=shards).orderBy("doc_id").toPandas()
        wide = [np.ptp(x), np.ptp(y)]

        def plain(rows, k):
            if k == 1:
                return [rows]
            d = int(np.argmax([np.ptp(c[rows]) / w for c, w in zip((x, y), wide)]))
            rows = rows[np.argsort((x, y)[d][rows], kind="stable")]
            cut = int(np.searchsorted(np.cumsum(size[rows]), size[rows].sum() * (k // 2) / k))
            return plain(rows[:cut], k // 2) + plain(rows[cut:], k - k // 2)

        want = np.empty(n, int)
        for i, rows in enumerate(plain(np.arange(n), shards)):
            want[rows] = i
        assert (got["shard_"] == want).mean() > 0.98  # rows at the cuts may fall on either side
        sums = got.groupby("shard_")["size"].sum()
        assert len(sums) == shards and (sums - size.sum() / shards).abs().max() <= 50 + 2 * sharding.MISS * size.sum() / shards
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard_").slot)


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None), (1, None, 5.0), (1, 3, float("inf")), (1, 3, 2.0), *((i, 10, 1.0) for i in range(500))]
    df = spark.createDataFrame(rows, "doc_id long, size long, x double")
    got = sharding.kd_shards(df, [F.col("x"), sharding.text_number(F.lit(None).cast("string"))], F.col("size"), F.lit(1).cast("long"), F.xxhash64("doc_id"), target_bytes=1000).toPandas()
    assert len(got) == len(rows) and got.groupby("shard")["size"].sum().between(834 - 11, 834 + 11).all()  # six of at most 1000
    equal = df.select("doc_id", F.lit(8).alias("size"), F.lit(1.0).alias("x")).limit(40)
    assert sharding.kd_shards(equal, [F.col("x")], F.col("size"), F.lit(1).cast("long"), F.lit(1).cast("long"), shards=3).count() == 40


# --- classifiers against plain loops ---


def test_ftrl_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [np.append(np.unique(rng.integers(0, 40, 8)), 1 << toxicity.BITS).astype(np.int32) for _ in range(200)]
    y = np.array([float((r < 6).sum() > 1) for r in rows])
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 1.5, 0.1, 3
    z, n, last = {}, {}, 1 << toxicity.BITS
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= (0 if i == last else l1) else -(z[i] - np.sign(z[i]) * (0 if i == last else l1)) / ((beta + n[i] ** 0.5) / alpha + l2)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            w = {int(i): weight(int(i)) for i in rows[r]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[r]
            for i, wi in w.items():
                was = n.get(i, 0.0)
                n[i] = was + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - was**0.5) / alpha * wi
    index, value, bias = toxicity.ftrl(rows, y, epochs, alpha, beta, l1, l2)
    assert dict(zip(index.tolist(), np.round(value, 9))) == {i: round(weight(i), 9) for i in sorted(z) if i != last and weight(i)}
    assert bias == pytest.approx(weight(last))
    # leaving out features too rare for a weight changes nothing
    import pyarrow as pa

    t = pa.table({"id": range(len(rows)), "y": y, "found": [r[:-1].astype("<i4").tobytes() for r in rows]})
    got = toxicity.train(t, epochs, alpha, beta, l1, l2).to_pylist()[0]
    assert np.frombuffer(got["index"], np.int64).tolist() == index.tolist() and np.allclose(np.frombuffer(got["weight"], float), value)


def test_decoding_against_a_plain_loop():
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], langid.codewords(3), rng.standard_normal((3, 1 << langid.BITS)), np.array([0.9, 0.5, 0.7]))
    texts = ["Some Text 1".encode(), "ünd".encode(), b"x"]
    best, share = model.decode(texts)
    for t, b, s in zip(texts, best, share):
        g, _ = langid.grams([t])
        margin = [sum(w[i] for i in g) / len(g) ** 0.5 for w in model.weights]
        loss = [sum(np.log1p(np.exp(-m * c)) * k for m, c, k in zip(margin, row, model.trust)) for row in model.code]
        assert b == int(np.argmin(loss)) and s == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-x) for x in loss))


def test_trust_is_measured_on_rows_kept_back(spark):
    rows = [(i, "the and of it was" if i % 2 else "der die das und ist", "en" if i % 2 else "de") for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["de", "en"] and 0.8 < model.trust[0] < 1  # (right + 1) / (texts + 2)


def test_media_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 70), (2, "a" * 70), (3, ""), (4, "ü" * 5000)], "doc_id long, text string").repartition(1)
    index = media.store(df.select(media.payload_column().alias("payload")), f"file://{tmp_path}", shard_bytes=1)
    assert index.count() == 3 == len(list(tmp_path.glob("*.tar")))  # each payload beyond the bound ends its shard
    for r in media.contents(index).collect():
        raw = next(t for t in ("a" * 70, "", "ü" * 5000) if len(t.encode()) <= r.payload_bytes < len(t.encode()) + 64 + 64 * (not t)).encode()
        image = media.to_image(raw + b"\0" * (r.payload_bytes - len(raw)))
        x = np.frombuffer(media.from_image(image), np.uint8)
        assert r.media_bytes == len(image) and r.media_sha256 == __import__("hashlib").sha256(image).hexdigest()
        assert r.feature == f"64x{len(x) // 64} mean={x.mean():.3f} std={x.std():.3f} hist={','.join(map(str, np.bincount(x >> 5, minlength=8)))}"
        assert r.tail_crc32 == zlib.crc32(x[-64:].tobytes())


# --- pipeline ---


ODD = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, "One two three four five six seven eight"), (3, None), (4, ""), (5, "12 34"), (None, "one two three four five six seven eight"), (None, "all other words than those before it stand here"), (6, "a b c\nd e f\ng h i\nlast words of it"), (7, "a b c\nd e f\ng h i"), (8, "x" * 400_000)]


@pytest.fixture(scope="module")
def odd(spark):
    columns = "".join(f", {c} string" for c in TAKEN)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *TAKEN) for i, t in ODD], f"doc_id long, text string, lang string, source string, n_chars long{columns}")


def test_stages_on_odd_rows(spark, odd):
    want = {
        corpus_pipeline.identify_language: [r for r in ODD if r[1] and r[1] != "12 34"],
        # null ids come first: the first document's lines are seen before in none
        corpus_pipeline.drop_repeated_lines: [r for r in ODD if r[0] != 7],
        corpus_pipeline.keep_one_of_similar: [r for r in ODD if r not in ((1, ODD[0][1]), (2, ODD[2][1]), (None, ODD[0][1]))] + [ODD[0]],
    }
    for stage, rows in want.items():
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns
        key = lambda r: (r[0] or 0, r[1] or "")
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(rows, key=key), stage.__name__
        assert all(tuple(r[c] for c in TAKEN) == tuple(TAKEN) for r in got.collect())
    mixed = corpus_pipeline.mix_sources(spark, odd, SF)
    assert mixed.columns == odd.columns and mixed.where("text IS NULL OR text = ''").count() == 0 < mixed.count()
    assert corpus_pipeline.pack(spark, odd, SF).where("doc_id = 3").count() == 1
    for stage in (*want, corpus_pipeline.mix_sources, corpus_pipeline.pack):
        assert stage(spark, odd.where("false"), SF).count() == 0


def test_nothing_to_learn_from_keeps_documents(spark, odd):
    got = corpus_pipeline.identify_language(spark, odd.withColumn("lang", F.lit(None).cast("string")), SF)
    assert sorted(r.text for r in got.collect()) == sorted(t for _, t in ODD if t and t != "12 34") and got.where("lang IS NOT NULL").count() == 0


def test_thousands_of_shards(spark):
    """As many shards as bytes ask for, each about as large as any other."""
    rows = spark.range(20_000).select("id", (F.xxhash64("id") % 1000).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit(10).alias("size"))
    got = sharding.kd_shards(rows, [F.col("x"), F.col("y")], F.col("size"), F.xxhash64("id"), F.xxhash64("id", "x"), target_bytes=100)
    n = got.groupBy("shard").agg(F.sum("size").alias("w"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("k"))
    r = n.agg(F.count("*").alias("shards"), F.min("w").alias("low"), F.max("w").alias("high"), F.max("shard").alias("last"), F.sum("w").alias("all"), F.max(F.col("b") - F.col("k")).alias("gap")).first()
    assert (r.shards, r.last, r["all"], r.gap) == (2000, 1999, 200_000, -1) and 80 <= r.low and r.high <= 120
