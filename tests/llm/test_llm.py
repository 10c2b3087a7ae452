"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import ann, jaccard, langid, line_dedup, media, mixing, packing, queries, sharding, token_counts, toxicity
from attesta.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, size int, row string"
LONG = "word one two three four five six seven. " * 3000
ROWS = [
    (1, "a b c\nd e f\ng h i\nend one", "en", "s1", 1, "x"), (2, "start\na b c\nd e f\ng h i", "en", "s1", 2, "x"), (3, None, None, None, None, None), (4, "", "en", "s2", 3, "x"),
    (5, LONG, "en", "s1", 4, "x"), (6, "a b c\nd e f\ng h i\nend one", "en", "s2", 5, "x"), (6, "a b c\nd e f\ng h i\nend one", "en", "s2", 5, "x"), (None, "lone words here", "de", "s2", 6, "x"), (7, "12 34 -- !!", "en", "s3", 7, None), (8, "é <|endoftext|> 漢字 ok\n", "fr", "s3", 8, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_ann_recall_and_odd_vectors(spark):
    vectors = ann.valid_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    rows = vectors.orderBy("vec_id").collect()
    x, ids = np.array([r["vec"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20).toPandas()
    found = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        true = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
        found += len(true & set(mine.vec_id))
    assert found >= 0.9 * 20 * len(got.query_id.unique())
    odd = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, rank int")
    v = ann.valid_vectors(odd)
    r = ann.search(v, v.where("vec_id % 20 = 0"), 20).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in r] == [(5, 1.0), (6, 1.0)]
    assert ann.search(v.where("false"), v.where("false")).count() == 0


def test_line_dedup(docs, none):
    r = {(x.doc_id, x.text and x.text[:20]): x for x in line_dedup.dedup_lines(docs.where("doc_id IS NOT NULL")).collect()}
    assert (1, "a b c\nd e f\ng h i\nen") in r and (2, "start") in r and r[(2, "start")].lines_removed == 3
    assert (6, "") in r and (3, None) in r and (5, LONG[:20]) in r
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len(ROWS)


def test_mixing_meets_targets(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = mixing.mix(d, ranges=7).toPandas()
    assert len(r) == 200
    for _, g in r.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and (g.taken <= 3 * g["size"]).all()
    assert abs(r.groupby("source").target.first().sum() - r["size"].sum()) < 1e-3
    m = mixing.mix(docs).collect()
    assert len(m) == len(ROWS) and {x.doc_id: x["size_"] for x in m}[3] == 0
    assert mixing.mix(none).count() == 0


def test_tokens_and_pieces(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r[0]: r[1] or "" for r in ROWS}
    counts = token_counts.count_tokens(docs, queries.tokenizer_path()).toPandas()
    pieces = packing.number_sequences(packing.decompose(docs, queries.tokenizer_path())).toPandas()
    for i, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        c = counts[counts.doc_id.isna() if i is None else counts.doc_id == i]
        assert (c.doc_tokens == len(ids) - 1).all() and c.tokens.sum() in (len(ids) - 1, 2 * (len(ids) - 1))
        p = pieces[pieces.doc_id.isna() if i is None else pieces.doc_id == i].sort_values("start").drop_duplicates("start")
        assert b"".join(p.ids) == ids.tobytes() and all(n & (n - 1) == 0 and n <= 1024 for n in p.length)
    assert pieces.sequence_id.is_unique and (pieces.offset == 0).all()
    assert token_counts.count_tokens(none, queries.tokenizer_path()).count() == 0 == packing.decompose(none, queries.tokenizer_path()).count()


def test_boundary_rules():
    spans, bounds = np.array([[0, 2], [2, 6], [6, 9], [9, 10]]), np.array([0, 3, 10])
    assert token_counts.attribute(spans, bounds, "first").tolist() == [2, 2]
    assert token_counts.attribute(spans, bounds, "last").tolist() == [1, 3]
    assert token_counts.attribute(spans, bounds, "most").tolist() == [1, 3]


def test_shards_are_even(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", (F.octet_length("text") + 8).alias("size"), F.xxhash64("text").alias("th"))
    cut = lambda x: sharding.kd_shards(x, [F.log2("size"), F.col("th")], F.col("size"), F.col("th"), F.xxhash64("doc_id", "th"), shards=5)
    r = cut(d).toPandas()
    sums = r.groupby("shard")["size"].sum()
    assert len(r) == 1000 and len(sums) == 5 and sums.max() - sums.min() <= 2 * r["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in r.groupby("shard").slot)
    same = spark.range(1000).select("id", F.lit(10).alias("size"), F.lit(1).cast("long").alias("th")).withColumnRenamed("id", "doc_id")
    assert cut(same).toPandas().shard.value_counts().between(190, 210).all()
    assert cut(none.select("doc_id", F.lit(1).alias("size"), F.lit(1).cast("long").alias("th"))).count() == 0


def test_toxicity_held_out(spark, docs, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels, queries.remainder(4) != 2)
    r = toxicity.score(d, model).join(labels, "doc_id").where(queries.remainder(4) == 2).toPandas()
    hit = ((r.predicted == 1) & (r.toxic == 1)).sum()
    assert hit >= 0.8 * r.toxic.sum() and hit >= 0.9 * r.predicted.sum()
    s = toxicity.score(docs, model).collect()
    assert len(s) == len(ROWS) and all(0 <= x.score <= 1 for x in s)
    empty = toxicity.fit(none, labels.where("false"), F.lit(True))
    assert toxicity.score(docs, empty).count() == len(ROWS)


def test_media_round_trip(docs, none):
    r = media.media_columns(docs).collect()
    texts = Counter((x.doc_id, x.n_bytes) for x in r)
    assert sum(texts.values()) == len(ROWS)
    by = {x.doc_id: x for x in r}
    for i, text in ((x[0], x[1]) for x in ROWS):
        raw = (text or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = by[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert x.width * x.height == len(full)
    index = media.store(docs.select(media.payload_column().alias("payload")))
    assert media.headers(index).count() == index.count() == len({r[1] or "" for r in ROWS})
    image = media.to_image(b"x" * 128)
    with pytest.raises(ValueError):
        media.from_image(image[:40] + bytes([image[40] ^ 1]) + image[41:])
    assert media.media_columns(none).count() == 0


def test_language_held_out(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d, queries.remainder(5) != 0)
    r = langid.identify(d, model).where(queries.remainder(5) == 0).toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.97
    got = {x.doc_id: x for x in langid.identify(docs, model, keep=["doc_id"]).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" != got[8].lang_pred
    alone = langid.fit(d.where("false"), F.lit(True))
    assert {x.lang_pred for x in langid.identify(docs, alone).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
    assert len({tuple(c) for c in langid.codewords(4).tolist()}) == 4


def components(rows, n, percent):
    word, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = word.findall((text or "").translate(low))
        sets.append(set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} - {()})
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                up[y] = x
    return {i: find(i) for i, _ in rows}, {r[0]: len(s) for r, s in zip(rows, sets)}


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 8192), (5, 80, 3), (1, 100, 8192), (2, 75, 4)])
def test_jaccard_is_exact(spark, docs, none, n, percent, block):
    rng = np.random.default_rng(n)
    rows = []
    for g in range(12):
        base = rng.integers(0, 60, rng.integers(2, 90)).astype(str).tolist()
        for k in range(int(rng.integers(1, 9))):
            words = base.copy()
            for _ in range(k // 2):
                words[rng.integers(len(words))] = "Zz%d" % rng.integers(9)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sizes = components(rows, n, percent)
    got = jaccard.similar_components(df, n=n, percent=percent, block_docs=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    if n == 3:
        odd = jaccard.similar_components(docs, n=n, percent=percent).collect()
        assert len(odd) == len(ROWS) and {(r.doc_id, r.component_id) for r in odd} >= {(3, 3), (4, 4), (6, 1), (None, None)}
        assert jaccard.similar_components(none, n=n, percent=percent).count() == 0


@pytest.mark.parametrize("ids", [np.random.default_rng(1).permutation(1000).tolist(), [*range(100, 200), 1]], ids=["shuffled", "far end"])
def test_components_of_chains(spark, ids):
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (5000, 5001), (6000, 6000)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(ids, min(ids)), 5000: 5000, 5001: 5000, 6000: 6000}


def test_pipeline(spark):
    import corpus_pipeline

    r = corpus_pipeline.run(spark, SF).toPandas()
    assert len(r) and r.sequence_id.is_unique and (r.ids.str.len() == 4 * r.length).all()


def near_copies(sets, words, seed):
    """Copies of one text, each with one word of a hundred changed."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 40, words)
    rows = []
    for i in range(sets):
        text = base.copy()
        text[rng.choice(words, max(1, words // 100), replace=False)] = rng.integers(0, 1 << 40, max(1, words // 100))
        rows.append((i, " ".join(map(str, text.tolist()))))
    return rows


@pytest.mark.parametrize(("sets", "words", "block"), [(100, 300, 10), (60, 10_000, 8)])
def test_clusters_beyond_a_block_send_texts_a_few_times(spark, monkeypatch, sets, words, block):
    sent = []
    star, rest = jaccard.star_links, jaccard.units_of

    def counted(members, shared, verify, *more):
        return star(members, shared, lambda rows, keys: sent.append(rows.count()) or verify(rows, keys), *more)

    monkeypatch.setattr(jaccard, "star_links", counted)
    monkeypatch.setattr(jaccard, "units_of", lambda *a: sent.append((u := rest(*a)).count()) or u)
    rows = near_copies(sets, words, sets + words)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=block).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 5, 80)[0]
    assert len(sent) > 1 and max(sent) <= 2 * sets + 2 * sets / block


def test_chained_clusters_are_exact(spark):
    """Long texts that share passages: a cluster, but not a component."""
    rng = np.random.default_rng(8)
    word = lambda n: rng.integers(0, 1 << 40, n).tolist()
    passage, rows = [word(600) for _ in range(3)], []
    for g in range(12):
        own = word(400 + 50 * g)
        for k in range(int(rng.integers(1, 6))):
            text = passage[g % 3] + own
            for at in rng.integers(0, len(text), 4 * k):
                text[at] = word(1)[0]
            rows.append((len(rows), " ".join(map(str, text))))
    want = components(rows, 5, 80)[0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2, 7):
        assert {r.doc_id: r.component_id for r in jaccard.similar_components(df, block_docs=block).collect()} == want


def test_other_vocabularies_go_through_the_tokenizer(tmp_path):
    """A byte-level vocabulary whose ids aren't in merge order, and one that is
    no BPE at all; the usual one takes the faster engine."""
    import json

    from attesta.llm import tokens

    assert tokens.Encoder(queries.tokenizer_path()).fast is not None
    letters = sorted(tokens._byte_letters())
    merges, base = [("a", "b"), ("b", "c"), ("ab", "c")], {c: i for i, c in enumerate(letters)}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level}
    bpe = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "merges": [list(m) for m in merges]}
    for name, order, fast in (("ordered", (256, 257, 258), True), ("shuffled", (258, 256, 257), False)):
        vocab = base | {"".join(m): i for m, i in zip(merges, order)}
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {"model": bpe | {"vocab": vocab}}))
        e = tokens.Encoder(str(path))
        assert (e.fast is not None) == fast
        for text in ("abc bc abcbc", "aabbcc", "é abc\n\n  abc"):
            assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    path = tmp_path / "unigram.json"
    path.write_text(json.dumps(spec | {"pre_tokenizer": None, "decoder": None, "model": {"type": "Unigram", "unk_id": 0, "vocab": [["?", -9.0], ["a", -1.0], ["ab", -1.5], [" ", -2.0]], "byte_fallback": False}}))
    e = tokens.Encoder(str(path))
    assert e.ids("ab a").tolist() == e.tokenizer.encode("ab a", add_special_tokens=False).ids and len(e.spans("ab a")) == 3


def test_toxicity_features_are_all_ngrams_and_skipgrams():
    """The features of texts against plain loops over their words; what one
    n-gram is called follows from the shortest text that has it."""
    ids = lambda text: set(toxicity.features([text.encode()])[1].tolist())
    one = {w: ids(w) for w in "abcdefgh"}
    name = {}
    for x in "abcdefgh":
        for y in "abcdefgh":
            name[x, y, 1] = ids(f"{x} {y}") - one[x] - one[y]
    for gap in (2, 3):
        for x in "abcdefgh":
            for y in "abcdefgh":
                between = ["zz", "yy"][: gap - 1]
                text = [x, *between, y]
                known = set().union(*(ids(w) for w in text), *(ids(" ".join(text[i : i + 2])) for i in range(len(text) - 1)))
                if gap == 3:
                    known |= ids(" ".join(text[:3])) | ids(" ".join(text[1:]))
                name[x, y, gap] = ids(" ".join(text)) - known
    rng = np.random.default_rng(4)
    texts = ["".join(w + rng.choice([" ", ", ", "\n", " -- "]) for w in rng.choice(list("abcdefgh"), int(rng.integers(0, 12)))) for _ in range(60)] + ["", "A b", "a"]
    docs, found = toxicity.features([t.encode() for t in texts])
    for i, text in enumerate(texts):
        w = re.findall("[a-z]", text.lower())
        want = set().union(*(one[x] for x in w), *(name[w[k], w[k + gap], gap] for gap in (1, 2, 3) for k in range(len(w) - gap)))
        assert set(found[docs == i].tolist()) == want
        assert len(want) == len(set(w) | {(w[k], w[k + g], g) for g in (1, 2, 3) for k in range(len(w) - g)})
