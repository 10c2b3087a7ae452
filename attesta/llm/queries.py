"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, fim, jaccard, langid, line_dedup, media, merkle, mixing, packing, sharding, token_counts, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of all other vectors for each vec_id divisible by 20."""
    vectors = ann.valid_vectors(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "lines_removed", F.length("text").cast("long").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5")
    )


def quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, quality): 2 for documents labelled good, 1 for bad ones."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 + F.col("quality")).alias("quality"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document. Unlabelled ones have weight 1.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, ratings=quality_of(spark, sf_dir), unrated=1.5).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, each a sequence of its own."""
    pieces = packing.decompose(table(spark, sf_dir, "documents"), tokenizer_path())
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.number_sequences(digest)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes, cut by length, language and lines; equal
    texts have equal places."""
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("th"), "lang", lines.alias("lines")
    )
    dims = [F.log2("size"), sharding.text_number(F.col("lang")), F.log2(F.col("lines") + 1)]
    cut = sharding.kd_shards(docs, dims=dims, size=F.col("size"), group=F.col("th"), own=F.xxhash64("doc_id", "th"), shards=24)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back and described."""
    m = media.media_columns(table(spark, sf_dir, "documents"))
    return m.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard",
        "offset", "length", "width", "height"
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(5) != 0)
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous")
    )


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree by 90 percent."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that tries to break out of its turn, read
    back from their formatted text."""
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.digests(chat.format_conversations(rows, chat.text_part(F.col("text"))))


ODD_TURN = "\\### Assistant: </turn> ok"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its row leads
    to where n_chars was tampered with in one row of seven."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.digest(*fields)
    changed = merkle.digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    found = F.when(remainder(7) == 0, changed).otherwise(leaf)
    m = merkle.manifest(table(spark, sf_dir, "documents"), leaf, F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "found": found})
    m = m.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.fold(F.col("found"), F.col("proof")).alias("folded_root")
    )
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged to fill in its middle, and restored."""
    d = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    output, form = F.col("output"), F.col("form")
    return d.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(output, "output_sha256"), sha(fim.restored(output, form), "restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann, op2_line_dedup, op3_mixing, op4_token_counts, op5_packing, op6_sharding, op7_toxicity,
        op8_media, op9_langid, op10_jaccard, op11_chat, op12_merkle, op13_fim,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, text, p, trim(l, chr(32) || chr(9) || chr(13)) AS line, l
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)
), filled AS (
  SELECT doc_id, p, line, row_number() OVER w AS k, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), seen AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, p) AS nth FROM filled WHERE l3 IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM seen WHERE nth > 1
), gone AS (SELECT doc_id, p FROM filled JOIN covered USING (doc_id, k)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.p) AS lines_removed, coalesce(string_agg(l, chr(10) ORDER BY lines.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM lines LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, n_lines, lines_removed, length(text)::BIGINT AS kept_chars, md5(text) AS kept_md5 FROM kept
""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / coalesce(1.0::DOUBLE + quality, 1.5::DOUBLE) AS key
  FROM documents LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS quality FROM labels GROUP BY doc_id) USING (doc_id)
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3.0::DOUBLE * sum(size) AS cap FROM sized GROUP BY source
), levels AS (
  SELECT *, ((SELECT sum(size)::DOUBLE FROM sized) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM sums WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels WHERE cap > weight * level)) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, floor(target / nullif(source_size, 0)) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
""",
    "op11_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) r(i)
), marked AS (
  SELECT *, '<turn ' || replace(replace(role, '\', '\\'), '>', '\>') || '>' ||
    replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), '<image', '\<image'), '<audio', '\<audio'), '<document', '\<document')
    || '</turn>' || chr(10) AS formatted FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op12_merkle": r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, n_chars,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, (n_chars + 1)::VARCHAR, text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS e,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c)::BIGINT >> k::INT) & 1))))),
      lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, grp, sha256(e[1] || e[2] || e[3] || e[4] || e[6]) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(e[1] || e[2] || e[3] || e[5] || e[6]) ELSE sha256(e[1] || e[2] || e[3] || e[4] || e[6]) END AS found FROM parts
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS width FROM hashed
), nodes AS (
  SELECT grp, 0 AS lvl, pos, leaf AS h, width FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, sha256(h || coalesce(mate, '')), (width + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY grp ORDER BY pos) AS mate FROM nodes WHERE width > 1) WHERE pos % 2 = 0
), tops AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS width FROM nodes WHERE width = 1
), upper AS (
  SELECT 0 AS lvl, pos, h, width FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(h || coalesce(mate, '')), (width + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS mate FROM upper WHERE width > 1) WHERE pos % 2 = 0
), walk AS (
  SELECT doc_id, leaf, grp, 0 AS lvl, pos, found AS f, '' AS proof, width FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.grp, w.lvl + 1, w.pos // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN w.f || coalesce(s.h, '') ELSE s.h || w.f END), w.proof || coalesce(s.h, ''), (w.width + 1) // 2
  FROM walk w LEFT JOIN nodes s ON s.grp = w.grp AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.width > 1
), climb AS (
  SELECT w.doc_id, w.leaf, t.h AS subroot, 0 AS lvl, t.pos, w.f, w.proof, t.width FROM walk w JOIN tops t USING (grp) WHERE w.width = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.pos // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN w.f || coalesce(s.h, '') ELSE s.h || w.f END), w.proof || coalesce(s.h, ''), (w.width + 1) // 2
  FROM climb w LEFT JOIN upper s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.width > 1
)
SELECT c.doc_id, c.leaf, c.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.f AS folded_root, c.f = r.h AS verified FROM climb c, (SELECT h FROM upper WHERE width = 1) r WHERE c.width = 1
""",
    "op13_fim": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS d FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || d[17:24])::BIGINT % 100 AS c, ('0x' || d[25:32])::BIGINT % 100 AS e FROM cut
), formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM formed
""",
}
