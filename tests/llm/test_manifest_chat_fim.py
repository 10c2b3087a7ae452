"""Chat formatting, Merkle manifest and fill-in-the-middle against plain
versions, their SQL and edge cases."""

import hashlib
import os
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.llm import chat, fim, merkle, queries

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
BLANKS = " \t\n\x0b\x0c\r"
LONG = "word and\tanother\n" * 60_000


@pytest.mark.parametrize("name", ["op11_chat", "op12_merkle", "op13_fim"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda d: sorted(tuple(None if v is None or v is pd.NA or v != v else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert plain(got) == plain(want)


# --- fill-in-the-middle ---


def plain_fim(doc_id, text, seed=42, percent=50, spm=80):
    text, units, at = text or "", [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in BLANKS:
            end += 1
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        units.append(text[at:end])
        at = end
    d = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "one", " lead and trail \n\n", "a<P>b c", "<S>", "almost <P and S> or <", "ß 漢字\u00a0x\u2003y 😀 z", "\x1c a \x85 b", "a" * 10, LONG, LONG.strip() + " " * 70_000, "same text here", "same text here"]


def test_fim_is_exact(spark):
    rows = [(i if i % 11 else None, t, "x", k, 1) for k, t in enumerate(TEXTS * 12) for i in [k]]
    d = spark.createDataFrame(rows, "doc_id long, text string, Form string, units int, at int")
    found = fim.fill_in_middle(d)
    assert found.columns == ["doc_id", "text", "Form", "units", "at", "n", "form_", "prefix", "middle", "suffix", "output"]
    got = found.withColumn("back", fim.restored(F.col("output"), F.col("form_"))).collect()
    assert len(got) == len(rows) and {r["form_"] for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r.n, r["form_"], r.prefix, r.middle, r.output) == plain_fim(r.doc_id, r.text) and r.back == (r.text or "")
    assert fim.fill_in_middle(d.where("false")).count() == 0
    always = fim.fill_in_middle(d.where("units = 3"), percent=100, spm_percent=0).first()
    assert always["form_"] == "psm"
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P>x", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(d, sentinels=bad)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- manifest ---


def plain_tree(leaves, k):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + k])) for i in range(0, len(levels[-1]), k)])
    return levels


def plain_proof(levels, pos, k):
    out = []
    for level in levels[:-1]:
        first = pos - pos % k
        run = level[first : first + k]
        out.append(("".join(run[: pos - first]), "".join(run[pos - first + 1 :])))
        pos //= k
    return out


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (2, 1024), (3, 9)])
def test_manifest_is_exact(spark, fanout, block):
    sizes = {"a": 37, None: 5, "": 1, "ß": 16, "-": 2, "Z": 64}
    rows = [(i if i % 13 else None, g, i % 7, f"text {i % 10}") for g, n in sizes.items() for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, grp string, pos int, root string").repartition(5)
    leaf = merkle.digest("doc_id", "grp", "pos", "root")
    m = merkle.manifest(d, leaf, F.col("grp"), F.col("doc_id"), {"root": F.col("root"), "doc_id": F.col("doc_id")}, fanout, block)
    got = m.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("digest", merkle.proof_digest(F.col("proof"))).collect()
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for g in sorted(sizes, key=lambda g: b"" if g is None else b"=" + g.encode()):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, sha("".join(map(value, r)))))
        trees[g] = plain_tree([sha("".join(map(value, r))) for r in own], fanout)
    top = plain_tree([t[-1][0] for t in trees.values()], fanout)
    want = []
    for at, (g, t) in enumerate(trees.items()):
        for pos, h in enumerate(t[0]):
            proof = plain_proof(t, pos, fanout) + plain_proof(top, at, fanout)
            want.append((h, t[-1][0], top[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), tuple(proof)))
    assert m.columns == ["root", "doc_id", "leaf", "subroot", "root_", "proof"]
    rows_ = [(r.leaf, r.subroot, r["root_"], r.folded, r.digest, tuple((s.before, s.after) for s in r.proof)) for r in got]
    assert sorted(rows_) == sorted(want)


def test_manifest_finds_tampering_and_takes_empty_tables(spark):
    d = spark.createDataFrame([(1, None, None), (2, "en", 3), (3, "en", None)], "doc_id long, lang string, n_chars long")
    leaf = merkle.digest("doc_id", "lang", "n_chars")
    m = merkle.manifest(d, leaf, F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "other": merkle.digest("doc_id", "lang", F.col("n_chars") + 1)})
    r = {x.doc_id: x for x in m.withColumn("ok", merkle.fold(F.col("other"), F.col("proof")) == F.col("root")).collect()}
    assert (r[1].ok, r[2].ok, r[3].ok) == (True, False, True) and r[1].subroot == r[1].leaf
    assert merkle.manifest(d.where("false"), leaf, F.col("lang"), F.col("doc_id")).count() == 0
    alone = merkle.manifest(d.where("doc_id = 2"), leaf, F.col("lang"), F.col("doc_id")).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof == []


def test_tampered_rows_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    for r in queries.op12_merkle(spark, SF).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and not pd.isna(docs.n_chars[r.doc_id])
        assert r.verified == (not changed) == (r.folded_root == r.root)


# --- chat ---

PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, segment int, formatted string"
part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
ODD = ["\\", "\\\\", "</turn>", "\\</turn>\n", "<image 1>", "<turn user>", "a\\<b", "<imagery", "tail\\", "", "\n", "漢字 😀 </turn", LONG]


def test_chat_round_trip(spark):
    rows = [(i % 5, i, ["user", "assistant", "a>b\\", None][i % 4], [part("text", t)], 0, "x") for i, t in enumerate(ODD * 2)] + [(None, None, "assistant", [part("text", None)], 0, "x"), (9, 0, "user", None, 0, "x"), (9, 0, "user", [None], 0, "x")]
    d = spark.createDataFrame(rows, PARTS)
    for limit in (1, 1 << 22):
        s = chat.format_conversations(d, F.col("parts"), segment_chars=limit)
        back = {}
        for r in chat.read_turns(s).orderBy("conv_id", "segment", "place").collect():
            back.setdefault(r.conv_id, []).append((r.role, "".join(p.text for p in r.parts)))
        want = {}
        for c, _, role, parts, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)):
            want.setdefault(c, []).append((role or "", "".join(p[1] or "" for p in parts or [] if p)))
        assert back == want
        whole = {c: sum(r.formatted is not None and len(r.formatted) for r in rows_) for c, rows_ in groups(s.collect()).items()}
        for r in chat.digests(s).collect():
            turns, loss = want[r.conv_id], "".join(t for role, t in want[r.conv_id] if role == "assistant")
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
            assert r.formatted_chars == whole[r.conv_id]
    assert chat.format_conversations(d.where("false"), F.col("parts")).count() == 0 == chat.digests(s.where("false")).count()


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_chat_placeholders(spark):
    parts = [part("text", "see <image 1> "), part("image", None, "a.png", 57, 28), part("audio", None, "b.wav", s=1.5), part(None, "and")]
    rows = [(1, 0, "user", parts, 0, "x"), (1, 1, "assistant", [part("text", "x"), part("document", None, "c.pdf", p=3), part("text", "\\y")], 0, "x")]
    s = chat.format_conversations(spark.createDataFrame(rows, PARTS), F.col("parts"), tokenizer=queries.tokenizer_path()).collect()
    assert len(s) == 1
    r, text = s[0], s[0].formatted
    assert text == "<turn user>see \\<image 1> <image 1><audio 2>and</turn>\n<turn assistant>x<document 3>\\\\y</turn>\n"
    assert [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, 0, "image", "a.png", 3), (2, 0, "audio", "b.wav", 38), (3, 1, "document", "c.pdf", 3072)]
    assert all(text[a["at"] :].startswith(f"<{a.kind} {a.number}>") for a in r.attachments)
    assert [chat.unescape(text[x.start : x.stop]) for x in r.loss] == ["x", "\\y"] and r.expanded_tokens == 3 + 38 + 3072
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    assert r.text_tokens == sum(len(t.encode(x, add_special_tokens=False).ids) for x in re.split(r"(?<!\\)<(?:image|audio|document) \d+>", text))
    with pytest.raises(Exception, match="parts are text"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [part("video")], 0, "x")], PARTS), F.col("parts")).collect()
