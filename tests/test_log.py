"""The chunk log read in splits and kept as keyed state, against a plain reader."""

import json
import random

import pytest

from attesta.operators import chunks
from attesta.streaming import chunk_log


def lines(seed, n=400):
    """Records of few chunks, without a number, among torn and foreign lines."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = {"timestamp": f"t{i}", "source_id": rng.choice(["a", "b", "漢", ""]), "chunk_index": rng.choice([1, 2, "3", 0, -1, "x"]), "status": rng.choice(["success", "error", "error"]), "error": f"e{i}" + "y" * rng.randrange(200), "attempt": rng.choice(["", 2])}
        text = json.dumps(r, ensure_ascii=False)
        out.append(text[: rng.randrange(1, len(text))] if i % 9 == 0 else text)
    return [*out, "", "[]", "7", '{"source_id": null, "chunk_index": 1}', '{"source_id": "q", "chunk_index": 1, "status": "success"']


def plain(text):
    kept = {}
    for line in text.split("\n"):
        try:
            r = json.loads(line)
            key = (r["source_id"], int(r["chunk_index"]))
        except (ValueError, TypeError, KeyError):
            continue
        if not key[0] or key[1] <= 0 or (kept.get(key, {}).get("status") == "success" and r["status"] != "success"):
            continue
        kept[key] = r
    return {k: (r["status"], r["timestamp"]) for k, r in kept.items()}


def latest(df):
    return {(r.source_id, r.chunk_index): (r.status, r.timestamp) for r in df.collect()}


@pytest.fixture
def splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_order_is_that_of_the_lines(spark, tmp_path, splits):
    text = [lines(1), lines(2), lines(3)]
    for i, part in enumerate(text):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(part))
    log = chunk_log.read_log(spark, str(tmp_path))
    assert log.rdd.getNumPartitions() > 20
    assert latest(chunks.latest_records(log)) == plain("\n".join("\n".join(p) for p in text))
    one = chunk_log.read_log(spark, f"{tmp_path}/0.jsonl")
    assert latest(chunks.latest_records(one)) == plain("\n".join(text[0]))
    (tmp_path / "empty.jsonl").write_text("")
    assert chunk_log.read_log(spark, f"{tmp_path}/empty.jsonl").count() == 0


def test_state_by_key(spark, tmp_path, splits):
    folder, text = tmp_path / "log", []

    def add(i):
        folder.mkdir(exist_ok=True)
        text.append("\n".join(lines(i)))
        (folder / f"{i}.jsonl").write_text(text[-1])

    def run(checkpoint):
        chunk_log.keep_latest(chunk_log.stream_log(spark, str(folder)), f"{tmp_path}/{checkpoint}").awaitTermination()
        return chunk_log.current(spark, f"{tmp_path}/{checkpoint}")

    add(1)
    assert latest(run("c")) == plain("\n".join(text))
    add(2)
    add(3)
    want = plain("\n".join(text))
    assert latest(run("c")) == want and latest(run("c")) == want  # a second run finds nothing new
    assert latest(run("fresh")) == want  # all files as one batch
    (folder / "4.jsonl").write_text(text[0])  # a copy: its successes are the latest, its errors replace none
    assert latest(run("c")) == plain("\n".join([*text, text[0]]))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "kept").load()
    assert state.count() == len(want)
