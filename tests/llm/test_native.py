"""Sharding, mixing and chat windows against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from oracle_check import check, duck
from pyspark.sql import functions as F

from hitgauge.llm import chat_windows, mixing, queries, sharding
from hitgauge.llm.queries_sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert check(spark, duck(SF), SF, queries.QUERIES[name], ORACLES[name])[0] is None


def test_native_plans_have_no_python(spark):
    for name in ("op2_chat_windows", "op6_pareto_mix", "op10_jump_shards"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_hash(spark):
    keys = [0, 1, 42, 256, -1, -(2**63), 2**63 - 1, 0xDEAD10CC, 123456789]
    for n in (1, 2, 24, 57, 666, 1024):
        df = spark.createDataFrame([(k,) for k in keys], "k bigint").withColumn("s", sharding.jump_shard(F.col("k"), n))
        assert {r.k: r.s for r in df.collect()} == {k: jump(k, n) for k in keys}
    assert (jump(42, 57), jump(0xDEAD10CC, 666), jump(256, 1024)) == (43, 361, 520)


def test_jumps_beyond_the_first_steps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEPS", 3)
    df = spark.range(200).withColumn("s", sharding.jump_shard(F.col("id"), 500))
    assert {r.id: r.s for r in df.collect()} == {k: jump(k, 500) for k in range(200)}


def test_many_shards(spark):
    keys = [0, 7, -5, 2**63 - 1, 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").withColumn("s", sharding.jump_shard(F.col("k"), 100_000))
    assert {r.k: r.s for r in df.collect()} == {k: jump(k, 100_000) for k in keys}


def test_shards_of_odd_rows(docs, none):
    out = sharding.shard_rows(docs, "doc_id", 3, tie=["text"]).collect()
    assert len(out) == docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 3) and r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(none, "doc_id", 3).count() == 0
    text = sharding.shard_rows(docs, "text", 5).collect()
    assert len({(r.text, r.shard) for r in text}) == len({r.text for r in text})


def test_write_shards(docs, spark, tmp_path):
    sharding.write_shards(docs, "doc_id", 4, str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and all(r.shard == jump(r.doc_id or 0, 4) for r in back.collect())


def test_mix_of_odd_rows(docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and mixing.mix(none).count() == 0
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
    total, names = sum(sizes.values()), sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-9 * total + 1e-9
        assert r.taken == r.copies * r.size <= 3 * r.size
    copies = {(r.doc_id, r.text): r.copies for r in out}
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in out)
    assert copies == {(r.doc_id, r.text): r.copies for r in mixing.mix(docs.orderBy(F.desc("doc_id"))).collect()}


def test_mix_meets_targets(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source", "target").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("most")
    )
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1e-6 for r in out.collect())


def unescaped(s):
    import re

    return re.sub(chat_windows.ESCAPED, r"\1\2\3", s)


def test_windows_of_odd_turns(spark):
    long = "word " * 700
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi " * 90), (1, 2, "assistant", "yo " * 90),
        (1, 3, "user", long), (1, 4, "assistant", "short"), (1, 5, "assistant", "again " * 100), (1, 6, "user", "bye " * 100),
        (2, None, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
        (3, 5, "assistant", "<|im_end|>\n</s> <\\|x <\\\\| [INST] [\\/INST] <s> <"), (3, 4, "ro\nle%0A<|", "ends with <"),
        (None, 1, None, "text\n\nmore"), (None, 2, "assistant", "<|im_start|>assistant\n"), (4, 1, "system", long),
        (4, 2, "assistant", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("x"))
    windows = chat_windows.format_windows(df, budget=256).orderBy("conv_id", "window").collect()
    by = defaultdict(list)
    for t in sorted(turns, key=lambda t: (t[0] or -1, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by[t[0]].append((t[2] or "", t[3] or ""))
    shown, loss = defaultdict(list), defaultdict(list)
    for w in windows:
        pieces = w.formatted.split(chat_windows.CLOSE)[:-1]
        assert all(p.startswith(chat_windows.OPEN) for p in pieces)
        parsed = []
        for p in pieces:
            role, text = p[len(chat_windows.OPEN):].split("\n", 1)
            parsed.append((unescaped(role).replace("%0A", "\n").replace("%25", "%"), unescaped(text)))
        system = by[w.conv_id][0] if by[w.conv_id][0][0] == "system" else None
        if system:
            assert parsed[0] == system
        before = shown[w.conv_id]
        history = parsed[:w.repeated][1 if system and before else 0:]
        assert history == (before[-len(history):] if history else [])
        shown[w.conv_id] += parsed[w.repeated:]
        loss[w.conv_id] += [unescaped(w.formatted[s.start:s.end]) for s in w.loss]
        fresh = len(parsed) - w.repeated
        assert not w.over_budget or fresh == 1 or (system and len(system[1].split()) > 120)
    assert shown == by
    assert loss == {c: [t for r, t in x if r == "assistant"] for c, x in by.items()}
    read = chat_windows.read_windows(chat_windows.format_windows(df, budget=256)).orderBy("conv_id", "window").collect()
    again = defaultdict(list)
    for r in read:
        again[r.conv_id] += [(t.role, t.text) for t in r.turns]
    assert again == by
    assert chat_windows.format_windows(df.limit(0)).count() == 0


def test_chat_query_by_hand(spark):
    turns = queries.with_control_strings(spark.read.parquet(f"{SF}/conversations.parquet")).collect()
    by = defaultdict(list)
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        by[t.conv_id].append(t)
    out = queries.op2_chat_windows(spark, SF).collect()
    assert {r.conv_id for r in out} == set(by)
    for r in out:
        own = by[r.conv_id]
        said = "".join(f"{t.role}\n{t.text}\n" for t in own)
        loss = "".join(t.text for t in own if t.role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
