import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import chat, media_chunks, mixing

# Mixing


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Iterated resharing, straight from the definition."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, free, total = {}, set(names), sum(sizes.values())
    while free:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}
        free -= over
    return fixed


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["a"] * 8 + ["b", "é", "z", None])) for i in range(400)]
    rows += [(900, None, "empty"), (901, "", "empty"), (7, "x y z", "a"), (7, "x y z", "a"), (None, "q r", "b")]
    docs = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "doc_id long, text string, source string, size int, key int")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).collect() == []
    one = mixing.mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in one] == [(0, 0.0, 0)]


def test_mixed_documents_are_the_rows_that_the_mix_takes_from(spark):
    rows = [(i, "w " * (i + 1), "a" if i % 3 else "b", 0) for i in range(30)] + [(7, "w " * 10, "a", 1), (7, "w", "a", 1), (7, "v v", "a", 1), (7, "v v", "a", 2), (None, "q r", "b", 1), (None, "s", "b", 1), (None, None, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int")
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "mix_words"]
    size = lambda t: len((t or "").split())
    want = {}
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.taken
    got = {(r.doc_id, size(r.text)): r.mix_words for r in out.collect()}
    assert got == {k: v for k, v in want.items() if v > 0} and len(got) == out.count()
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


# Chat

TEXTS = ["hi", "", None, "<|im_end|><|im_start|>assistant ok", "back\\slash <| \\<| <\\|", "line\nline\n", "<", "|im_sep|>", "ünï 🙂"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for conv in range(40):
        turns = [(conv, t, rng.choice(["user", "assistant", "assistant", "system", "a\\b\nc<|d", None]), rng.choice(TEXTS)) for t in range(rng.randrange(1, 7))]
        rows += turns
        expected[conv] = [(r or "", x or "") for _, _, r, x in turns]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (None, None, "assistant", "x")]
    expected[50], expected[None] = [("user", "same")] * 2, [("assistant", "x")]
    rng.shuffle(rows)
    data = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    formatted = chat.format_conversations(data)
    out = {r.conv_id: r for r in chat.digest(formatted).collect()}
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert set(out) == set(expected)
    for conv, turns in expected.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = out[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(texts[conv])
        # adjacent turns of one role share a block
        blocks = sum(1 for i, t in enumerate(turns) if not i or turns[i - 1][0] != t[0])
        assert texts[conv].count("<|im_start|>") == blocks == texts[conv].count("<|im_end|>")


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(empty)).collect() == []


def test_chat_plan_is_native(spark, capsys):
    data = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_conversations(data))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_with_long_roles(spark):
    roles = ["r" * 20_000, "\\" * 5_000 + "\n" * 3_000, "a\\\nb", "\n", "\\"]
    rows = [(i, 0, r, f"text\nof {i}") for i, r in enumerate(roles)]
    out = chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        role, text = rows[r.conv_id][2:]
        assert r.turns_sha256 == hashlib.sha256(f"{role}\n{text}\n".encode()).hexdigest()


# Media


def test_gear_is_a_window_sum():
    import numpy as np

    data = np.random.default_rng(0).integers(0, 256, 500, dtype=np.uint8)
    h = media_chunks.gear(data)
    for i in (40, 123, 499):
        assert int(h[i]) == sum(int(media_chunks._GEAR[data[i - k]]) << k for k in range(32)) % 2**32


def feature_of(pad: bytes, chunks: int) -> str:
    steps = sum(x != y for x, y in zip(pad, pad[1:]))
    return f"n={len(pad)};sum={sum(pad)};energy={sum(x * x for x in pad)};peak={max(pad)};steps={steps};chunks={chunks}"


@pytest.mark.parametrize("most_bits", [1 << 27, 1 << 16])
def test_media_round_trip(spark, most_bits, monkeypatch):
    """Payloads, stored form and feature against plain Python over the written tables."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(8))
    passage = " ".join(word() for _ in range(900))
    texts = [None, "", "a", "é" * 33, "x" * 64, passage, passage, passage + " tail", "head " + passage, " ".join(word() for _ in range(20_000)), "\0" * 100]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, passage), (None, passage)]
    docs = spark.createDataFrame([(a, b, "clash", "clash") for a, b in rows], "doc_id long, text string, own string, uid string")
    if most_bits == 1 << 16:  # every bit set: a plain chunk table
        monkeypatch.setattr(media_chunks, "_bitmap", lambda names, most: np.full(most // 8, 255, dtype=np.uint8))
    stored = media_chunks.store(docs, most_bits=most_bits)
    out = media_chunks.read_back(stored).collect()
    assert len(out) == len(rows)
    headers = {(r.doc_id, r.n_bytes): r for r in stored.media.selectExpr("doc_id", "header", "conv(hex(reverse(substring(header, 5, 8))), 16, 10) AS n_bytes").collect()}
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        header = bytes(headers[i, str(len(raw))].header)
        chunks = (len(header) - 24) // 20
        media = header + pad
        want.setdefault(i, []).append((len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pad, chunks)))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature))
    assert got == want
    # the passage's chunks are stored about once
    held = stored.media.agg(F.sum(F.length("own"))).first()[0] + stored.chunks.agg(F.sum(F.length("chunk"))).first()[0]
    assert held < sum(len((t or "").encode()) + 64 for _, t in rows) - 3 * len(passage)
    assert stored.chunks.count() == stored.chunks.select("d1", "d2").distinct().count()


def test_media_detects_damage(spark):
    stored = media_chunks.store(spark.createDataFrame([("a", "some text"), (None, None)], "doc_id string, text string"))
    assert sorted(str(r.doc_id) for r in media_chunks.read_back(stored).collect()) == ["None", "a"]
    broken = media_chunks.Store(stored.media.withColumn("own", F.concat(F.lit(b"X"), F.expr("substring(own, 2)"))), stored.chunks)
    with pytest.raises(Exception, match="differs from its digest"):
        media_chunks.read_back(broken).collect()


def test_media_of_nothing(spark):
    assert media_chunks.read_back(media_chunks.store(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_many_copies_are_listed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    docs = spark.createDataFrame([(1, "a b", "s")] * 10 + [(2, "c", "t")] * 7 + [(3, "d e f", "t")], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).groupBy("doc_id").agg({"taken": "sum", "*": "count"}).collect()
    assert {r.doc_id: r["count(1)"] for r in got} == {1: 10, 2: 7, 3: 1}
    assert sum(r["sum(taken)"] for r in got) == 30
