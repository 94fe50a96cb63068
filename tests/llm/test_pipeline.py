"""Every stage of corpus_pipeline on a small folder of tables, against plain Python over the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratelens.llm import mixing, quality_fm, secrets_rf
from tests.llm.test_near_dup import brute_force

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, mix_words int"


def windows_hit(text, items, size=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    for item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(LOWER))
        n = min(size, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(words[i : i + n]) in wanted for i in range(len(words) - n + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([30, 12, 4, 10])] + [(90, None), (91, "")]
    docs, labels = [], []
    for i in range(160):
        w = rng.choices(words, k=rng.randrange(30, 90))
        bad = i % 5 == 0
        if i % 11 == 1:
            w[5:5] = items[i % 4][1].split()
        if i % 13 == 2:
            w[7:7] = ["token", "=", f'"{KEY}"']
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        docs.append((i, text, "en", rng.choice("abc"), len(text), "clash", 1))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(200 + i, docs[i][1] + (" more" if i % 2 else ""), "en", "a", 1, "x", None) for i in range(30)]
    docs += [(300, None, None, None, None, None, None), (301, "", "en", "a", 0, "", 0), docs[3], docs[3], (None, docs[4][1], "en", "b", 5, "", 0), (302, "long words here " * 20_000, "en", "c", 1, "", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = docs.drop("mix_words")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "near_dedup", "decontaminate", "secrets", "mix"]

    good = stages["quality"](spark, plain, folder)
    wanted = {r.doc_id for r in quality_fm.classify(plain, labels).where("predicted = 1").collect()}
    assert good.columns == plain.columns and {r.doc_id for r in good.collect()} == wanted and len(wanted) > 100

    kept = stages["near_dedup"](spark, plain, folder)
    rows = [(r.doc_id, r.text) for r in plain.collect()]
    assert kept.columns == plain.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_force(rows)})

    clean = stages["decontaminate"](spark, plain, folder).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r in plain.collect() if not windows_hit(r.text, items)) and len(clean) < plain.count()

    masked = {(r.doc_id, r.text) for r in stages["secrets"](spark, plain, folder).collect()}
    spans = {}
    for r in secrets_rf.scan(plain).where("is_secret").collect():
        spans.setdefault(r.doc_id, set()).add((r.start, r.length))
    expected = set()
    for i, t in rows:
        for start, length in sorted(spans.get(i, ()), reverse=True):
            t = t[:start] + "[SECRET]" + t[start + length :]
        expected.add((i, t))
    assert masked == expected and not any(KEY in (t or "") for _, t in masked)

    mixed = stages["mix"](spark, plain, folder)
    taken = {}
    for r in mixing.mix_sources(plain).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {r.doc_id: r.mix_words for r in mixed.collect()} == {k: v for k, v in taken.items() if v > 0}


def test_run_is_the_stages_in_a_row(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("mix_words")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "mix_words"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{i}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}.parquet")
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_stages_of_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("mix_words")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert dict(corpus_pipeline.STAGES)["decontaminate"](spark, docs, str(tmp_path)).count() == docs.count()


def test_ids_that_are_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).drop("mix_words")
    for name in ("near_dedup", "decontaminate", "secrets", "mix"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder).count() > 0, name
