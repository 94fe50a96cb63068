import hashlib
import random
import re

import pytest

from ratelens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(window, len(v))
            if item_id is None or not size:
                continue
            for win in {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}:
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) == win:
                        hit.update(range(i, i + size))
                        found.add(item_id)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)] + ["Été", "ÑA", "x-y"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 10, 15, 40])))) for i in range(30)]
    items += [(3, items[3][1]), (None, items[4][1]), (90, None), (91, ""), (92, "!!!"), (93, items[5][1])]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            v = words(rng.choice(items[:30])[1])
            cut = rng.randrange(len(v))
            at = rng.randrange(len(w) + 1)
            w[at:at] = v[max(0, cut - 12) : cut + 12]
        docs.append((i, ", ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[8][1]), (202, docs[0][1]), (202, docs[0][1]), (203, "filler " * 50_000 + items[6][1])]
    return docs, items


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_matches_brute_force(spark, block):
    docs, items = tables()
    d = spark.createDataFrame([(a, b, "clash", 1) for a, b in docs], "doc_id long, text string, items string, n_words int")
    hits = decontaminate.benchmark_hits(d, spark.createDataFrame(items, "item_id long, text string"), block=block)
    got = decontaminate.summary(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(docs, items)


def test_blocks_are_probed_one_at_a_time(spark):
    """With several blocks each is a stage of its own: the last plan holds one probe over a written table."""
    docs, items = tables(3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.benchmark_hits(d, b, block=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "bd-hits" in plan


def test_text_ids(spark):
    docs, items = tables(4)
    d = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    b = spark.createDataFrame([(None if i is None else f"q{i}", t) for i, t in items], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.benchmark_hits(d, b).withColumn("n_hit", decontaminate.F.size("spans")).collect()}
    want = decontaminate.summary(decontaminate.benchmark_hits(d, b)).collect()
    assert sum(r.n_items for r in want) > 10
    for r in want:
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(got[r.doc_id][1])).encode()).hexdigest()
    named = brute_force([(f"d{i}", t) for i, t in docs], [(None if i is None else f"q{i}", t) for i, t in items])
    assert sorted(map(tuple, decontaminate.summary(decontaminate.benchmark_hits(d, b)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str) == named


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontaminate.summary(decontaminate.benchmark_hits(d, b)).collect()] == [(3, False)]
    assert decontaminate.benchmark_hits(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_drop_keeps_clean_documents_and_columns(spark):
    docs, items = tables(2)
    d = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, source string")
    left = decontaminate.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == d.columns
    clean = sorted([r[0] for r in brute_force(docs, items) if not r[5]], key=str)
    assert sorted([r.doc_id for r in left.collect()], key=str) == clean
