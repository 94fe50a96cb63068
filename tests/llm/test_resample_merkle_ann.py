import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratelens.llm import graph_ann, merkle, resample
from ratelens.sources import ranges

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, order=3):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def resampled(docs, items, percent=5, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    t = Counter(bucket(f) for _, text in items for f in features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))
    rows = []
    for doc_id, text in docs:
        w, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ÑA", "日本", "x-y", "A_B"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "!!! --"), (None, docs[5][1]), (303, docs[7][1]), (303, docs[7][1]), (304, "ab " * 60_000), (305, docs[8][1].upper())]
    return docs, [(i, " ".join(rng.choice(vocabulary[:12]) for _ in range(25))) for i in range(20)] + [(20, None)]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resample_matches_brute_force(spark, percent):
    docs, items = texts()
    d = spark.createDataFrame([(a, b, 1, "clash") for a, b in docs], "doc_id long, text string, weight int, rank string")
    got = resample.resample(d, spark.createDataFrame(items, "item_id long, text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(resampled(docs, items, percent), key=str)


def test_resample_empty_tables_and_text_ids(spark):
    docs, items = texts()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert resample.resample(d.limit(0), b).collect() == []
    assert sorted(map(tuple, resample.resample(d, b.limit(0)).collect()), key=str) == sorted(resampled(docs, []), key=str)
    named = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_features for r in resample.resample(named, b).collect()} == {"a": 3, "b": 0}


def test_ring_scans_long_texts_in_pieces():
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    pieces = list(resample.ring(text.encode(), 3, 10_000))
    assert len(pieces) > 1 and sum(words for words, _ in pieces) == 200_000
    assert Counter(np.concatenate([hit for _, hit in pieces]).tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text)[1])


def test_numbered_counts_in_order(spark):
    rows = [(i * 7919 % 1000, "a") for i in range(1000)] + [(5, "b")] * 3
    got = ranges.numbered(spark.createDataFrame(rows, "v int, s string"), [ranges.F.col("v").desc(), ranges.F.col("s").asc()], "place").collect()
    assert [(r.v, r.s) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in got) == list(range(1003))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, fan=8):
    """(root, for each leaf its list of (siblings before, siblings after))."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // fan * fan
            proofs[i].append((level[run:a], level[a + 1 : run + fan]))
        level = [sha(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [a // fan for a in at]
    return level[0], proofs


def manifest_of(docs, fan=8):
    by = defaultdict(list)
    for doc_id, text, lang, source, n in docs:
        low = text if text is None or zlib.crc32(str(doc_id).encode()) % 3 or doc_id is None else text.translate(LOWER)
        digest = lambda t: sha(*map(spelled, (doc_id, source, lang, n, t)))  # noqa: E731, B023
        by[lang].append((doc_id, digest(text), digest(low)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        rows = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[lang] = (rows, *tree([r[1] for r in rows], fan))
    root, above = tree([made[lang][1] for lang in langs], fan)
    out = []
    for lang, top in zip(langs, above):
        rows, subroot, proofs = made[lang]
        for (doc_id, first, now), proof in zip(rows, proofs):
            for before, after in proof + top:
                now = sha(*before, now, *after)
            whole = "".join("".join(before + after) for before, after in proof + top)
            out.append((doc_id, first, subroot, root, sha(whole), now, now == root))
    return out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("langs", [["en"], ["en", None, "de", "Zz", "é"], [f"l{i}" for i in range(70)]])
def test_manifest_matches_brute_force(spark, langs):
    rng = random.Random(len(langs))
    docs = [(i, rng.choice(["Abc", "plain", None, "", "Ünï ABC " * 30]), rng.choice(langs + langs[:1] * len(langs)), rng.choice([None, "s"]), rng.choice([None, 3])) for i in range(700)]
    docs += [docs[4], docs[4], (None, "Null Id", langs[0], None, 1), (900, "LONG " * 100_000, langs[-1], "s", 5), (901, "Alone", "only one", "s", 5)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], COLUMNS + ", leaf string, tree int")
    got = merkle.tampered_digest(d)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(manifest_of(docs), key=str)


def test_manifest_small_tables(spark):
    assert merkle.tampered_digest(spark.createDataFrame([], COLUMNS)).collect() == []
    for docs in ([(1, "One", "en", None, 3)], [(i, "same", None, None, 3) for i in range(9)], [(7, "Same", "en", "s", 4)] * 65):
        assert sorted(map(tuple, merkle.tampered_digest(spark.createDataFrame(docs, COLUMNS)).collect()), key=str) == sorted(manifest_of(docs), key=str)


def nearest_of(rows, every=50, k=5):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        kept[i] = max(kept.get(i, v), v)
    out = {}
    for q, v in kept.items():
        if q % every == 0:
            near = [(-float(graph_ann.cosine(np.array(v, float), np.array(u, float))), i) for i, u in kept.items() if i != q and len(u) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def vectors(seed=0, n=3000, copies=900, dim=16):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)).astype(np.float32)
    points[rng.permutation(n)[:copies]] = points[0]
    near = rng.permutation(n)[:300]
    points[near] = points[1] + rng.normal(size=(300, dim)).astype(np.float32) * 0.05
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("rows_per_shard", [None, 200])
def test_nearest_recall(spark, rows_per_shard):
    rows = vectors()
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, None] * 8), (5004, [float("nan")] * 16), (5050, [float("inf")] + [1.0] * 15), (None, rows[3][1]), (5100, [1e200] * 16), (5101, [1e-200] * 16), (5150, [1.0, 2.0]), (5151, [2.0, 4.0]), (50, [-9.0] * 16), rows[100]]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in graph_ann.nearest(d, rows_per_shard=rows_per_shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    true = nearest_of(rows + odd)
    assert set(got) == set(true) and all(len(got[q]) == len(true[q]) for q in true)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true) / sum(map(len, true.values()))
    assert hits >= 0.97
    kept = dict(reversed(rows + odd)) | {50: max(rows[50][1], [-9.0] * 16)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in found}
        for i, s in found:
            assert s == pytest.approx(float(graph_ann.cosine(np.array(kept[q]), np.array(kept[i]))), abs=1e-12)
    assert [i for i, _ in got[5150]] == [5151]


def test_nearest_copies_are_named_by_smallest_ids(spark):
    d = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(400)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in graph_ann.nearest(d).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i in range(7) if i != q][:5] for q in range(0, 400, 50)}


def test_nearest_empty(spark):
    assert graph_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert graph_ann.nearest(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).collect() == []
