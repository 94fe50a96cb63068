import random
import re
from collections import defaultdict

import pytest

from ratelens.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, uid string, n string, component_id string"


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_force(rows):
    """component of each row: links by exact sets between all rows."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 200]))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (0, 1, 2, 4):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append("  ".join(c).upper() if edits == 1 else " ".join(c))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]) for _ in range(40)]
    hub = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        c = list(hub)
        for _ in range(3):
            c[rng.randrange(len(c))] = f"x{i}"
        texts.append(" ".join(c))
    texts += ["", None, "one", "one", "One two", "\t \n", " ".join(f"long{i % 997}" for i in range(30_000)), " ".join(f"long{i % 997}" for i in range(30_000)) + " end"]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    return [(i, t, "clash", "clash", "clash") for i, t in zip(ids, texts)]


@pytest.mark.parametrize("leaf", [1024, 24])
def test_matches_brute_force(spark, leaf):
    """With leaf = 24 the nodes of the hub and of the passage branch."""
    rows = corpus()
    out = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=leaf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_nulls_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text), (None, None), (5, text), (5, text), (5, "quite another text with other words in it"), (7, text + " k"), (8, None)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=str)
    assert got == sorted([(None, 6, 5, False), (None, 0, None, True), (5, 6, 5, True), (5, 6, 5, True), (5, 4, 5, True), (7, 7, 5, False), (8, 0, 8, True)], key=str)
    empty = near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []


def test_keep_one_keeps_columns_and_one_of_a_group(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows + rows[:5], SCHEMA)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    expected = sorted({r[2] for r in brute_force(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 150), (7, 7)]
    got = {r.id: r.comp for r in near_dup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 150)) and got[200] == got[150] == 150


@pytest.mark.parametrize("leaf", [4096, 16])
def test_recall_of_pairs_at_the_threshold(spark, leaf):
    """120 pairs of exactly 300 common of 400 shingles, all of whose members share a passage of 60 words."""
    rng = random.Random(leaf)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for pair in range(120):
        own = [f"p{pair}w{i}" for i in range(294)]
        other = list(own)
        for i in range(10, 290, 28):
            other[i] = f"q{pair}x{i}"
        at = rng.randrange(0, 2)
        for member, words in enumerate((own, other)):
            docs.append((2 * pair + member, " ".join(common + words if at else words + common)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), leaf=leaf).collect()}
    found = sum(got[2 * p] == got[2 * p + 1] == 2 * p for p in range(120))
    assert found == 120
