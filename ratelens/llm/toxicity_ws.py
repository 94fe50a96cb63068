"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters are binary: each fires on a document or doesn't. One looks for a short fixed list of insults, one for
insults next to "you", one for shouted insults; the others are lexicons mined from labelled rows: word and
prefix hashes ranked by how much more often labelled-toxic documents hold them, dealt out over several
lexicons, some of which fire on one match and some on several different or repeated ones.

The label model is generative and models correlations: given the class, each voter depends on at most one other
voter, and these dependences form a forest (the strongest by mutual information given the class). So
P(votes, class) = P(class) * product of P(vote | class, the voter that it depends on), and voters with the same source
don't count twice. It is fitted by expectation maximisation on the counts of vote patterns over all documents; the
forest is found anew every few rounds. With V voters there are at most 2**V patterns (V is 10), so what reaches the
driver for it has a fixed bound. Labels of the training fold calibrate the fit: a labelled document of a pattern
is of its label's class with a probability of at least `trust`. Without labels the fixed voters start it alone.

A logistic regression on hashed words and prefixes of whole texts is trained on the label model's posteriors (given votes,
and for labelled documents the calibration, too) of at most `bound` labelled (parameter, 4000) and `unlabelled` further documents (parameter, 2000) outside the
held-out fold; its scores are the result. Its features are the `kept` ones most different between the
classes that the posteriors tell apart.

Defined results: null and wordless texts get the score of a document without features; if no document of the sample
has a posterior over 0.5 every score is 0; ids may be of any type and keep it, null included; repeated rows each get a
row and train once; very long texts count whole; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm import textkernel as tk
from ratelens.llm.keys import type_of
from ratelens.llm.sampling import labelled_texts, remainder

BITS = 20
PREFIXES = (4, 5, 6, 7)
LEXICONS = 7
#: Insults that the fixed voters look for.
INSULTS = "disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split()
_YOU = "you your youre".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("\n".join(words).encode(), dtype=np.uint8)
    return np.sort(tk.words(data, np.array([0, len(data)]), tk.NOT_ALNUM).hashes())


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray, list[np.ndarray]]:
    """Words, their 64-bit hashes, and BITS-bit features: the whole word and its prefixes (longer words only)."""
    w = tk.words(data, offsets, tk.NOT_ALNUM)
    whole = w.hashes()
    kinds = [(whole >> np.uint64(64 - BITS)).astype(np.int64)]
    for k in PREFIXES:
        cut = tk.Words(w.data, w.start, np.minimum(w.end, w.start + k), w.ptr)
        h = (tk.mix(cut.hashes() + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        kinds.append(np.where(w.end - w.start > k, h, -1))
    return w, whole, kinds


def counted(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of distinct features; keep is a table of the features to look at."""
    w, _, kinds = _tokens(data, offsets)
    doc = w.doc.astype(np.int64)
    keys = []
    for h in kinds:
        ok = h >= 0
        if keep is not None:
            ok &= keep[h]
        keys.append((doc[ok] << BITS) | h[ok])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def _fixed_votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x 3: an insult; an insult within two words of "you"; two insults or more, or a shouted one."""
    w, whole, _ = _tokens(data, offsets)
    n = len(offsets) - 1
    insult, you = np.isin(whole, _word_hashes(INSULTS)), np.isin(whole, _word_hashes(_YOU))
    near = insult.copy()
    reach = np.zeros(len(you), dtype=bool)
    doc = w.doc
    for d in (1, 2):
        same = doc[d:] == doc[: len(doc) - d]
        reach[d:] |= you[: len(you) - d] & same
        reach[: len(you) - d] |= you[d:] & same
    near &= reach
    number = np.bincount(w.doc[insult], minlength=n)
    followed = w.end < offsets[1:][doc]
    shouted = insult & followed & (data[np.where(followed, w.end, 0)] == 33) if len(data) else insult
    return np.stack([number > 0, np.bincount(w.doc[near], minlength=n) > 0, (number > 1) | (np.bincount(w.doc[shouted], minlength=n) > 0)], axis=1)


def _lexicon_votes(lexicon: np.ndarray, doc: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """documents x LEXICONS; lexicon is 1 + its number for mined features, else 0. Odd lexicons need three matches."""
    of = lexicon[feature]
    votes = np.stack([np.bincount(doc[of == j + 1], count[of == j + 1], minlength=n) for j in range(LEXICONS)], axis=1)
    return votes >= np.where(np.arange(LEXICONS) % 2, 3, 1)


def mine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """(features for the classifier, lexicon number of every feature) from labelled documents."""
    width = 1 << BITS
    size = max(1, labels.sum()), max(1, (1 - labels).sum())
    held = [np.zeros(width), np.zeros(width)]
    sums = [np.zeros(width), np.zeros(width)]
    for (f, c), y in zip(rows, labels):
        held[int(y)][f] += 1
        sums[int(y)][f] += np.log1p(c)
    p, q = held[1] / size[0], held[0] / size[1]
    spread = np.sqrt((held[1] + held[0] + 1) / (size[0] + size[1])) / np.sqrt(min(size))
    gain = np.abs(sums[1] / size[0] - sums[0] / size[1]) / spread
    gain[(held[1] + held[0]) < 3] = 0
    features = np.sort(np.argsort(-gain, kind="stable")[:kept])
    features = features[gain[features] > 0]
    odds = np.where((held[1] >= 3) & (p > 4 * q), (p - q) / spread, 0)
    ranked = np.argsort(-odds, kind="stable")[: 30 * LEXICONS]
    lexicon = np.zeros(width, dtype=np.int8)
    for i, f in enumerate(ranked[odds[ranked] > 0]):
        lexicon[f] = 1 + i % LEXICONS
    return features, lexicon


def _dependences(patterns: np.ndarray, weights: list[np.ndarray], least: float = 1e-4) -> np.ndarray:
    """For each voter the one that it depends on, or -1: a maximum spanning forest by mutual information given the class."""
    v, total = patterns.shape[1], max(1e-9, sum(w.sum() for w in weights))
    shared = np.zeros((v, v))
    for w in weights:
        mass = max(1e-9, w.sum())
        for x in (0, 1):
            for y in (0, 1):
                a, b = (patterns == x).astype(float), (patterns == y).astype(float)
                both = (a * w[:, None]).T @ b / mass
                apart = np.outer(w @ a, w @ b) / mass**2
                shared += mass / total * np.where(both > 0, both * np.log(np.maximum(both, 1e-300) / np.maximum(apart, 1e-300)), 0)
    parent, inside = np.full(v, -1), np.zeros(v, dtype=bool)
    for _ in range(v):
        # The strongest tie from the forest to a voter outside; without one the next voter stands alone.
        ties = np.where(inside[:, None] & ~inside[None, :], shared, -1.0)
        i, j = np.unravel_index(np.argmax(ties), ties.shape)
        if ties[i, j] > least:
            parent[j], inside[j] = i, True
        else:
            inside[np.flatnonzero(~inside)[0]] = True
    return parent


def _tables(patterns: np.ndarray, parent: np.ndarray, weights: list[np.ndarray], smooth: float = 0.5) -> np.ndarray:
    """P(vote = 1 | class, value of the parent) as an array class x value x voter; without a parent both values agree."""
    out = np.zeros((2, 2, patterns.shape[1]))
    for y, w in enumerate(weights):
        for j, up in enumerate(parent):
            for value in (0, 1):
                here = w if up < 0 else w * (patterns[:, up] == value)
                mean = (w @ patterns[:, j] + smooth) / (w.sum() + 2 * smooth)
                out[y, value, j] = (here @ patterns[:, j] + 4 * mean * smooth) / (here.sum() + 4 * smooth)
    return np.clip(out, 1e-6, 1 - 1e-6)


def _margin(model: dict, votes: np.ndarray) -> np.ndarray:
    """log odds of toxic given votes."""
    parent, value = model["parent"], np.where(model["parent"] >= 0, votes[:, np.maximum(model["parent"], 0)], 0).astype(int)
    at = np.arange(len(parent))
    on = [model["tables"][y][value, at] for y in (0, 1)]
    gain = np.where(votes > 0, np.log(on[1] / on[0]), np.log((1 - on[1]) / (1 - on[0])))
    return np.log(model["prior"] / (1 - model["prior"])) + gain.sum(axis=1)


def label_posterior(model: dict, votes: np.ndarray) -> np.ndarray:
    """P(toxic | votes)."""
    return 1 / (1 + np.exp(-_margin(model, votes)))


def given_label(posterior: np.ndarray, label: np.ndarray | int, trust: float = 0.95) -> np.ndarray:
    """The posterior of a document with a label (-1: none), which is right with a probability of at least `trust`."""
    return np.where(np.equal(label, 1), np.maximum(posterior, trust), np.where(np.equal(label, 0), np.minimum(posterior, 1 - trust), posterior))


def label_model(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, rounds: int = 60, trust: float = 0.95, correlated: bool = True) -> dict:
    """Fit by EM. patterns: P x V of 0 and 1; counts: documents of each pattern; gold: P x 2 labelled 0 and 1 among them."""
    free = np.maximum(0, counts - gold.sum(axis=1))
    if gold[:, 0].sum() and gold[:, 1].sum():
        # Together the unlabelled documents weigh as much as the labelled ones, so that they can't outvote the calibration.
        free = free * min(1.0, gold.sum() / max(1.0, free.sum()))
    counts = free + gold.sum(axis=1)
    if gold[:, 0].sum() and gold[:, 1].sum():
        prior, weights = float(np.clip(gold[:, 1].sum() / gold.sum(), 0.01, 0.99)), [gold[:, 0], gold[:, 1]]
    else:
        first = np.where(patterns.sum(axis=1) > 0, 0.9, 0.001)
        prior, weights = float(np.clip((counts @ first) / max(1, counts.sum()), 0.001, 0.5)), [counts * (1 - first), counts * first]
    model = {"prior": prior, "parent": _dependences(patterns, weights) if correlated else np.full(patterns.shape[1], -1)}
    model["tables"] = _tables(patterns, model["parent"], weights)
    for i in range(rounds):
        r = label_posterior(model, patterns)
        toxic = free * r + gold[:, 1] * given_label(r, 1, trust) + gold[:, 0] * given_label(r, 0, trust)
        weights = [counts - toxic, toxic]
        if correlated and i % 10 == 9:
            model["parent"] = _dependences(patterns, weights)
        model["prior"] = float(np.clip(toxic.sum() / max(1, counts.sum()), 1e-4, 1 - 1e-4))
        model["tables"] = _tables(patterns, model["parent"], weights)
    return model


def train_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, width: int, epochs: int = 40, batch: int = 256, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad; rows hold dense feature numbers and values."""
    rng = np.random.default_rng(seed)
    w, b, seen, seen_b = np.zeros(width), 0.0, np.full(width, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            f, x = (np.concatenate([rows[i][c] for i in part]) for c in (0, 1))
            error = (1 / (1 + np.exp(-(b + np.bincount(doc, w[f] * x, minlength=len(part))))) - target[part]) / len(part)
            g = np.bincount(f, error[doc] * x, minlength=width) + decay * w
            seen += g * g
            seen_b += error.sum() ** 2
            w -= rate * g / np.sqrt(seen)
            b -= rate * error.sum() / np.sqrt(seen_b)
    return w, b


def _training_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, c, fixed = [], [], []
            for first, end, data, offsets in tk.chunks(batch.column("text")):
                doc, feature, count = counted(data, offsets)
                at = np.searchsorted(doc, np.arange(end - first + 1))
                f += [feature[a:b].astype(np.int32) for a, b in zip(at, at[1:])]
                c += [count[a:b].astype(np.int32) for a, b in zip(at, at[1:])]
                fixed += (_fixed_votes(data, offsets) @ np.array([1, 2, 4])).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(f, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int32())), pa.array(fixed, pa.int32())], names=["label", "f", "c", "fixed"])

    return run


def _patterns(shared):
    """Counts of vote patterns of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        total = np.zeros(1 << (3 + LEXICONS), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column("text")):
                n = len(offsets) - 1
                votes = np.concatenate([_fixed_votes(data, offsets), _lexicon_votes(lexicon, *counted(data, offsets, lexicon > 0), n)], axis=1)
                total += np.bincount(votes @ (1 << np.arange(votes.shape[1])), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pattern", "n"])

    return run


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weight, bias = shared.value
        keep, at = np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS, dtype=np.int32)
        keep[features] = True
        at[features] = np.arange(len(features))
        for batch in batches:
            out = []
            for first, end, data, offsets in tk.chunks(batch.column("text")):
                doc, f, c = counted(data, offsets, keep)
                out.append(1 / (1 + np.exp(-(bias + np.bincount(doc, weight[at[f]] * np.log1p(c), minlength=end - first))))) if len(features) else out.append(np.zeros(end - first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: int, modulus: int, bound: int, unlabelled: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of the bounded training sample; label is -1 for the documents taken without a look at labels."""
    known = labelled_texts(docs, labels, label_col, held_out, modulus, bound, id_col, text_col).select("text", "label")
    ids = docs.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull() & (remainder(F.col("__id"), modulus) != held_out)).distinct()
    drawn = ids.orderBy(F.xxhash64(F.lit("unlabelled"), "__id"), "__id").limit(unlabelled)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    others = texts.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).groupBy("__doc").agg(F.max("text").alias("text"))
    return known.union(others.select("text", F.lit(-1).alias("label")))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: int = 1, modulus: int = 3, bound: int = 4000, unlabelled: int = 2000, kept: int = 4000, correlated: bool = True, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The classifier (features, weights, bias) and the label model behind it."""
    context = docs.sparkSession.sparkContext
    sample = _sample(docs, labels, label_col, held_out, modulus, bound, unlabelled, id_col, text_col)
    found = sample.mapInArrow(_training_rows(), "label int, f array<int>, c array<int>, fixed int").toArrow()
    y = np.array(found["label"].to_pylist(), dtype=np.int64)
    f, c = ([a.values.to_numpy() for a in found.column(x)] for x in ("f", "c"))
    order = sorted(range(len(y)), key=lambda i: (y[i], len(f[i]), f[i].tobytes(), c[i].tobytes()))
    rows, y, fixed = [(f[i], c[i]) for i in order], y[order], np.array(found["fixed"].to_pylist(), dtype=np.int64)[order]
    nothing = {"features": np.zeros(0, dtype=np.int64), "weight": np.zeros(0), "bias": 0.0}
    if not len(y):
        return nothing
    known = np.flatnonzero(y >= 0)
    lexicon = mine([rows[i] for i in known], y[known], kept)[1] if len(np.unique(y[known])) == 2 else np.zeros(1 << BITS, dtype=np.int8)
    own = np.concatenate([_lexicon_votes(lexicon, np.zeros(len(a), dtype=np.int64), a, b, 1) for a, b in rows])
    votes = np.concatenate([(fixed[:, None] >> np.arange(3)) & 1, own], axis=1).astype(np.float64)

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_patterns(context.broadcast(lexicon)), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(1 << votes.shape[1])
    for r in counts:
        n[r["pattern"]] = r["n"]
    code = (votes @ (1 << np.arange(votes.shape[1]))).astype(np.int64)
    gold = np.stack([np.bincount(code[y == k], minlength=len(n)) for k in (0, 1)], axis=1).astype(np.float64)
    seen = np.flatnonzero((n > 0) | (gold.sum(axis=1) > 0))
    patterns = ((seen[:, None] >> np.arange(votes.shape[1])) & 1).astype(np.float64)
    model = label_model(patterns, np.maximum(n, gold.sum(axis=1))[seen], gold[seen], correlated=correlated)

    posterior = given_label(label_posterior(model, votes), y)
    if posterior.max() <= 0.5:
        return nothing | {"label_model": model}
    features = mine(rows, (posterior > 0.5).astype(np.int64), kept)[0]
    at = np.full(1 << BITS, -1, dtype=np.int64)
    at[features] = np.arange(len(features))
    dense = [(at[a][at[a] >= 0], np.log1p(b)[at[a] >= 0]) for a, b in rows]
    weight, bias = train_linear(dense, posterior, len(features))
    return {"features": features, "weight": weight, "bias": bias, "label_model": model}


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 1, modulus: int = 3, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, held_out=held_out, modulus=modulus, id_col=id_col, text_col=text_col, **settings)
    shared = docs.sparkSession.sparkContext.broadcast((model["features"], model["weight"], model["bias"]))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = base.mapInArrow(_scores(shared), f"doc_id {type_of(base, 'doc_id')}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
