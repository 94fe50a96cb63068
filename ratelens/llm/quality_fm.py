"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The second form of the pairwise term is linear in the number of features of a document. Features are the
distinct words of the whole text (hashed; log counts scaled to unit length), statistics of its structure (shares
of capitals, digits, symbols, breaks and non-ASCII bytes, word length, distinct and repeated words, length; one
indicator for each interval) and the lengths that come as metadata columns.

Training runs on at most `bound` labelled documents (parameter, 6000), whose features come to the driver as
arrays of a few MB; the model is a few hundred kB and is broadcast. Scoring reads every whole text once, without
a shuffle.

Defined results: null, empty and wordless texts are scored from their structure statistics; without labelled rows
every score is 0.5; metadata that is null or that the table lacks has an interval of its own; ids may be of any type and
keep it, null included; repeated rows each get a row and train once; very long texts count whole; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm import textkernel as tk
from ratelens.llm.keys import type_of
from ratelens.llm.sampling import labelled_texts, remainder

WORD_BITS = 15
INTERVALS = 16
STATISTICS = 11
FACTORS = 4

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[[*b"!?"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13]] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[offsets])


def distinct_words(w: tk.Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word, count) of the distinct words of each document, sorted."""
    key = (w.doc.astype(np.int64) << bits) | (w.hashes() >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def features(data: np.ndarray, offsets: np.ndarray, metadata: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), sorted by document."""
    n = len(offsets) - 1
    w = tk.words(data, offsets, tk.SPACE)
    doc, word, count = distinct_words(w, WORD_BITS)
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(doc, value * value, minlength=n))[doc]

    size, n_words = np.diff(offsets), np.diff(w.ptr)
    letters = np.maximum(1, _per_doc(_LETTER[data], offsets))
    hashes = w.hashes()
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[w.ptr[:-1][w.ptr[:-1] < len(hashes)]] = False
    repeats = np.diff(np.concatenate([[0], np.cumsum(again)])[w.ptr])
    distinct = np.bincount(doc, minlength=n)

    def share(a, b):
        return np.sqrt(np.clip(a / np.maximum(1, b), 0, 1)) * (INTERVALS - 1)

    statistics = [
        share(_per_doc(_UPPER[data], offsets), letters),
        share(_per_doc(_DIGIT[data], offsets), size),
        share(_per_doc(_SYMBOL[data], offsets), size),
        share(_per_doc(_BANG[data], offsets), size),
        share(_per_doc(_BREAK[data], offsets), size),
        share(_per_doc(data >= 128, offsets), size),
        np.clip(size / np.maximum(1, n_words), 0, 15),
        np.clip(distinct / np.maximum(1, n_words), 0, 1) * (INTERVALS - 1),
        share(repeats, n_words),
        np.log2(1 + n_words),
        np.log2(1 + size),
    ]
    dense = [np.where(np.isnan(m), INTERVALS - 1, np.log2(1 + np.maximum(0, np.nan_to_num(m)))) for m in metadata]
    blocks = [(1 << WORD_BITS) + i * INTERVALS + np.clip(s, 0, INTERVALS - 1).astype(np.int64) for i, s in enumerate([*statistics, *dense])]
    doc = np.concatenate([doc, *[np.arange(n)] * len(blocks)])
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate([word, *blocks])[order], np.concatenate([value, np.ones(n * len(blocks))])[order]


def n_features(metadata: int) -> int:
    return (1 << WORD_BITS) + (STATISTICS + metadata) * INTERVALS


def margin(model: dict, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = model["b"] + np.bincount(doc, model["w"][feature] * value, minlength=n)
    for f in range(model["v"].shape[0]):
        z = model["v"][f][feature] * value
        out += 0.5 * (np.bincount(doc, z, minlength=n) ** 2 - np.bincount(doc, z * z, minlength=n))
    return out


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adagrad on the logistic loss over the sampled documents."""
    rng = np.random.default_rng(seed)
    model = {"b": 0.0, "w": np.zeros(width), "v": rng.normal(0, 0.02, (FACTORS, width))}
    if not len(labels) or labels.min() == labels.max():
        return model | {"v": np.zeros_like(model["v"])}
    seen = {"b": 1e-6, "w": np.full(width, 1e-6), "v": np.full((FACTORS, width), 1e-6)}
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            sizes = [len(rows[i][0]) for i in part]
            doc = np.repeat(np.arange(len(part)), sizes)
            feature, value = (np.concatenate([rows[i][c] for i in part]) for c in (0, 1))
            sums = np.stack([np.bincount(doc, model["v"][f][feature] * value, minlength=len(part)) for f in range(FACTORS)])
            error = 1 / (1 + np.exp(-margin(model, doc, feature, value, len(part)))) - labels[part]
            error /= len(part)
            g = np.bincount(feature, error[doc] * value, minlength=width) + decay * model["w"]
            seen["b"] += error.sum() ** 2
            model["b"] -= rate * error.sum() / seen["b"] ** 0.5
            seen["w"] += g * g
            model["w"] -= rate * g / np.sqrt(seen["w"])
            for f in range(FACTORS):
                v = model["v"][f]
                g = np.bincount(feature, error[doc] * value * (sums[f][doc] - v[feature] * value), minlength=width) + decay * v
                seen["v"][f] += g * g
                v -= 0.3 * rate * g / np.sqrt(seen["v"][f])
    return model


def _metadata(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]


def _training_rows(names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, f, x = _metadata(batch, names), [], []
            for first, end, data, offsets in tk.chunks(batch.column("text")):
                doc, feature, value = features(data, offsets, [m[first:end] for m in extra])
                at = np.searchsorted(doc, np.arange(end - first + 1))
                f += [feature[a:b].astype(np.int32) for a, b in zip(at, at[1:])]
                x += [value[a:b].astype(np.float32) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(f, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["label", "f", "x"])

    return run


def _scores(shared, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, out = _metadata(batch, names), []
            for first, end, data, offsets in tk.chunks(batch.column("text")):
                out.append(1 / (1 + np.exp(-margin(shared.value, *features(data, offsets, [m[first:end] for m in extra]), end - first))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("text", *names)), pa.array(scores)], names=[*(c for c in batch.schema.names if c not in ("text", *names)), "score"])

    return run


def _metadata_columns(docs: DataFrame, metadata: Sequence[str]) -> dict[str, Column]:
    """Metadata as numbers; null where the table has no such column."""
    return {f"m{i}": (F.col(c) if c in docs.columns else F.lit(None)).cast("double") for i, c in enumerate(metadata)}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: int = 2, modulus: int = 4, bound: int = 6000, metadata: Sequence[str] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model, from at most `bound` labelled documents outside the held-out fold."""
    extra = _metadata_columns(docs, metadata)
    names = [*extra]
    sample = labelled_texts(docs, labels, label_col, held_out, modulus, bound, id_col, text_col, extra)
    rows = sample.drop("doc_id").mapInArrow(_training_rows(names), "label int, f array<int>, x array<float>").toArrow()
    f, x = ([a.values.to_numpy() for a in rows.column(c)] for c in ("f", "x"))
    labels_ = np.array(rows.column("label").to_pylist(), dtype=float)
    # The order in which rows arrive is Spark's; training orders them by content.
    order = sorted(range(len(labels_)), key=lambda i: (labels_[i], len(f[i]), f[i].tobytes(), x[i].tobytes()))
    return train([(f[i], x[i].astype(np.float64)) for i in order], labels_[order], n_features(len(names)))


def score(docs: DataFrame, model: dict, metadata: Sequence[str] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every document."""
    extra = _metadata_columns(docs, metadata)
    names = [*extra]
    small = {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}
    shared = docs.sparkSession.sparkContext.broadcast(small)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(n) for n, c in extra.items()))
    return base.mapInArrow(_scores(shared, names), f"doc_id {type_of(base, 'doc_id')}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, modulus: int = 4, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, held_out=held_out, modulus=modulus, **settings)
    scored = score(docs, model, settings.get("metadata", ("n_chars",)), settings.get("id_col", "doc_id"), settings.get("text_col", "text"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, modulus: int = 4, **settings) -> DataFrame:
    """The documents with a score of at least the threshold, all columns as they came.

    The whole row passes through the scoring task, so nothing is joined back.
    """
    model = fit(docs, labels, held_out=held_out, modulus=modulus, **settings)
    extra = _metadata_columns(docs, settings.get("metadata", ("n_chars",)))
    names = [*extra]
    small = {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}
    shared = docs.sparkSession.sparkContext.broadcast(small)
    text = F.col(settings.get("text_col", "text")).cast("string")
    carried = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), *(c.alias(n) for n, c in extra.items()))
    schema = T.StructType([carried.schema["row"], T.StructField("score", T.DoubleType())])
    return carried.mapInArrow(_scores(shared, names), schema).where(F.col("score") >= threshold).select("row.*")
