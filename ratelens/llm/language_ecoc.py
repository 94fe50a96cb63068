"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits. One binary linear classifier on hashed character 2- and 3-grams
for each bit predicts on which side of that bit's split of the languages a text lies. Decoding is
loss-weighted: a codeword's cost is the sum, over bits, of the bit's reliability (its margin-free accuracy on
the training rows, as log odds) times the logistic loss of the classifier's output against the codeword's bit;
the cheapest codeword wins. The score is its share under a softmax of negative costs; a text is ambiguous if the
second codeword costs at most `margin` of the cost's scale more.

Training takes at most `per_language` rows of each language (parameter, 600), the lowest by a hash of the id,
and at most `bound` in all (3000): where that is too few, all languages are cut to the same number of rows, so
that rare ones keep theirs. It sees text and language only. Whole texts are read, once, without a shuffle.

Defined results: a text that is null or has no letter is `und` with score 0; with no labelled rows all texts are
`und`; with one language every text with a letter has it, with score 1; languages equally cheap go to the lower
name; repeated rows each get a row and train once; ids may be of any type and keep it, null included; very long texts are read
whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm import textkernel as tk
from ratelens.llm.keys import type_of
from ratelens.llm.sampling import remainder

BITS = 12
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the two-byte Latin letters of U+00C0 to U+00DE; digits and symbols to blanks."""
    low = tk.LOWER[data]
    latin = np.zeros(len(low), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = low + latin.astype(np.uint8) * np.uint8(32)
    return np.where((low < 97) | ((low > 122) & (low < 128)), np.uint8(32), low)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x 2**BITS: square roots of hashed 2- and 3-gram counts, scaled to unit length."""
    n, width = len(offsets) - 1, 1 << BITS
    low = _folded(data).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * width, dtype=np.float32)
    for k in (2, 3):
        if len(low) < k:
            continue
        m = len(low) - k + 1
        h = np.full(m, k, dtype=np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) ^ low[j : j + m]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - BITS)
        same = doc[:m] == doc[k - 1 :]
        # A run of blanks says nothing about the language.
        same &= (low[:m] != 32) | (low[1 : m + 1] != 32)
        out += np.bincount(doc[:m][same] * width + h[same], minlength=n * width).astype(np.float32)
    out = np.sqrt(out.reshape(n, width))
    return out / np.maximum(1e-9, np.sqrt((out * out).sum(axis=1, keepdims=True)))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n x bits of -1 and 1: all splits for up to 5 languages, else the random code with the largest least distance."""
    if n <= 5:
        splits = [s for s in range(1, 1 << max(0, n - 1))]
        rows = [[1 if (i < n - 1 and s >> i & 1) else -1 for s in splits] for i in range(n)]
        return np.array(rows, dtype=np.float64).reshape(n, -1)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        distance = (bits - code @ code.T) / 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


def train(x: np.ndarray, names: list[str], rounds: int = 250, rate: float = 4.0, decay: float = 1e-5) -> dict:
    """One logistic model for each bit, by gradient descent on the whole (bounded) sample with languages weighted equally."""
    langs = sorted(set(names))
    code = codewords(len(langs))
    of = np.array([langs.index(v) for v in names])
    y = code[of]
    share = 1 / np.bincount(of)[of] / len(langs)
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    speed = np.zeros_like(w)
    for _ in range(rounds):
        g = (-y / (1 + np.exp(y * (x @ w + b))) * share[:, None]).astype(np.float32)
        speed = 0.9 * speed - rate * (x.T @ g + decay * w)
        w += speed
        b -= rate * g.sum(axis=0)
    right = ((np.sign(x @ w + b) == y) * share[:, None]).sum(axis=0)
    right = np.clip(right, 0.5, 0.999)
    return {"langs": langs, "code": code, "w": w, "b": b, "weight": np.log(right / (1 - right)) + 1e-6}


def decode(model: dict, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest codeword, score, how much dearer the second is) for rows of bit outputs."""
    if len(model["langs"]) == 1:
        return np.zeros(len(f), dtype=np.int64), np.ones(len(f)), np.full(len(f), np.inf)
    weight = model["weight"] / model["weight"].sum() * f.shape[1]
    cost = np.stack([(weight * np.logaddexp(0, -c * f)).sum(axis=1) for c in model["code"]], axis=1)
    order = np.argsort(cost, axis=1, kind="stable")
    best, second = (np.take_along_axis(cost, order[:, i : i + 1], axis=1)[:, 0] for i in (0, 1))
    score = 1 / np.exp(best[:, None] - cost).sum(axis=1)
    return order[:, 0], score, second - best


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = np.diff(total[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _vectors():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in tk.chunks(batch.column("text"), 1 << 19):
                rows += [r.tobytes() for r in grams(data, offsets).astype(np.float16)] if has_letter(data, offsets).any() else [b""] * (len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])

    return run


def _predictions(shared, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score, unsure = [], [], []
            for _, _, data, offsets in tk.chunks(batch.column("text"), 1 << 19):
                known = has_letter(data, offsets) & bool(model["langs"])
                if not known.any():
                    lang += ["und"] * len(known)
                    score += [0.0] * len(known)
                    unsure += [True] * len(known)
                    continue
                best, p, gap = decode(model, grams(data, offsets) @ model["w"] + model["b"])
                lang += [model["langs"][i] if k else "und" for i, k in zip(best, known)]
                score += np.where(known, p, 0.0).tolist()
                unsure += (~known | (gap <= margin)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def rows_each(counts: list[int], per_language: int, bound: int) -> int:
    """The largest number of rows, up to per_language, that every language may have without more than bound in all."""
    return next((n for n in range(per_language, 1, -1) if sum(min(c, n) for c in counts) <= bound), 1)


def fit(docs: DataFrame, held_out: int = 1, modulus: int = 3, per_language: int = 600, bound: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model, from a bounded sample of the documents with a language outside the held-out fold."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("rows"), "lang").limit(bound).collect()
    if not sizes:
        return {"langs": []}
    each = rows_each([r["rows"] for r in sizes], per_language, bound)
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000))
    # Twice the rows needed, so that numbering them within a language sorts a small table.
    ceiling = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], int(min(1_000_000, 1 + 1_000_000 * (2 * each + 50) / r["ids"])))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    chosen = ids.where(draw < ceiling[F.col("lang")]).distinct().withColumn("place", place).where(F.col("place") <= each)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = texts.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    # One row for an id, however often it is repeated: what reaches the driver keeps the bound.
    found = rows.mapInArrow(_vectors(), f"doc_id {type_of(rows, 'doc_id')}, lang string, x binary").groupBy("doc_id", "lang").agg(F.max("x").alias("x")).toArrow()
    kept = sorted((i, lang, x) for i, lang, x in zip(found["doc_id"].to_pylist(), found["lang"].to_pylist(), found["x"].to_pylist()) if x)
    if not kept:
        return {"langs": []}
    x = np.stack([np.frombuffer(r[2], dtype=np.float16) for r in kept]).astype(np.float32)
    return train(x, [r[1] for r in kept])


def identify(docs: DataFrame, held_out: int = 1, modulus: int = 3, margin: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, held_out, modulus, id_col=id_col, text_col=text_col, lang_col=lang_col, **settings))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = base.mapInArrow(_predictions(shared, margin), f"doc_id {type_of(base, 'doc_id')}, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "lang_pred", "score", "ambiguous")
