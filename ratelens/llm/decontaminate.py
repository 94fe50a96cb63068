"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` consecutive words (an item with fewer words is one window). Each
window is a set of k-word shingles; the corpus frequency of every benchmark shingle is counted over all
documents, and shingles are ordered by rarity. A window is contained in a document only if its whole set is,
so the necessary prefix of a window is one token: its rarest shingle. Documents are joined with windows on
that token alone. A match fixes where the window would start; the positional bound (not before the document's
first word) and the length bound (not past its last) drop what cannot fit, and the rest is verified exactly
over the window's words.

The join is a map-side probe: the index of prefix tokens is broadcast in blocks of at most `block` windows,
counted before. A larger benchmark is probed block after block; between two blocks the documents are written with what was
found so far, so a task holds one block at a time. Document texts are never shuffled, whatever items or passages are frequent.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Defined results: null or
wordless texts have no words and no hits; an item without words or without id is ignored; repeated items and
windows count once for an item; ids of items and of documents may be of any type, items are named by their ids as text; repeated documents each get
a row; very long texts count whole; empty tables give no rows or no hits; other columns are ignored, whatever their names.
Words and windows are compared by 64-bit hashes of all their bytes: a false hit has a chance of about 2**-64 for each
pair of a document position and a window with the same prefix token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm import textkernel as tk
from ratelens.llm.keys import row_key, type_of
from ratelens.sources.tables import cut, drop

SHINGLE = 3
#: Windows in one broadcast block: 40 bytes each.
BLOCK = 1_000_000
#: Keys of documents to drop are broadcast only up to this many (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for first, _, data, offsets in tk.chunks(batch.column("text")):
                w = tk.words(data, offsets, tk.NOT_ALNUM)
                hashes = w.hashes()
                for i in range(len(w.ptr) - 1):
                    h = hashes[w.ptr[i] : w.ptr[i + 1]]
                    size = min(window, len(h))
                    k = min(SHINGLE, size)
                    if size:
                        whole, parts = tk.windows(h, size).view(np.int64), tk.windows(h, k).view(np.int64)
                        rows += [(batch.column("item_id")[first + i].as_py(), int(x), size, k, parts[at : at + size - k + 1].tolist()) for at, x in enumerate(whole)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "w", "size", "k", "parts"])

    return run


class _Members:
    """Which values of an array belong to a sorted set: a bitmap on the top bits first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values.astype(np.uint64))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, first index in values) of the members."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        i = np.searchsorted(self.values, h[at])
        ok = (i < len(self.values)) & (self.values[np.minimum(i, len(self.values) - 1)] == h[at])
        return at[ok], i[ok]


def _inside(w: tk.Words, k: int, at: np.ndarray) -> np.ndarray:
    """Which k-word windows at these word positions lie within one document."""
    end = w.ptr[np.searchsorted(w.ptr, at, side="right")]
    return at + k <= end


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = {k: _Members(v) for k, v in shared.value.items()}
        total = {k: np.zeros(len(m.values), dtype=np.int64) for k, m in members.items()}
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column("text")):
                w = tk.words(data, offsets, tk.NOT_ALNUM)
                hashes = w.hashes()
                for k, m in members.items():
                    at, i = m.find(tk.windows(hashes, k))
                    total[k] += np.bincount(i[_inside(w, k, at)], minlength=len(m.values))
        part, n = (np.concatenate(x) for x in zip(*[(members[k].values.view(np.int64)[t > 0], t[t > 0]) for k, t in total.items()]))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n)], names=["part", "n"])

    return run


def _probe(shared, first_pass: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {k: (_Members(v["part"]), v) for k, v in shared.value["windows"].items()}  # v is sorted by part
        names = shared.value["names"]
        for batch in batches:
            n_words, spans, items = [], [], []
            for first, end, data, offsets in tk.chunks(batch.column("text")):
                w = tk.words(data, offsets, tk.NOT_ALNUM)
                hashes = w.hashes()
                hit_start, hit_end, hit_item = [], [], []
                for k, (members, v) in index.items():
                    at, lo = members.find(tk.windows(hashes, k))
                    ok = _inside(w, k, at)
                    at, lo = at[ok], lo[ok]
                    many = np.searchsorted(members.values, members.values[lo], side="right") - lo
                    at, entry = np.repeat(at, many), np.repeat(lo, many) + _ramp(many)
                    start, size = at - v["offset"][entry], v["size"][entry]
                    doc = np.searchsorted(w.ptr, at, side="right") - 1
                    fits = (start >= w.ptr[doc]) & (start + size <= w.ptr[doc + 1])
                    start, size, entry = start[fits], size[fits], entry[fits]
                    same = np.zeros(len(start), dtype=bool)
                    for one in np.unique(size).tolist():
                        of = np.flatnonzero(size == one)
                        same[of] = tk.windows_at(hashes, start[of], one).view(np.int64) == v["w"][entry[of]]
                    hit_start.append(start[same])
                    hit_end.append(start[same] + size[same])
                    hit_item.append(v["item"][entry[same]])
                n_words += np.diff(w.ptr).tolist()
                s, e, it = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (hit_start, hit_end, hit_item))
                doc = np.searchsorted(w.ptr, s, side="right") - 1
                order = np.lexsort((e, s))
                s, e, it, doc = s[order], e[order], it[order], doc[order]
                cuts = np.searchsorted(doc, np.arange(end - first + 1))
                for i in range(end - first):
                    a, b = cuts[i], cuts[i + 1]
                    mine = np.stack([s[a:b], e[a:b]], axis=1) - w.ptr[i]
                    found = {names[x] for x in np.unique(it[a:b]).tolist()}
                    if not first_pass:
                        old = np.array(batch.column("spans")[first + i].as_py(), dtype=np.int64).reshape(-1, 2)
                        mine = np.concatenate([old, mine])
                        found.update(batch.column("items")[first + i].as_py())
                    spans.append(_merged(mine) if len(mine) else [])
                    items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return run


def _ramp(many: np.ndarray) -> np.ndarray:
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _merged(spans: np.ndarray) -> list[int]:
    """Disjoint [start, end, start, end, ...] that cover the same words."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.concatenate([[0], np.flatnonzero(spans[1:, 0] > reach[:-1]) + 1])
    tails = np.concatenate([heads[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[heads, 0], reach[tails]], axis=1).ravel().tolist()


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (word positions [start, end, ...] that are hit), items (their ids as text, sorted)."""
    return _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block).drop("text")


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block: int = BLOCK) -> DataFrame:
    context = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")
    schema = f"doc_id {type_of(base, 'doc_id')}, {_HITS}"
    found = cut(items.mapInArrow(_item_windows(window), "item_id string, w long, size int, k int, parts array<long>").distinct(), "bd-window")

    # Corpus frequency of every benchmark shingle, over all documents.
    parts = cut(found.select("k", F.explode("parts").alias("part")).distinct(), "bd-part")
    blocks = max(1, -(-parts.count() // block))
    counts = None
    for b in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("part"), F.lit(blocks)) == b).toPandas()
        if len(rows):
            shared = context.broadcast({int(k): g["part"].to_numpy().view(np.uint64) for k, g in rows.groupby("k")})
            here = base.select("text").mapInArrow(_counts(shared), "part long, n long")
            counts = here if counts is None else counts.union(here)
    if counts is None:
        drop(found, parts)
        return base.mapInArrow(_probe(context.broadcast({"windows": {}, "names": []}), True), schema)
    counts = counts.groupBy("part").agg(F.sum("n").alias("n"))

    # The necessary prefix of each window: its rarest shingle.
    placed = found.select("item_id", "w", "size", "k", F.posexplode("parts").alias("offset", "part")).join(counts, "part", "left")
    prefix = placed.groupBy("item_id", "w", "size", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part", "offset")).alias("rarest"))
    prefix = cut(prefix.where("rarest.n > 0").select("item_id", "w", "size", "k", "rarest.part", "rarest.offset"), "bd-prefix")
    drop(found, parts)
    blocks = max(1, -(-prefix.count() // block))
    out, first, written = base, True, []
    for b in range(blocks):
        if not first:
            out = cut(out, "bd-hits")
            drop(*written)
            written = [out]
        rows = prefix.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks)) == b).toPandas()
        rows = rows.assign(order=rows["part"].to_numpy().view(np.uint64)).sort_values("order", kind="stable")
        names = sorted(set(rows["item_id"]))
        rows = rows.assign(item=np.searchsorted(np.array(names, dtype=object), rows["item_id"].to_numpy(dtype=object)) if names else [])
        shared = context.broadcast({"names": names, "windows": {int(k): {c: g[c].to_numpy().astype(np.int64) for c in ("part", "offset", "size", "w", "item")} for k, g in rows.groupby("k")}})
        out = out.mapInArrow(_probe(shared, first), schema)
        first = False
    drop(prefix)
    return out


_HITS = "text string, n_words long, spans array<long>, items array<string>"


def summary(hits: DataFrame) -> DataFrame:
    """The digest of benchmark_hits: n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # ends minus starts, as signs alternate
    named = F.concat_ws(",", "items")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents in which no benchmark window occurs, all columns as they came."""
    key = row_key(F.col(id_col), F.col(text_col).cast("string"))
    hits = _hits(docs, benchmark, id_col, text_col, **settings)
    bad = hits.where(F.size("spans") > 0).select(row_key(F.col("doc_id"), F.col("text")).alias("k")).select(F.col("k.k1").alias("__k1"), F.col("k.k2").alias("__k2"))
    bad = cut(bad.distinct(), "bd-bad")
    small = bad.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if small else bad, (key["k1"] == F.col("__k1")) & (key["k2"] == F.col("__k2")), "left_anti")
