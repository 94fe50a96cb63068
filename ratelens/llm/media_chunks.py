"""Media columns: content-defined chunks, deduplicated by digest, and verified reconstruction.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of 64, stored as 8-bit samples.
A rolling gear hash over the last 32 bytes cuts it into chunks (at least 256 bytes, 1 kB or so on average, at
most 8 kB), so equal passages give equal chunks wherever they stand. Chunks are named by digest. Spark counts
the digests; the store then has two tables:

* chunks: digest and bytes of each chunk that occurs more than once, stored once;
* media: a row for each document: its header (sizes and ordered chunk list), the bytes of its other chunks, and
  references to the chunk table.

Which chunks occur more than once goes to the tasks as a bitmap of at most `MOST_BITS` bits over digests, whatever the
input. A chunk that only shares its bit with one goes to the chunk table, too: as the bitmap fills the store becomes a
plain chunk table, and nothing is lost. Texts are read by three map-only passes (names, media rows, shared chunks).
What is shuffled is digests and the bytes of shared chunks, combined within each task, never whole texts.

Reading back starts from the written tables. Documents without references are read where they are. For the
others the chunk table is joined by digest, once for each distinct chunk list, so copies of a text cost a row of
results each and not their bytes. Every chunk is checked against its digest and every payload against its list.

The stored form of one document, of which media_bytes and media_sha256 speak, is its stored header followed by the
samples in order, all as read; it depends on the text alone.

Defined results: null text is the empty payload of 64 zero bytes; repeated rows each get a row with the same
values; ids may be of any type and keep it, null included; very long texts are whole (a task holds one at a time,
besides a batch of rows); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm import textkernel as tk
from ratelens.llm.keys import type_of
from ratelens.sources.tables import cut, drop

BLOCK = 64
LEAST, MOST, BITS = 256, 8192, 10
MOST_BITS = 1 << 27
MAGIC = b"CDC8"

_GEAR = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 32 of gear[data[i - k]] << k, by doubling the window."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each text the ends of its chunks, relative to its start."""
    ends = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1 if len(data) else np.zeros(0, dtype=np.int64)
    at = np.searchsorted(ends, offsets)
    for i in range(len(offsets) - 1):
        size = int(offsets[i + 1] - offsets[i])
        mine = (ends[at[i] : at[i + 1]] - offsets[i]).tolist()
        out, start = [], 0
        while size - start > LEAST:
            j = bisect_left(mine, start + LEAST)
            start = min(size, start + MOST, mine[j] if j < len(mine) else size)
            out.append(start)
        if not out or out[-1] < size:
            out.append(size)
        yield out


def _chunks_of(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(bytes of the text, chunks of the padded payload) of each row."""
    for _, _, data, offsets in tk.chunks(column):
        raw = data.tobytes()
        for i, ends in enumerate(cut_points(data, offsets)):
            text = raw[offsets[i] : offsets[i + 1]]
            pad = bytes(-len(text) % BLOCK if text else BLOCK)
            parts = [text[a:b] for a, b in zip([0, *ends], ends)]
            parts[-1] += pad
            yield len(text), parts


def _digest(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def _longs(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two 64-bit integers."""
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


_ENTRY = np.dtype([("size", "<u4"), ("digest", "V16")])


def _header(n_bytes: int, parts: list[bytes], digests: list[bytes]) -> bytes:
    body = b"".join(struct.pack("<I", len(p)) + d for p, d in zip(parts, digests))
    return MAGIC + struct.pack("<QQI", n_bytes, sum(map(len, parts)), len(parts)) + body


def _parsed(header: bytes) -> tuple[int, int, list[int], list[bytes]]:
    """(bytes of the text, bytes of the payload, sizes, digests)."""
    n_bytes, payload, n = struct.unpack_from("<QQI", header, len(MAGIC))
    entries = np.frombuffer(header, dtype=_ENTRY, count=n, offset=len(MAGIC) + 20)
    return n_bytes, payload, entries["size"].tolist(), [d.tobytes() for d in entries["digest"]]


def _digest_lists(per_row: list[list[bytes]]) -> pa.Array:
    flat = _longs([d for ds in per_row for d in ds])
    offsets = pa.array(np.cumsum([0, *map(len, per_row)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["d1", "d2"]))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_digest_lists([[_digest(c) for c in parts] for _, parts in _chunks_of(batch.column("text"))])], names=["digests"])


def _in(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names & (8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _media_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, own, lists, refs, offsets = [], [], [], [], [0]
            for size, parts in _chunks_of(batch.column("text")):
                digests = [_digest(c) for c in parts]
                headers.append(_header(size, parts, digests))
                lists.append(_digest(headers[-1]))
                names = _longs(digests)
                away = _in(shared.value, names[:, 0])
                own.append(b"".join(c for c, x in zip(parts, away) if not x))
                ords = np.flatnonzero(away)
                refs.append(np.column_stack([ords, names[ords]]))
                offsets.append(offsets[-1] + len(ords))
            flat, list_ = np.concatenate(refs) if refs else np.zeros((0, 3), dtype=np.int64), _longs(lists)
            entries = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1]), pa.array(flat[:, 2])], ["ord", "d1", "d2"])
            columns = [batch.column("doc_id"), pa.array(list_[:, 0]), pa.array(list_[:, 1]), pa.array(headers, pa.binary()), pa.array(own, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "l1", "l2", "header", "own", "refs"])

    return run


def _shared_chunks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [c for _, parts in _chunks_of(batch.column("text")) for c in parts]
            names = _longs([_digest(c) for c in chunks])
            at = np.flatnonzero(_in(shared.value, names[:, 0]))
            at = at[np.unique(names[at], axis=0, return_index=True)[1]] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(names[at, 0]), pa.array(names[at, 1]), pa.array([chunks[i] for i in at], pa.binary())], names=["d1", "d2", "chunk"])

    return run


@dataclass
class Store:
    """The two written tables."""

    media: DataFrame
    chunks: DataFrame


def _bitmap(names: DataFrame, most: int) -> np.ndarray:
    """Bits of the names (column d1), by name modulo their number: a fixed-size summary, put together from buckets of 4 kB."""
    bits = 1 << 16
    while bits < min(most, 64 * names.count()):
        bits *= 2
    at = F.col("d1").bitwiseAND(F.lit(bits - 1)) + 1
    buckets = names.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in buckets.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> Store:
    """Write the media table and the chunk table; the result reads them."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = base.select("text").mapInArrow(_named, "digests array<struct<d1: long, d2: long>>")
    counts = named.select(F.explode("digests").alias("d")).groupBy("d.d1", "d.d2").agg(F.count("*").alias("c"))
    names = cut(counts.where("c > 1").select("d1"), "mc-name")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(names, most_bits))
    drop(names)
    kind = type_of(base, "doc_id")
    media = base.mapInArrow(_media_rows(shared), f"doc_id {kind}, l1 long, l2 long, header binary, own binary, refs array<struct<ord: int, d1: long, d2: long>>")
    chunks = base.select("text").mapInArrow(_shared_chunks(shared), "d1 long, d2 long, chunk binary").groupBy("d1", "d2").agg(F.first("chunk").alias("chunk"))
    return Store(cut(media, "mc-media"), cut(chunks, "mc-chunk"))


_RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, chunks long, shared_chunks long"


def _described(header: bytes, own: bytes, brought: dict[int, bytes]) -> tuple:
    n_bytes, size, sizes, digests = _parsed(header)
    parts, at = [], 0
    for j, length in enumerate(sizes):
        if j in brought:
            parts.append(brought[j])
        else:
            parts.append(own[at : at + length])
            at += length
        if len(parts[-1]) != length or _digest(parts[-1]) != digests[j]:
            raise ValueError(f"chunk {j} of a document differs from its digest")
    payload = b"".join(parts)
    if len(payload) != size:
        raise ValueError("a payload differs from its chunk list")
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    feature = f"n={size};sum={int(samples.sum())};energy={int((samples * samples).sum())};peak={int(samples.max())};steps={int(np.count_nonzero(samples[1:] != samples[:-1]))};chunks={len(sizes)}"
    whole = sha256(header)
    whole.update(payload)
    return n_bytes, size, sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(header) + size, whole.hexdigest(), feature, len(sizes), len(brought)


def _read_rows(keys: list[str], fetched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                brought = {f["ord"]: f["chunk"] for f in batch.column("fetched")[i].as_py()} if fetched else {}
                rows.append(_described(batch.column("header")[i].as_py(), batch.column("own")[i].as_py(), brought))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keys, *(f.split()[0] for f in _RESULT.split(", "))])

    return run


def read_back(stored: Store) -> DataFrame:
    """Every document of a store, reassembled from its chunk list, checked and described."""
    media = stored.media
    kind = type_of(media, "doc_id")
    whole = media.where("size(refs) = 0").select("doc_id", "header", "own").mapInArrow(_read_rows(["doc_id"], False), f"doc_id {kind}, {_RESULT}")
    # A list that occurs more than once has only shared chunks, so its rows hold no bytes of their own.
    split = media.where("size(refs) > 0")
    only = split.where("length(own) > 0").select("l1", "l2", "header", "own", "refs")
    same = split.where("length(own) = 0").groupBy("l1", "l2").agg(F.first("header").alias("header"), F.first("own").alias("own"), F.first("refs").alias("refs"))
    lists = only.union(same)
    wanted = lists.select("l1", "l2", F.inline("refs"))
    brought = wanted.join(stored.chunks, ["d1", "d2"]).groupBy("l1", "l2").agg(F.collect_list(F.struct("ord", "chunk")).alias("fetched"))
    read = lists.drop("refs").join(brought, ["l1", "l2"]).mapInArrow(_read_rows(["l1", "l2"], True), f"l1 long, l2 long, {_RESULT}")
    referring = split.select("doc_id", "l1", "l2").join(cut(read, "mc-read"), ["l1", "l2"]).drop("l1", "l2")
    return whole.union(referring)
