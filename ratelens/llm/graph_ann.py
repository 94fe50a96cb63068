"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched by beams.

Vectors are dealt to shards by a hash, so every row is indexed. A shard holds about 32 * sqrt(rows) of them: shards and the
work of a query both grow with the square root of the table, and a shard fits in a task. In a shard, points are inserted in
batches: a greedy search over the graph so far proposes neighbours, and pruning keeps the nearest one and drops every other
that is closer to a kept one than to the point by the factor `alpha`, until `degree` diverse edges stay; reverse edges are
pruned alike. Searches run in lockstep over a batch of queries in numpy, several open beam entries at once.

Every query meets every shard: shards are sorted before their queries in one partition, so that a task holds one shard and one
batch of queries. Found points are scored again in double precision on their original vectors; each shard answers with its
best k, and the best k of all stay.

Equal vectors are one point. It keeps their k + 1 smallest ids, which is all that any answer of k can name, as ties go to the
smaller id: a vector that a third of all rows hold is one point, and its copies don't crowd the graph.

Defined results: rows without id take no part; vectors that are null, zero, or hold null, NaN or infinite components take no
part; an id on several rows counts once, with its greatest vector (rows of the query's id are its own); vectors of another
length than the query's are no candidates; fewer than k candidates are all returned; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.sources.tables import cut, drop

#: Queries that meet one copy of a shard; beyond, the shard is read by several tasks.
QUERY_BLOCK = 1 << 20
#: Bytes of the marks of seen points in one lockstep search.
SEEN_BYTES = 1 << 25

_INDEX = "shard int, node int, ids array<bigint>, vector array<double>, neighbours array<int>"


def shard_rows(rows: int, least: int = 1024, most: int = 1 << 20) -> int:
    return min(most, max(least, int(32 * rows**0.5)))


@dataclass
class Graph:
    """Unit vectors with at most `degree` out-edges each; -1 where there is none."""

    unit: np.ndarray
    edges: np.ndarray
    entry: int


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the last axis in double precision."""
    a, b = (x / 2.0 ** np.floor(np.log2(np.abs(x).max(axis=-1, keepdims=True))) for x in (a, b))  # by a power of two: no rounding
    return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def beam_search(graph: Graph, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, squared distances, points expanded on the way) of the beam of each query; -1 and inf where there is none."""
    rows, n, degree = len(queries), len(graph.unit), graph.edges.shape[1]
    seen = np.zeros((rows, n), dtype=bool)
    points = np.full((rows, beam), -1, dtype=np.int32)
    away = np.full((rows, beam), np.inf, dtype=np.float32)
    still = np.zeros((rows, beam), dtype=bool)
    points[:, 0], away[:, 0], still[:, 0], seen[:, graph.entry] = graph.entry, 2 - 2 * (queries @ graph.unit[graph.entry]), True, True
    width = min(width, beam)
    steps = []
    live = np.arange(rows)
    while True:
        ranked = np.where(still[live], away[live], np.inf)
        at = np.argpartition(ranked, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(live), 1))
        picked = np.take_along_axis(ranked, at, axis=1) < np.inf
        going = picked.any(axis=1)
        if not going.any():
            break
        live, at, picked = live[going], at[going], picked[going]
        side = live[:, None]
        still[side, at] = False
        here = np.where(picked, points[side, at], -1)
        step = np.full((rows, width), -1, dtype=np.int32)
        step[live] = here
        steps.append(step)
        near = np.where(picked[:, :, None], graph.edges[here], -1).reshape(len(live), width * degree)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[side, near]
        most = int(fresh.sum(axis=1).max())
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near, fresh = np.take_along_axis(near, order, axis=1), np.take_along_axis(fresh, order, axis=1)
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        gap = 2 - 2 * np.matmul(graph.unit[near], queries[live][:, :, None])[:, :, 0]
        gap[~fresh] = np.inf
        all_points = np.concatenate([points[live], near], axis=1)
        all_away = np.concatenate([away[live], gap], axis=1)
        all_still = np.concatenate([still[live], fresh], axis=1)
        best = np.argpartition(all_away, beam - 1, axis=1)[:, :beam]
        points[live], away[live], still[live] = (np.take_along_axis(x, best, axis=1) for x in (all_points, all_away, all_still))
    return np.where(np.isinf(away), -1, points), away, np.concatenate(steps, axis=1)


def robust_prune(unit: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point `at` the kept ones of its candidates (-1: none): nearest first, none much nearer to a kept one than to the point."""
    candidates = np.sort(np.where(candidates == at[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    away = 2 - 2 * np.matmul(unit[candidates], unit[at][:, :, None])[:, :, 0]
    away[candidates < 0] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(away, order, axis=1)
    used = max(1, int(np.isfinite(away).sum(axis=1).max()))
    candidates, away = candidates[:, :used], away[:, :used]
    vectors = unit[candidates]
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    kept = np.full((len(at), degree), -1, dtype=np.int32)
    rows = np.arange(len(at))
    for i in range(min(degree, used)):
        nearest = np.argmin(away, axis=1)
        has = np.isfinite(away[rows, nearest])
        if not has.any():
            break
        kept[has, i] = candidates[rows, nearest][has]
        away[(alpha * alpha * between[rows, nearest] <= away) & has[:, None]] = np.inf
        away[rows, nearest] = np.inf
    return kept


def build(vectors: np.ndarray, degree: int, beam: int, alpha: float) -> Graph:
    """The graph of a shard's vectors, the same for the same vectors in the same order."""
    unit = unit_vectors(vectors)
    n = len(unit)
    graph = Graph(unit, np.full((n, degree), -1, dtype=np.int32), int(np.argmax(unit @ unit.mean(axis=0))))
    most = max(1, min(256, SEEN_BYTES // n))
    order = np.random.default_rng(1).permutation(n)
    order = order[order != graph.entry]
    done = 0
    while done < len(order):
        batch = order[done : done + min(most, max(1, done))]
        done += len(batch)
        points, _, expanded = beam_search(graph, unit[batch], beam)
        graph.edges[batch] = robust_prune(unit, batch, np.concatenate([points, expanded, graph.edges[batch]], axis=1), degree, alpha)
        _add_reverse(graph, batch, degree, alpha)
    return graph


def _add_reverse(graph: Graph, batch: np.ndarray, degree: int, alpha: float) -> None:
    targets = graph.edges[batch]
    source, target = np.repeat(batch, degree), targets.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at, first, count = np.unique(target, return_index=True, return_counts=True)
    for some in np.array_split(np.arange(len(at)), max(1, len(at) // 256)):
        wide = int(count[some].max(initial=0))
        if not wide:
            continue
        spot = first[some][:, None] + np.arange(wide)
        added = np.where(np.arange(wide) < count[some][:, None], source[np.minimum(spot, len(source) - 1)], -1)
        both = np.concatenate([graph.edges[at[some]], added], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        room = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        graph.edges[at[some][~full]] = room[~full]
        if full.any():
            graph.edges[at[some][full]] = robust_prune(graph.unit, at[some][full], both[full], degree, alpha)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches with one value of a column that the rows are sorted by."""
    for batch in batches:
        values = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield int(values[a]), batch.slice(a, b - a)


def _builder(degree: int, beam: int, alpha: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def built(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        n = len(rows)
        graph = build(_matrix(rows["vector"].chunk(0), n), degree, beam, alpha)
        edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((graph.edges >= 0).sum(axis=1))]), pa.int32()), pa.array(graph.edges[graph.edges >= 0], pa.int32()))
        node = np.arange(n, dtype=np.int32)
        entry = np.where(node == graph.entry, 0, np.where(node < graph.entry, node + 1, node)).astype(np.int32)  # the entry is node 0
        names = pa.array(entry[edges.values.to_numpy()], pa.int32())
        out = pa.table({"shard": pa.array(np.full(n, shard, dtype=np.int32)), "node": pa.array(entry), "ids": rows["ids"], "vector": rows["vector"], "neighbours": pa.ListArray.from_arrays(edges.offsets, names)})
        yield from out.to_batches(max_chunksize=4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        current = None
        for shard, part in _runs(batches, "shard"):
            if shard != current and parts:
                yield from built(current, parts)
                parts = []
            current = shard
            parts.append(part)
        if parts:
            yield from built(current, parts)

    return run


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles) of the rows that take part, one for each id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(finite).where(F.exists("vector", lambda x: x != 0))
    return usable.groupBy("id").agg(F.max("vector").alias("vector"))


@dataclass
class Index:
    """nodes: a row for each point of each shard's graph; shards: (dim, shards, first) for each vector length."""

    nodes: DataFrame
    shards: DataFrame
    n_shards: int
    k: int

    def drop(self) -> None:
        drop(self.nodes, self.shards)


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, degree: int = 32, beam: int = 64, alpha: float = 1.2, rows_per_shard: int | None = None) -> Index:
    """The graphs of all vectors, written as a table; `k` is the most that a search may ask for."""
    keyed = _clean(df, id_col, vector_col).select("id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("second"), "vector").alias("k2"))
    first = keyed.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("place") <= k + 1)
    points = first.groupBy("k1", "k2").agg(F.min_by("vector", "place").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))
    points = cut(points.select("k1", "k2", "ids", "vector", F.size("vector").alias("dim")), "ann-points")
    counted = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}  # a row for each vector length
    spark, first_shard, rows = df.sparkSession, 0, []
    for dim in sorted(counted):
        shards = -(-counted[dim] // (rows_per_shard or shard_rows(counted[dim])))
        rows.append((dim, shards, first_shard))
        first_shard += shards
    shards = cut(spark.createDataFrame(rows, "dim int, shards int, first int"), "ann-shards")
    if not rows:
        return Index(cut(spark.createDataFrame([], _INDEX), "ann-nodes"), shards, 0, k)
    dealt = points.join(F.broadcast(shards), "dim").select((F.col("first") + F.pmod("k1", "shards")).cast("int").alias("shard"), "k1", "k2", "ids", "vector")
    placed = dealt.repartitionById(first_shard, F.col("shard")).sortWithinPartitions("shard", "k1", "k2").select("shard", "ids", "vector")
    nodes = cut(placed.mapInArrow(_builder(degree, beam, alpha), _INDEX), "ann-nodes")
    drop(points)
    return Index(nodes, shards, first_shard, k)


def _searcher(k: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def loaded(parts: list[pa.RecordBatch]) -> tuple[Graph, np.ndarray, list[list[int]]]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        n = len(rows)
        vectors = _matrix(rows["vector"].chunk(0), n)
        lists = rows["neighbours"].chunk(0)
        count = np.diff(lists.offsets.to_numpy())
        edges = np.full((n, max(1, int(count.max(initial=0)))), -1, dtype=np.int32)
        edges[np.arange(edges.shape[1]) < count[:, None]] = lists.flatten().to_numpy()
        return Graph(unit_vectors(vectors), edges, 0), vectors, rows["ids"].to_pylist()

    def answers(graph: Graph, vectors: np.ndarray, ids: list[list[int]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, names = _matrix(batch.column("vector"), len(batch)), batch.column("id").to_numpy()
        step = max(1, min(256, SEEN_BYTES // len(vectors)))
        wide = min(2 * (k + 1), beam)
        for a in range(0, len(asked), step):
            points, away, _ = beam_search(graph, unit_vectors(asked[a : a + step]), beam)
            near = np.take_along_axis(points, np.argsort(away, axis=1, kind="stable")[:, :wide], axis=1)
            score = cosine(asked[a : a + step][:, None, :], vectors[near])
            out = []
            for name, found, scores in zip(names[a : a + step].tolist(), near.tolist(), score.tolist()):
                best = sorted((-s, i) for p, s in zip(found, scores) if p >= 0 for i in ids[p] if i != name)
                out += [(name, i, -s) for s, i in best[:k]]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        ready = None
        last = None
        for batch in batches:
            for unit, same_unit in _runs(iter([batch]), "unit"):
                if unit != last:
                    parts, ready, last = [], None, unit
                for kind, rows in _runs(iter([same_unit]), "kind"):
                    if kind == 0:
                        parts.append(rows)
                    elif ready or parts:
                        if ready is None:
                            ready, parts = loaded(parts), []
                        yield from answers(*ready, rows)

    return run


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, beam: int = 160) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest k of all indexed vectors that beam searches of every shard found."""
    if k > index.k:
        raise ValueError(f"the index keeps ids for k up to {index.k}")
    asked = cut(_clean(queries, id_col, vector_col).withColumn("dim", F.size("vector")), "ann-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    unit = F.col("shard").cast("long") * blocks + F.col("block")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    everywhere = asked.join(F.broadcast(index.shards), "dim").select("id", "vector", block.alias("block"), F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard"))
    points = index.nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    points = points.select(unit.alias("unit"), F.lit(0).alias("kind"), F.col("node").cast("long").alias("id"), "ids", "vector", "neighbours")
    both = points.unionByName(everywhere.select(unit.alias("unit"), F.lit(1).alias("kind"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "vector", F.lit(None).cast("array<int>").alias("neighbours")))
    met = both.repartitionById(max(1, index.n_shards * blocks), F.col("unit").cast("int")).sortWithinPartitions("unit", "kind", "id")
    found = met.mapInArrow(_searcher(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **index: float) -> DataFrame:
    """The k nearest of every row whose id `every` divides, among all other rows."""
    return search(build_index(df, id_col, vector_col, k, **index), df.where(F.col(id_col) % every == 0), id_col, vector_col, k)
