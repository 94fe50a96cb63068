"""Near-duplicate documents by chosen-path set similarity join.

Each document is the set of its k-word shingles. Equal sets are one class from the start (grouped by a 128-bit
digest of the set and its size). A class has `coordinates` minwise tokens, from which trees choose their paths, and
a sketch to compare by: for each of 512 equal ranges of the hash space two bits, 0 if no shingle is in it, else 1
to 3 by the least one (128 bytes).

The root of the forest branches into `trees` independent trees: a class goes to the node of each tree's own minwise
token. A node is then treated by its size. At most `leaf` classes are compared exhaustively inside one task. A larger
node branches: by size bands the first time (a class goes to its own band and the next, so any two whose sizes allow
the threshold still meet), and each time on two further tokens chosen by the node's path. Two classes of similarity
s share a node of one tree with probability s if nodes there are leaves; with nodes that branch j times the
chance is the survival chance of a branching process of 2 s children on average, 2/3 at least for s = 0.75 at
any depth. With 12 trees a link at s = 0.75 is missed with a probability of 6e-8 where nodes are leaves and of
2e-6 where they branch without end; more similar ones less often. A component is found by any of its links that
connect it. A node still larger than `leaf` after `depth` branchings is compared in blocks, a task for each two.

Groups of copies don't grow into pairs:
* every class is first compared with one hub, the least class of the node that most of its trees name, so a group
  of near copies of any size costs a comparison for each member; nodes of one component have nothing left to find;
* a leaf proposes all pairs of different components that may be links only while they are few (at most twice
  its classes); else a spanning forest of them, the most similar first, and marks the others' classes as open;
* open classes go through the same trees once more with their whole texts, are compared on full sets in the leaf, and only
  links that connect two components leave it.

Two classes of a leaf may be a link if their sizes allow the threshold and their sketches do: the common elements
can be no more than the equal entries plus what each sketch hides (its set's size less its used ranges), which is
exact for small sets, and the share of equal entries must be no less than 4.9 standard deviations (of a sample
without replacement) below the threshold, which a pair at the threshold fails once in about a million.
Sketches only propose; a link needs 100 * |A & B| >= 100 * threshold * |A | B| on full shingle sets, counted from
whole texts. Components of links are found by alternating star contraction, run until nothing changes.

Defined results: ids may be of any type that has an order and keep it; a null or wordless text has no shingles and no
link; a null id keeps its row, has component_id null unless its text equals or links to one with an id, and is
kept only where that is null; repeated rows each come out, with the same values; very long texts count whole (a task's
memory follows the longest one); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm import textkernel as tk
from ratelens.llm.keys import row_key, type_of
from ratelens.sources.tables import cut, drop

#: Keys of rows (16 bytes each) are broadcast to filter texts only up to this many; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000

#: Words of the whole texts that a leaf may hold.
LEAF_WORDS = 4_000_000

RANGES = 512
COORDINATES = 24

_SEEDS = np.random.default_rng(75).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, keys, sketch = [], [], [], [], []
            for _, _, data, offsets in tk.chunks(batch.column("text")):
                for s in tk.shingle_sets(tk.words(data, offsets, tk.SPACE), k):
                    n.append(len(s))
                    d1.append(s.sum(dtype=np.uint64))
                    d2.append(tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    keys.append(_minima(s))
                    sketch.append(_range_sketch(s))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(flat))
            new = [pa.array(np.array(n, dtype=np.int64)), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (d1, d2)), lists, pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *new], names=["doc_id", "k1", "k2", "n", "d1", "d2", "keys", "sketch"])

    return run


def _minima(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate: the least value of its hash function over the set."""
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        h = (s[at : at + 4096, None] + _SEEDS[0]) * _SEEDS[1]
        h ^= h >> np.uint64(29)
        np.minimum(low, h.min(axis=0), out=low)
    return low


_STARTS = np.arange(RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)


def _range_sketch(s: np.ndarray) -> bytes:
    """Two bits for each range, as a plane of low bits and one of high bits. s is sorted."""
    shift = np.uint64(64 - RANGES.bit_length() + 1)
    at = np.searchsorted(s, _STARTS)
    least = s[np.minimum(at, len(s) - 1)] if len(s) else np.zeros(RANGES, dtype=np.uint64)
    full = (at < len(s)) & (least >> shift == np.arange(RANGES, dtype=np.uint64))
    value = np.where(full, 1 + (least & np.uint64(0xFFFFFFFF)) % np.uint64(3), 0).astype(np.uint8)
    return np.packbits(np.concatenate([value & 1, value >> 1])).tobytes()


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 10_000 * both >= percent * (len(x) + len(y) - both)


def _verified(k: int, threshold: float):
    percent = round(threshold * 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for at in range(0, len(a), 256):
                left, right = ([s for _, _, d, o in tk.chunks(batch.column(c).slice(at, 256)) for s in tk.shingle_sets(tk.words(d, o, tk.SPACE), k)] for c in ("ta", "tb"))
                keep[at : at + 256] = [_is_link(x, y, percent) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _candidates(n: np.ndarray, comp: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimated similarity) of the pairs of different components that may be links. Rows are sorted by n."""
    low, high = sketch[:, : sketch.shape[1] // 2], sketch[:, sketch.shape[1] // 2 :]
    full = low | high
    hidden = n - np.bitwise_count(full).sum(axis=1, dtype=np.int64)
    end = np.searchsorted(n, n / threshold + 1e-6, side="right")
    found = []
    for first in range(0, len(n), 64):
        last = min(first + 64, len(n))
        reach = int(end[last - 1])
        i, j = np.nonzero((np.arange(first, last)[:, None] < np.arange(first, reach)) & (np.arange(first, reach) < end[first:last, None]) & (comp[first:last, None] != comp[first:reach]))
        i, j = i + first, j + first
        for at in range(0, len(i), 16384):
            x, y = i[at : at + 16384], j[at : at + 16384]
            same = ~((low[x] ^ low[y]) | (high[x] ^ high[y])) & full[x]
            equal = np.bitwise_count(same).sum(axis=1, dtype=np.int64)
            union = np.bitwise_count(full[x] | full[y]).sum(axis=1, dtype=np.int64)
            both = np.bitwise_count(full[x] & full[y]).sum(axis=1, dtype=np.int64)
            most = equal + hidden[x] + hidden[y]
            # The ranges sample the union without replacement: what they leave out bounds the error. Where the
            # least shingles of a range differ, the entries are equal by chance once in three times.
            left_out = np.maximum(0.0, 1 - union * (1 + threshold) / (n[x] + n[y]))
            chance = np.maximum(0.0, both - threshold * union)
            least = threshold * union + chance / 3 - 4.9 * np.sqrt(threshold * (1 - threshold) * union * left_out * 4 / 9 + chance * 2 / 9) - 1e-9
            ok = (most >= threshold * (n[x] + n[y] - most)) & (equal >= least)
            found.append((x[ok], y[ok], ((equal - both / 3) / np.maximum(1, union))[ok]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class _Forest:
    """Union of component numbers 0 to n - 1."""

    def __init__(self, n: int):
        self.parent, self.left = list(range(n)), n

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def apart(self, x: int, y: int) -> bool:
        return self.root(x) != self.root(y)

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)
        self.left -= 1


def _proposals(rows: dict[str, np.ndarray], threshold: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of a leaf to be verified, and the classes of pairs that it holds back."""
    uid, comp = rows["uid"], np.unique(rows["comp"], return_inverse=True)[1]
    x, y, alike = _candidates(rows["n"], comp, rows["sketch"], threshold)
    if len(x) <= 2 * len(uid):
        return list(zip(uid[x].tolist(), uid[y].tolist())), np.zeros(0, dtype=np.int64)
    taken = np.zeros(len(x), dtype=bool)
    forest, order = _Forest(int(comp.max()) + 1), np.argsort(-alike, kind="stable")
    for at, i, j in zip(order.tolist(), comp[x[order]].tolist(), comp[y[order]].tolist()):
        if forest.apart(i, j):
            forest.join(i, j)
            taken[at] = True
            if forest.left == 1:
                break
    back = np.unique(uid[np.concatenate([x[~taken], y[~taken]])])
    return list(zip(uid[x[taken]].tolist(), uid[y[taken]].tolist())), back


def _links_within(rows: dict[str, np.ndarray], k: int, threshold: float) -> list[tuple[int, int]]:
    """Links of a leaf that connect its components, counted on full sets."""
    percent, sets = round(threshold * 10_000), {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = next(s for _, _, d, o in tk.chunks(pa.array([rows["text"][i]], pa.string())) for s in tk.shingle_sets(tk.words(d, o, tk.SPACE), k))
        return sets[i]

    comp = np.unique(rows["comp"], return_inverse=True)[1]
    x, y, alike = _candidates(rows["n"], comp, rows["sketch"], threshold)
    forest, out, order = _Forest(int(comp.max()) + 1), [], np.argsort(-alike, kind="stable")
    uid, comp = rows["uid"].tolist(), comp.tolist()
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        if forest.apart(comp[i], comp[j]) and _is_link(shingles(i), shingles(j), percent):
            forest.join(comp[i], comp[j])
            out.append((uid[i], uid[j]))
            if forest.left == 1:
                break
    return out


def _compared(k: int, threshold: float, exact: bool):
    """Rows arrive sorted by node, in bounded nodes; pairs (a, b), and (a, null) for a class that pairs are held back of."""

    def of(rows: dict[str, np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
        if len(rows["uid"]) < 2 or rows["comp"].min() == rows["comp"].max():
            return [], np.zeros(0, dtype=np.int64)
        order = np.lexsort((rows["uid"], rows["n"]))
        rows = {c: v[order] for c, v in rows.items()}
        return (_links_within(rows, k, threshold), np.zeros(0, dtype=np.int64)) if exact else _proposals(rows, threshold)

    def batch_of(found: list[tuple[list[tuple[int, int]], np.ndarray]]) -> pa.RecordBatch:
        pairs = np.array([p for f, _ in found for p in f], dtype=np.int64).reshape(-1, 2)
        back = np.unique(np.concatenate([b for _, b in found])) if found else np.zeros(0, dtype=np.int64)
        a, b = np.concatenate([pairs.min(axis=1, initial=2**63 - 1), back]), np.concatenate([pairs.max(axis=1, initial=-(2**63)), back])
        empty = np.concatenate([np.zeros(len(pairs), bool), np.ones(len(back), bool)])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=empty)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in ("path", "uid", "comp", "n")}
            rows["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            if exact:
                rows["text"] = batch.column("text").to_numpy(zero_copy_only=False)
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            cuts = np.flatnonzero(np.diff(rows["path"])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            found = [of({c: v[s:e] for c, v in rows.items()}) for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            held = {c: v[last:] for c, v in rows.items()}
            yield batch_of(found)
        if held is not None:
            yield batch_of([of(held)])

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable by edges (a, b), for every id of an edge.

    Alternating large-star and small-star steps; each is a min by node (combined map-side) and an equi-join,
    both on plain exchanges, so a hub with very many neighbours is split by skew handling. The passes end when
    the edges are stars: every node has one edge, to a node that has none.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "cc-large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "cc-low")
        joined = large.join(low.where("c > 1").select("u", "m"), "u")
        old, e = e, cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        done = low.where("c > 1").isEmpty() and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        drop(old, large, low)
        if done:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.75, trees: int = 12, leaf: int = 4096, depth: int = 8) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    return _judged(docs, id_col, text_col, shingle, threshold, trees, leaf, depth).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.75, trees: int = 12, leaf: int = 4096, depth: int = 8) -> DataFrame:
    """near_duplicates with the row key of id and text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = base.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k"), "text").select("doc_id", "k.k1", "k.k2", "text")
    kind = type_of(base, "doc_id")
    sketched = cut(keyed.mapInArrow(_sketches(shingle), f"doc_id {kind}, k1 long, k2 long, n long, d1 long, d2 long, keys array<long>, sketch binary"), "nd-sketch")
    rows = cut(sketched.drop("keys", "sketch"), "nd-row")
    # A class is named by a number that is written with it, so it is unique and stays the same for every reader.
    classes = sketched.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("k1", "k2")).alias("k"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("uid"), "d1", "d2", "n", "first_id", "k.k1", "k.k2", "keys", "sketch"), "nd-class")
    drop(sketched)

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """(uid, text) of some classes, written: one row's text speaks for its class."""
        wanted = cut(classes.select("uid", "k1", "k2").join(ids, "uid", "left_semi"), f"{name}-key")
        small = wanted.count() <= BROADCAST_IDS
        texts = keyed.select("k1", "k2", "text").join(F.broadcast(wanted) if small else wanted, ["k1", "k2"])
        texts = cut(texts.groupBy("uid").agg(F.first("text").alias("text")), f"{name}-text")
        drop(wanted)
        return texts

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) of classes that pass on full sets."""
        texts = texts_of(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), name)
        left = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
        both = left.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
        found = cut(both.select("a", "b", "ta", "tb").mapInArrow(_verified(shingle, threshold), "a long, b long"), f"{name}-link")
        drop(texts)
        return found

    # The root branches: a node for each minwise token of each tree's coordinate that two classes share.
    paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.get("keys", t)))
    at = classes.select("uid", "n", F.explode(paths).alias("path"))
    nodes = cut(at.groupBy("path").agg(F.count("*").alias("c"), F.min("uid").alias("hub")).where("c > 1"), "nd-node")
    members = cut(at.join(nodes.select("path", "hub"), "path"), "nd-member")
    drop(nodes)

    # Hubs: each class against the least class of the nodes that most of its trees lead to.
    votes = members.where("hub < uid").groupBy("uid").agg(F.collect_list("hub").alias("hubs"))
    best = F.array_max(F.transform(F.array_distinct("hubs"), lambda h: F.struct(F.size(F.filter("hubs", lambda x: x == h)).alias("votes"), (-h).alias("hub"))))
    stars = votes.select(F.col("uid").alias("a"), best.alias("best")).where(F.col("best.votes") >= max(1, trees // 4))
    stars = cut(stars.select("a", (-F.col("best.hub")).alias("b")), "nd-star")
    edges = links(stars, "nd-star")
    drop(stars)
    comps = cut(connected_components(edges), "nd-comp")

    width = -math.log(threshold) * (1 + 1e-9)

    def with_class(light: DataFrame, *columns: str) -> DataFrame:
        """Members with columns of their classes, which are fetched once for a class and not once for a node."""
        places = light.groupBy("uid").agg(F.first("comp").alias("comp"), F.collect_list("path").alias("paths"))
        return places.join(classes.select("uid", "n", "sketch", *columns), "uid").select(F.explode("paths").alias("path"), "uid", "comp", "n", "sketch", *columns)

    def in_mixed_nodes(at: DataFrame, name: str) -> DataFrame:
        """Members of nodes that hold several components, with the node's size c and its largest set."""
        nodes = at.groupBy("path").agg(F.count("*").alias("c"), F.max("n").alias("widest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        nodes = cut(nodes.where("c > 1 and lo <> hi").select("path", "c", "widest"), f"{name}-node")
        out = cut(at.join(nodes, "path"), name)
        drop(nodes)
        return out

    def search(members: DataFrame, texts: DataFrame | None) -> list[DataFrame]:
        """Run the trees below the root over some members; tables of pairs (a, b) or (a, null) as the leaves give them."""
        extra = [] if texts is None else ["text"]
        # With whole texts a leaf is bounded by their words, too.
        most = F.lit(leaf) if texts is None else F.least(F.lit(leaf), F.ceil(F.lit(LEAF_WORDS) / F.col("widest")))

        def compared(rows: DataFrame) -> DataFrame:
            if texts is not None:
                places = rows.groupBy("uid").agg(*(F.first(c).alias(c) for c in ("comp", "n", "sketch")), F.collect_list("path").alias("paths"))
                rows = places.join(texts, "uid").select(F.explode("paths").alias("path"), "uid", "comp", "n", "sketch", "text")
            sorted_ = rows.select("path", "uid", "comp", "n", "sketch", *extra).repartition("path").sortWithinPartitions("path")
            return cut(sorted_.mapInArrow(_compared(shingle, threshold, texts is not None), "a long, b long"), "nd-found")

        found = [compared(with_class(members.where(F.col("c") <= most).drop("n")))]
        large, nodes = members.where(F.col("c") > most), None
        if large.isEmpty():
            return found
        large = with_class(large.drop("n"), "keys")
        large = large.withColumn("own", F.floor(F.log("n") / width).cast("int")).select("*", F.explode(F.array("own", F.col("own") + 1)).alias("band")).withColumn("path", F.xxhash64("path", "band")).drop("own", "band")
        for level in range(depth):
            # Two different coordinates of the node's own choice.
            first = F.pmod(F.xxhash64("path"), F.lit(COORDINATES)).cast("int")
            second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit("second")), F.lit(COORDINATES - 1)).cast("int"), F.lit(COORDINATES))
            step = large.select("path", "uid", "comp", "n", "sketch", "keys", F.explode(F.array(first, second)).alias("coordinate"))
            step = cut(step.withColumn("path", F.xxhash64("path", "coordinate", F.element_at("keys", F.col("coordinate") + 1))).drop("coordinate"), "nd-branch")
            drop(*[nodes] if nodes is not None else [])
            nodes = in_mixed_nodes(step, "nd-level")
            drop(step)
            found.append(compared(nodes.where(F.col("c") <= most)))
            large = nodes.where(F.col("c") > most)
            if large.isEmpty():
                break
        else:
            blocks = F.ceil(F.col("c") / F.greatest(F.lit(1), F.floor(most / 2))).cast("int")
            rest = large.withColumn("mine", F.pmod(F.xxhash64("uid", "path"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            found.append(compared(rest.withColumn("path", F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")))))
        drop(nodes)
        return found

    def joined_to(members: DataFrame, comps: DataFrame) -> DataFrame:
        return members.select("uid", "n", "path").join(comps.select(F.col("id").alias("uid"), "comp"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))

    mixed = in_mixed_nodes(joined_to(members, comps), "nd-mixed")
    tables = search(mixed, None)
    drop(mixed)
    found = reduce(DataFrame.union, tables)
    pairs = cut(found.where("b is not null").distinct(), "nd-pair")
    open_ = cut(found.where("b is null").select(F.col("a").alias("uid")).distinct(), "nd-open")
    drop(*tables)
    edges = edges.union(links(pairs, "nd-pair"))
    if not open_.isEmpty():
        mixed = in_mixed_nodes(joined_to(members.join(open_, "uid", "left_semi"), connected_components(edges)), "nd-mixed")
        texts = texts_of(open_, "nd-open")
        edges = reduce(DataFrame.union, search(mixed, texts), edges)
        drop(mixed, texts)
    drop(members, open_, pairs)

    labelled = classes.select("uid", "d1", "d2", "n", "first_id").join(connected_components(edges).withColumnRenamed("id", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    labelled = cut(labelled.drop("uid"), "nd-label")
    lowest = labelled.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    label = cut(labelled.join(lowest, "comp").select("d1", "d2", "n", "component_id"), "nd-class-id")
    drop(classes, labelled)
    alone = rows.where("n = 0").select("doc_id", "k1", "k2", "n", F.col("doc_id").alias("component_id"))
    linked = rows.where("n > 0").select("doc_id", "k1", "k2", "d1", "d2", "n").join(label, ["d1", "d2", "n"]).select("doc_id", "k1", "k2", "n", "component_id")
    return linked.union(alone).select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with one of each near-duplicate component left, all columns as they came.

    Of repeated rows with one id one stays; rows without an id stay once for each text, if not linked to a row with one.
    Only the exceptions meet the documents: keys of rows that go, and of those that stay once though they repeat.
    """
    judged = cut(_judged(docs, id_col, text_col, **settings).select("doc_id", "k1", "k2", "kept"), "nd-judged")
    nameless = F.when(F.col("doc_id").isNull(), F.struct("k1", "k2"))
    chosen = judged.where("kept").groupBy("doc_id", nameless.alias("nameless")).agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2", F.lit(True).alias("stays"))
    rows = judged.groupBy("k1", "k2").agg(F.count("*").alias("rows"))
    odd = rows.join(chosen, ["k1", "k2"], "left").where("stays is null or rows > 1")
    odd = cut(odd.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "stays"), "nd-odd")
    drop(judged)
    key = row_key(F.col(id_col), F.col(text_col).cast("string"))
    meets = (key["k1"] == F.col("__k1")) & (key["k2"] == F.col("__k2"))
    small = odd.count() <= BROADCAST_IDS
    single = docs.join(F.broadcast(odd) if small else odd, meets, "left_anti")
    repeated = odd.where("stays")
    if repeated.isEmpty():
        return single
    several = docs.join(F.broadcast(repeated) if small else repeated, meets, "left_semi")
    once = several.withColumns({"__k1": key["k1"], "__k2": key["k2"]}).dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
    return single.unionByName(once)
