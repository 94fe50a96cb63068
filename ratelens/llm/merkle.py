"""Merkle manifest of a dataset: a tree of digests for each partition value, proofs for every row, and their check.

A row's leaf is the sha256 of its columns, each written with its length, so that no two rows share a spelling. Leaves get
places within their tree by a range sort over (tree, id): numbers within ranges plus the ranges' starts, no single task.

Bottom-up, each level is a table of its own: `fan` neighbours become one digest. Top-down, each level joins its parents by
place: a parent hands down the digests of its children and the proof it has inherited, and a child prepends its siblings to
it. A level is an eighth of the one below, so a join moves each leaf once and every proof once for eight leaves. Trees whose
level is a single node are done; their roots, ordered by tree, are the leaves of one more tree made the same way.

A proof is the siblings' digests in a row, so with a leaf's place and its tree's size it can be folded again from any leaf:
`folded_root` does so from the leaf of the row as it is read now.

Defined results: a null column counts as `-`; null is a tree of its own, before all others; null ids come first in their
tree; ties in the id (repeated rows) are ordered by leaf, so equal rows are neighbours, each with a place; a single row is
its own subroot and, without other trees, root, with an empty proof; an empty table gives no rows; very long texts count
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.sources.ranges import bounded, cut_numbered, sorted_ranges
from ratelens.sources.tables import cut, drop

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def spelled(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(spelled, values)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _levels(nodes: DataFrame, most: int, fan: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(parents' tables from the lowest on, (tree, subroot)) of nodes (tree, at, digest, n): n nodes in the tree, at most `most` in any.

    A parent is (tree, at, n, children, digest), n being the number of parents in its tree.
    """
    parents, roots = [], nodes.where("n = 1").select("tree", F.col("digest").alias("subroot"))
    while most > 1:
        most = -(-most // fan)
        grouped = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / fan).alias("at"))
        made = grouped.agg(F.ceil(F.first("n") / fan).cast("long").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda c: c["digest"]).alias("children"))
        nodes = cut(made.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{name}-{len(parents)}")
        parents.append(nodes)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.col("digest").alias("subroot")))
    return parents, roots


def _from_parents(child: DataFrame, parents: DataFrame, fan: int) -> DataFrame:
    """Each child (tree, at, ...) with its siblings before the proof that its parent (tree, at, children, proof, ...) has inherited."""
    above = parents.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), F.col("children").alias("__run"), F.col("proof").alias("__proof"), "subroot")
    joined = child.join(above, (F.col("tree") == F.col("__tree")) & (F.floor(F.col("at") / fan) == F.col("__at")))
    own = (F.col("at") % fan).cast("int")
    siblings = F.concat(F.array_join(F.slice("__run", F.lit(1), own), ""), F.array_join(F.slice("__run", own + 2, F.lit(fan)), ""))
    return joined.select(*child.columns, F.concat(siblings, F.col("__proof")).alias("proof"), "subroot")


def _pushed(nodes: DataFrame, parents: list[DataFrame], tops: DataFrame, fan: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """nodes (tree, at, n, ...) with proof and subroot, and the tables that they are read from; tops (tree, proof, subroot) says what each tree's root inherits."""
    tops = tops.select(F.col("tree").alias("__tree"), "proof", "subroot")
    pushed: list[DataFrame] = []
    for depth in range(len(parents) - 1, -1, -1):
        level = parents[depth].drop("digest")
        done = level.where("n = 1").join(tops, F.col("tree") == F.col("__tree")).drop("__tree")
        if pushed:
            done = done.unionByName(_from_parents(level.where("n > 1"), pushed[-1], fan))
        pushed.append(cut(done, f"{name}-proof-{depth}"))
        drop(*pushed[:-1][-1:])
    single = nodes.where("n = 1").join(tops, F.col("tree") == F.col("__tree")).drop("__tree")
    return (single.unionByName(_from_parents(nodes.where("n > 1"), pushed[-1], fan)) if pushed else single), pushed[-1:]


def _fold(start: Column, proof: Column, at: Column, n: Column, fan: int) -> Column:
    """struct(digest, used): the digest of the root above a leaf, by the siblings that its proof holds from `start.used` on."""
    heights = F.sequence(F.lit(1), F.lit(-(-63 // (fan.bit_length() - 1))))  # enough for any n; a level of one node stays as it is
    state = F.struct(start["digest"].alias("digest"), start["used"].cast("long").alias("used"), at.cast("long").alias("at"), n.cast("long").alias("n"))

    def up(s: Column, _: Column) -> Column:
        own = s["at"] % fan
        others = F.least(F.lit(fan).cast("long"), s["n"] - s["at"] + own) - 1
        before = F.substr(proof, (s["used"] + 1).cast("int"), (own * 64).cast("int"))
        after = F.substr(proof, (s["used"] + own * 64 + 1).cast("int"), ((others - own) * 64).cast("int"))
        above = F.struct(
            F.sha2(F.concat(before, s["digest"], after), 256).alias("digest"),
            (s["used"] + others * 64).alias("used"),
            F.floor(s["at"] / fan).cast("long").alias("at"),
            F.ceil(s["n"] / fan).cast("long").alias("n"),
        )
        return F.when(s["n"] > 1, above).otherwise(s)

    return F.aggregate(heights, state, up)


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", columns: Sequence[str] = COLUMNS, now_text: Column | None = None, text_col: str = "text", fan: int = FAN) -> DataFrame:
    """Every row's doc_id, leaf, subroot, root, proof, folded_root and verified.

    The tree is that of docs' rows. `now_text` is the text column as it is found now (by default unchanged): folded_root is made from
    the leaf of that row and the proof of the original one, and verified says that it still gives the root.
    """
    values = [F.col(c) for c in columns]
    changed = [now_text if c == text_col and now_text is not None else F.col(c) for c in columns]
    same = F.lit(True) if now_text is None else now_text.eqNullSafe(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(tree_col).alias("name"), leaf(values).alias("leaf"), F.when(~same, leaf(changed)).alias("found"))
    rows = cut(rows, "merkle-leaves")
    order = [F.col("name").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    placed = sorted_ranges(rows, order, "merkle-placed")
    drop(rows)
    parts = cut(placed.groupBy("__range", "name").agg(F.count("*").alias("rows"), F.min("__at").alias("first")), "merkle-parts")
    trees = cut_numbered(parts.groupBy("name").agg(F.sum("rows").alias("n")), [F.col("name").asc_nulls_first()], "tree", "merkle-trees")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("name").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("start", earlier - F.col("first")).select("__range", F.col("name").alias("__name"), "start")
    starts = starts.join(trees.withColumnRenamed("name", "__other"), F.col("__name").eqNullSafe(F.col("__other"))).select(F.col("__range").alias("__part"), "__name", "start", "tree", "n")
    starts = cut(starts, "merkle-starts")
    leaves = placed.join(bounded(starts), (F.col("__range") == F.col("__part")) & F.col("name").eqNullSafe(F.col("__name")))
    leaves = cut(leaves.select("doc_id", "tree", (F.col("start") + F.col("__at")).alias("at"), "n", "leaf", "found"), "merkle-nodes")
    drop(placed, parts, trees, starts)
    parents, subroots = _levels(leaves.select("tree", "at", "n", F.col("leaf").alias("digest")), most, fan, "merkle-level")
    # The tree of trees: the same two steps over the subroots.
    top = cut(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("digest")), "merkle-subroots")
    top_parents, top_root = _levels(top, n_trees, fan, "merkle-top")
    root = top_root.first()["subroot"] if n_trees else None
    inherited = top_root.select("tree", F.lit("").alias("proof"), "subroot")
    pushed, read = _pushed(top, top_parents, inherited, fan, "merkle-top")
    tops = cut(pushed.select(F.col("at").alias("tree"), "proof", F.col("digest").alias("subroot")), "merkle-tops")
    drop(top, *top_parents, *read)
    proved, _ = _pushed(leaves, parents, bounded(tops), fan, "merkle")
    drop(*parents)
    first = F.struct(F.coalesce("found", "leaf").alias("digest"), F.lit(0).alias("used"))
    low = _fold(first, F.col("proof"), F.col("at"), F.col("n"), fan)
    folded = proved.withColumn("__low", low).withColumn("folded_root", _fold(F.col("__low"), F.col("proof"), F.col("tree"), F.lit(n_trees), fan)["digest"])
    whole = F.lit(root).cast("string")
    return folded.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def tampered_digest(docs: DataFrame) -> DataFrame:
    """The manifest of all documents, checked against rows of which about a third were altered: texts lower-cased in A-Z."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, now_text=text).withColumn("proof_sha256", F.sha2("proof", 256)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
