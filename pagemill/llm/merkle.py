"""Merkle manifest of a table: a digest for each row, one for each group, and one root for all.

The leaves of a group ascend by id; every ``FANOUT`` consecutive nodes become
one node of the next level until one is left, the group's subroot.  The
subroots, ordered by group, are the leaves of a last tree, whose root speaks
for the whole table.

Checkpoint and recompute: of the levels of a tree only every second one is
written.  A proof is taken top-down over aligned subtrees of two levels: the
stored nodes at the bottom of a subtree give its missing middle level again,
the siblings are emitted, and the middle level is forgotten.  A subtree has at
most ``FANOUT`` squared nodes, so no group of rows meets in one task, however
many leaves a tree has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.session import written

FANOUT = 16
_SUBTREE = FANOUT * FANOUT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The leaf of a row: each value as its UTF-8 byte count, ``:`` and itself; ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    return digest_of(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


@dataclass(frozen=True)
class Tree:
    """Stored levels of many trees, from the leaves up: ``tree, place, total, node`` and what the leaves carry.

    ``total`` is the number of nodes that a tree has on that level; where it
    is 1 the node is the tree's root and is not in a higher level.
    """

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        tops = [level.filter("total = 1").select("tree", F.col("node").alias("root")) for level in self.levels]
        return _union(tops)


@dataclass(frozen=True)
class Manifest:
    """``groups`` has the trees of the groups, ``top`` the tree of their subroots; ``root`` is None for an empty table."""

    groups: Tree
    top: Tree
    root: str | None


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``total`` in their tree, written.

    One sort over ranges of all rows; a tree's rows in a range are numbered
    there, and the ranges' counts are summed up.  A row number within the
    written input is the last key, so that equal rows can lie in many ranges.
    """
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    keys = ["tree", *order, "_number"]
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_number")
    ordered = written(spread.withColumn("_at", F.monotonically_increasing_id()), "merkle-order").withColumn("_range", F.shiftright("_at", 33))
    counts = ordered.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("total"),
    )
    return ordered.join(offsets, ["tree", "_range"]).withColumn("place", F.col("_at") + F.col("_offset")).drop("_at", "_range", "_offset")


def _subtrees(level: DataFrame) -> DataFrame:
    """The stored nodes of each aligned subtree, ``held``, in order."""
    kept = [c for c in level.columns if c not in ("tree", "total")]
    return (
        level.filter("total > 1").groupBy("tree", F.floor(F.col("place") / _SUBTREE).alias("subtree"))
        .agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", *(c for c in kept if c != "place")))).alias("held"))
    )


def _runs(held: Column) -> Column:
    last = F.floor((F.size(held) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.slice(held, r * FANOUT + 1, F.lit(FANOUT)))


def _joined(run: Column) -> Column:
    return digest_of(F.array_join(F.transform(run, lambda n: n["node"]), ""))


def _with_middle(subtrees: DataFrame) -> DataFrame:
    """``middle``: the level above the stored one, made again from it."""
    return subtrees.withColumn("middle", F.transform(_runs(F.col("held")), _joined))


def _next_level(level: DataFrame) -> DataFrame:
    """Two levels up; one where a single run is left."""
    two = F.when(F.col("total") > FANOUT, digest_of(F.array_join("middle", ""))).otherwise(F.col("middle")[0])
    return _with_middle(_subtrees(level)).select(
        "tree", F.col("subtree").alias("place"), F.ceil(F.col("total") / _SUBTREE).alias("total"), two.alias("node"),
    )


def build_tree(leaves: DataFrame, order: Sequence[str]) -> Tree:
    """Trees over ``leaves`` (``tree``, ``node``, the columns of ``order`` and others), every second level written."""
    levels = [written(_ranked(leaves, order), "merkle-level")]
    while not levels[-1].filter("total > 1").isEmpty():
        levels.append(written(_next_level(levels[-1]), "merkle-level"))
    return Tree(levels)


def _beside(nodes: Column, at: Column) -> Column:
    """The siblings before and after a place."""
    return F.struct(
        F.array_join(F.slice(nodes, F.lit(1), at), "").alias("before"),
        F.array_join(F.slice(nodes, at + 2, F.lit(FANOUT)), "").alias("after"),
    )


def _descend(level: DataFrame, above: DataFrame) -> DataFrame:
    """``level`` with ``path`` and the other columns of ``above``, which has those of the next stored level."""
    parents = above.withColumnRenamed("place", "subtree")
    others = [c for c in above.columns if c not in ("tree", "place", "path")]
    met = _with_middle(_subtrees(level)).join(parents, ["tree", "subtree"])
    runs = met.select("tree", "total", "path", *others, "middle", F.posexplode(_runs(F.col("held"))).alias("at", "run"))
    over = F.when(F.col("total") > FANOUT, F.array(_beside(F.col("middle"), F.col("at")))).otherwise(F.array().cast(_PATH))
    ways = runs.select("tree", "total", *others, F.concat(over, F.col("path")).alias("path"), "run")
    nodes = ways.select("*", F.posexplode("run").alias("at", "held"))
    own = F.array(_beside(F.transform("run", lambda n: n["node"]), F.col("at")))
    return nodes.select("tree", "total", *others, "held.*", F.concat(own, F.col("path")).alias("path"))


def paths(tree: Tree, above_roots: DataFrame) -> DataFrame:
    """The leaves of all trees with ``path``: the siblings from the leaf up, and then the path of their root.

    ``above_roots`` has ``tree`` and the ``path`` of each tree's root, and
    columns that all nodes of a tree get.  Upper levels, a small share of all
    nodes, are written; the leaves' paths are not.
    """
    kept, found = ["tree", "place", *(c for c in above_roots.columns if c != "tree")], None
    for height in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[height]
        tops = level.filter("total = 1").join(above_roots, "tree")
        rows = tops if found is None else tops.unionByName(_descend(level, found))
        found = written(rows.select(*kept), "merkle-paths") if height else rows
    return found


def manifest(
    df: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", also: dict[str, Column] | None = None,
) -> Manifest:
    """The digests of a table.

    A row's leaf is :func:`leaf_of` ``columns``; other columns do not matter.
    Leaves of a group ascend by ``id_col``, null first; rows with equal ids
    follow by their leaves, so repeated rows are leaves of their own and the
    outcome does not depend on the order of the input.  A null group comes
    before all others, which are ordered by their UTF-8 bytes.  An empty table
    has no root.  ``also`` are named columns that the leaves carry along.
    """
    group = F.col(f"`{group_col}`").cast("string")
    tree = F.struct(group.isNotNull().alias("known"), F.coalesce(group, F.lit("")).alias("name"))
    leaf = leaf_of([F.col(f"`{c}`") for c in columns])
    carried = [column.alias(name) for name, column in (also or {}).items()]
    leaves = written(df.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf.alias("node"), *carried), "merkle-leaves")
    groups = build_tree(leaves, ("id", "node"))
    subroots = groups.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("node"))
    top = build_tree(written(subroots, "merkle-subroots"), ("group",))
    found = top.roots.first()
    return Manifest(groups, top, found["root"] if found else None)


def proofs(made: Manifest) -> DataFrame:
    """For each leaf ``tree, id, node`` with ``path``, ``subroot`` and ``root``.

    ``path`` lists, from the leaf up to the root, the siblings before and
    after in each run, put together; a run of one has none, and is a level
    all the same.
    """
    start = made.top.roots.select("tree", F.array().cast(_PATH).alias("path"))
    tops = paths(made.top, start).select(F.col("group").alias("tree"), F.col("node").alias("subroot"), "path")
    return paths(made.groups, written(tops, "merkle-tops")).withColumn("root", F.lit(made.root))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, beside: digest_of(beside["before"], node, beside["after"]))


def proof_digest(path: Column) -> Column:
    return digest_of(F.array_join(F.transform(path, lambda beside: F.concat(beside["before"], beside["after"])), ""))


def verification(
    df: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", every: int = 5,
) -> DataFrame:
    """The manifest of ``df``, a proof for each row, and its check on rows of which some were tampered with.

    Tampering lower-cases A-Z in the text where ``every`` divides the CRC-32
    of the decimal id; a null id or text stays as it is.  A text without such
    letters is the same afterwards, and is verified.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % every == 0, F.lit(False))
    text = F.col(f"`{text_col}`")
    lowered = leaf_of([F.translate(text, upper, upper.lower()) if c == text_col else F.col(f"`{c}`") for c in columns])
    rows = proofs(manifest(df, columns, id_col, group_col, {"tampered": F.when(hit, lowered)}))
    checked = rows.withColumn("folded_root", folded(F.coalesce("tampered", "node"), F.col("path")))
    return checked.select(
        F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
