"""A Merkle manifest of a dataset, with a proof for every record.

Records become leaves, the leaves of one tree (one value of a column) are ordered and paired up
level by level, and the tops of the trees are paired up the same way into one root. The tree is
not kept: only every ``LEVELS``-th level is written. A proof needs the nodes between; each aligned
subtree of ``2 ** LEVELS`` stored nodes works them out again in its own row, emits the siblings of
its members and forgets them. So storage is the leaves plus about 1/256 of them, and any task holds
one subtree, however large a tree is.

Places in a tree come from a sort over all partitions (``mixing.ranked``); one value of the tree
column may hold all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.mixing import ranked
from marginalia.session import materialize

LEVELS = 8  # levels between two stored ones
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def spelled(value: Column) -> Column:
    """One field of a leaf: ``-`` for null, else the bytes of its UTF-8 text, ``:`` and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[spelled(f) for f in fields]), 256)


@dataclass
class Manifest:
    """Stored levels: ``records`` from the leaves of all trees to one node a tree, ``trees`` from
    those nodes to the root. Columns: tree, place, size (nodes of that level of the tree), digest;
    the first level also has the carried columns."""

    records: list[DataFrame]
    trees: list[DataFrame]
    levels: int


def _height(size: Column, levels: int) -> Column:
    """How many levels a subtree rises: until one node is left in its tree, ``levels`` at most."""
    whole = F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))
    return F.least(whole, F.lit(levels))


def _subtrees(nodes: DataFrame, levels: int) -> DataFrame:
    """One row for each aligned subtree: its stored nodes in order and ``rows``, their digests
    followed by all levels worked out from them (an array for each level)."""
    members = [c for c in nodes.columns if c not in ("tree", "place", "size")]
    grouped = nodes.groupBy("tree", F.shiftright("place", levels).alias("subtree")).agg(
        F.max("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("place", *members))).alias("members"),
    )

    def risen(row: Column) -> Column:
        pair = lambda i: F.concat(F.get(row, 2 * i), F.coalesce(F.get(row, 2 * i + 1), F.lit("")))
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(row) + 1, 1) - 1), lambda i: F.sha2(pair(i), 256))

    steps = F.slice(F.array(*[F.lit(i) for i in range(levels)]), F.lit(1), F.col("height"))
    grouped = grouped.withColumn("height", _height(F.col("size"), levels))
    rows = F.aggregate(
        steps,
        F.array(F.transform("members", lambda m: m["digest"])),
        lambda rows, _: F.concat(rows, F.array(risen(F.element_at(rows, -1)))),
    )
    return grouped.withColumn("steps", steps).withColumn("rows", rows)


def _rise(nodes: DataFrame, levels: int, purpose: str) -> list[DataFrame]:
    """The stored levels above ``nodes``, until every tree has one node."""
    stored = [nodes]
    while (stored[-1].agg(F.max("size")).first()[0] or 1) > 1:
        above = _subtrees(stored[-1].select("tree", "place", "size", "digest"), levels).select(
            "tree",
            F.col("subtree").alias("place"),
            F.shiftright(F.col("size") + (1 << levels) - 1, levels).alias("size"),
            F.get(F.element_at("rows", -1), F.lit(0)).alias("digest"),
        )
        stored.append(materialize(above, purpose))
    return stored


def _numbered(rows: DataFrame, order: list[Column], purpose: str) -> DataFrame:
    """Rows with a tree and a digest get place and size."""
    placed = materialize(ranked(rows, "tree", order).withColumnRenamed("rank_in_group", "place"), purpose)
    sizes = placed.groupBy("tree").count().select(F.col("tree").alias("_tree"), F.col("count").alias("size"))
    return placed.join(sizes, placed["tree"].eqNullSafe(F.col("_tree"))).drop("_tree")


def build(
    docs: DataFrame, fields=FIELDS, tree: str = "lang", order: str = "doc_id",
    carry: dict[str, Column] | None = None, levels: int = LEVELS,
) -> Manifest:
    """The manifest of all rows of ``docs``.

    Leaves ascend by ``order`` (null first, ties by digest) within each value of ``tree`` (null is
    one); trees are ordered by that value, null first, bytewise. Null fields count as such, empty
    texts as empty; equal rows are leaves of their own; other columns of ``docs`` are not read and
    may have any name. An empty table has no levels but an empty one. ``carry`` names expressions
    over ``docs`` that come out beside each proof. Texts are read once and never moved.
    """
    carried = carry or {}
    leaves = docs.select(
        F.col(tree).cast("string").alias("tree"), F.col(order).alias("key"),
        leaf_digest(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in carried.items()],
    )
    leaves = materialize(leaves, "merkle-digests")
    placed = _numbered(leaves, [F.col("key").asc_nulls_first(), F.col("digest")], "merkle-leaves")
    records = _rise(placed, levels, "merkle-levels")
    tops = records[-1].select(F.col("tree").alias("key"), F.lit("all").alias("tree"), "digest")
    trees = _rise(_numbered(tops, [F.col("key").asc_nulls_first()], "merkle-tops"), levels, "merkle-levels")
    return Manifest(records, trees, levels)


def _extract(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Paths of all ``nodes``: the siblings in their subtree, worked out again, then the path of
    the subtree's own top. A step without a sibling has a null digest."""
    extra = [c for c in nodes.columns if c not in ("tree", "place", "size")]
    tops = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "path", "subroot", "root")
    joined = _subtrees(nodes, levels).join(
        tops, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("subtree") == F.col("_place"))
    )

    def siblings(at: Column) -> Column:
        up = lambda level: F.call_function("shiftright", at, level)
        return F.transform(
            "steps",
            lambda level: F.struct(
                (up(level) % 2 == 1).alias("left"),
                F.get(F.get("rows", level), up(level).bitwiseXOR(F.lit(1))).alias("digest"),
            ),
        )

    proved = F.transform(
        "members",
        lambda m, at: F.struct(m["place"].alias("place"), *[m[c].alias(c) for c in extra], F.concat(siblings(at), F.col("path")).alias("path")),
    )
    return joined.select("tree", "subroot", "root", F.inline(proved))


def proofs(made: Manifest) -> DataFrame:
    """Per record: tree, place, key, digest (its leaf), carried columns, subroot, root and ``path``:
    from leaf to root one struct(left, digest) a level, ``left`` where the sibling comes first."""
    none = F.array().cast("array<struct<left:boolean,digest:string>>")
    down = made.trees[-1].select("tree", "place", none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(made.trees[:-1]):
        down = _extract(nodes, down, made.levels)
    named = made.trees[0].select(F.col("key").alias("_key"), F.col("place").alias("_at"), F.col("digest").alias("subroot"))
    # the tops of the trees: each has its value of the tree column as key and its own digest as subroot
    down = materialize(
        down.select("place", "path", "root")
        .join(named, F.col("place") == F.col("_at"))
        .select(F.col("_key").alias("tree"), F.lit(0).cast("long").alias("place"), "path", "subroot", "root"),
        "merkle-paths",
    )
    for nodes in reversed(made.records[1:-1]):
        down = materialize(_extract(nodes, down, made.levels).select("tree", "place", "path", "subroot", "root"), "merkle-paths")
    if len(made.records) > 1:
        return _extract(made.records[0], down, made.levels)
    leaves = made.records[0].drop("size")
    tops = down.withColumnRenamed("tree", "_tree").drop("place")
    return leaves.join(tops, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    other = lambda step: F.coalesce(step["digest"], F.lit(""))
    return F.aggregate(
        path,
        leaf,
        lambda node, step: F.sha2(F.when(step["left"], F.concat(other(step), node)).otherwise(F.concat(node, other(step))), 256),
    )


def path_digest(path: Column) -> Column:
    """One digest over all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda step: step["digest"]), ""), 256)
