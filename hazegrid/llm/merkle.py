"""Merkle manifest of a table: one tree per group, and one over the groups' roots.

Rows are leaves. Their places inside a group come from one range partitioning, so a group of any size is spread over
the tasks. Aligned blocks of ``FAN * FAN`` neighbours then become one row each, which keeps every level of its small
tree as one string of digests: parents are hashes of fixed-width substrings, and a node's siblings are the substrings
left and right of it. The blocks' tops are the nodes of the next round, until one node per group is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.session import discard, materialize

#: Children of a node.
FAN = 16
#: Nodes of one block: two levels of the tree.
BLOCK = FAN * FAN
#: Characters of a digest.
WIDTH = 64
_STEP = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row from the given columns in their order."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(start: Column, path: Column) -> Column:
    """Root that ``start`` leads to along ``path``."""
    return F.aggregate(path, start, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings along ``path``."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parents(level: Column) -> Column:
    run = FAN * WIDTH
    numbers = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(numbers, lambda i: F.sha2(level.substr(i * run + 1, F.lit(run)), 256)), "")


def _flanks(level: Column, i: Column) -> Column:
    """What stands left and right of digest ``i`` in its run."""
    first = i - i % FAN
    left = level.substr(first * WIDTH + 1, (i - first) * WIDTH)
    right = level.substr((i + 1) * WIDTH + 1, (first + FAN - 1 - i) * WIDTH)
    return F.struct(left.alias("left"), right.alias("right"))


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order``) inside its group and the group's size ``n``.

    The rows are dealt by ranges of (group, order) and stored; each range counts its rows of a group, and the counts
    before a range are its first position. ``group`` must not be null; nulls come first in ``order``.
    """
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    spread = materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "spread")
    parts = spread.groupBy(group, "part").agg(F.count(F.lit(1)).alias("m"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("m").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select(group, "part", before.alias("before"), F.sum("m").over(of_group).alias("n"))
    inside = Window.partitionBy(group, "part").orderBy(*keys[1:])
    numbered = spread.withColumn("k", F.row_number().over(inside) - 1).join(base, [group, "part"])
    out = numbered.select(*rows.columns, (F.col("before") + F.col("k")).alias("pos"), "n")
    out._scratch_path = spread._scratch_path
    return out


def _blocks(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per ``grp`` and block of ``nodes`` (``grp, n, pos, digest`` and the carried columns), with its levels."""
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("items")
    grouped = nodes.groupBy("grp", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items)
    leaves = grouped.withColumn("level0", F.array_join(F.transform("items", lambda x: x["digest"]), ""))
    if not carried:
        leaves = leaves.withColumn("items", F.transform("items", lambda x: x["pos"]))
    first = leaves.withColumn("level1", F.when(F.col("n") > 1, _parents(F.col("level0"))))
    return first.withColumn("top", F.when(F.col("n") > FAN, _parents(F.col("level1"))).otherwise(F.coalesce("level1", "level0")))


def _steps(i: Column) -> Column:
    """Steps inside the block for its node ``i``, then those above the block."""
    low, high = _flanks(F.col("level0"), i), _flanks(F.col("level1"), F.floor(i / FAN).cast("int"))
    none = F.array().cast(_STEP)
    return F.concat(F.when(F.col("n") > FAN, F.array(low, high)).when(F.col("n") > 1, F.array(low)).otherwise(none), F.col("above"))


def climb(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``grp``, the carried columns, ``digest``, ``path`` to the group's root and ``top`` (that root) of every node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [materialize(_blocks(nodes, carried), "blocks")]
    while most > BLOCK:
        tops = rounds[-1].select("grp", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("top").alias("digest"))
        rounds.append(materialize(_blocks(tops, []), "blocks"))
        most = -(-most // BLOCK)
    above = rounds[-1].withColumns({"above": F.array().cast(_STEP), "root": F.col("top")})
    for below in reversed(rounds[:-1]):
        at = F.col("pos")
        each = above.select("*", F.explode("items").alias("pos")).select("grp", at.alias("block"), _steps((at % BLOCK).cast("int")).alias("above"), "root")
        above = below.join(each, ["grp", "block"])
    each = above.select("*", F.posexplode("items").alias("i", "item"))
    if not carried:
        return each.select("grp", F.col("item").alias("pos"), _steps(F.col("i")).alias("path"), F.col("root").alias("top"))
    return each.select("grp", *[F.col(f"item.{c}").alias(c) for c in carried], F.col("item.digest").alias("digest"), _steps(F.col("i")).alias("path"), F.col("root").alias("top"))


def manifest(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``id_col, leaf, subroot, root, path`` and the columns of ``carry`` for every row.

    A leaf is the digest of ``columns``. Leaves of a group ascend by id (nulls first, repeated ids by digest); groups
    ascend bytewise, the null group first. ``path`` lists, from the leaf to the root, the digests left and right of
    the node at every level that is hashed; it is empty where a tree has one node. Nulls in any column are marked in
    the digest, repeated rows are leaves of their own, an empty table has no rows and columns that are not named are
    not read. ``carry`` adds columns computed from ``docs``, under names other than those above.
    """
    carry = dict(carry or {})
    # '' for the null group and a mark before every other name: never null, and in the same order
    grp = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), docs[id_col].alias("id"), leaf([docs[c] for c in columns]).alias("digest"), *[c.alias(f"c_{name}") for name, c in carry.items()])
    # stored before the ranges are sampled, so that texts are hashed once
    leaves = materialize(leaves, "leaves")
    placed = positions(leaves, "grp", ["id", "digest"])
    rows = climb(placed, ["id", *[f"c_{name}" for name in carry]])
    rows = materialize(rows, "paths")
    discard(leaves)
    discard(placed)
    subroots = rows.groupBy("grp").agg(F.first("top").alias("digest")).select(F.lit(0).alias("all"), "grp", "digest")
    of_groups = positions(subroots, "all", ["grp"]).select(F.lit("").alias("grp"), "n", "pos", "digest", F.col("grp").alias("name"))
    over = climb(of_groups, ["name"]).select(F.col("name").alias("grp"), F.col("path").alias("over"), F.col("top").alias("root"))
    return rows.join(over, "grp").select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "over").alias("path"),
        *[F.col(f"c_{name}").alias(name) for name in carry],
    )
