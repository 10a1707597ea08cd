"""Ancestors in trees of any depth, by pointer doubling.

Every node points to its parent. In a round each node takes over what its pointer's node knows and then points
where that one points, so pointers span 1, 2, 4, ... levels and a tree of depth d is done after log2(d) + 1 joins. Nodes are
told apart by id alone. Rounds are written, so no round is computed twice. Pointers of a cycle never come to an end:
after as many rounds as the number of nodes allows they are left out. A round writes only what still moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import dealt, stored


def _doubled(rows: DataFrame, own: dict[str, Column], combine) -> DataFrame:
    """rows(category_id, parent_id) with `own` states, folded over all ancestors. combine(c) makes the new states of the
    node's own columns and those of its pointer's node, `_of.<state>`, which is null where that node is unknown."""
    rows = stored(rows.filter("category_id is not null").select("category_id", F.col("parent_id").alias("_up"), *(v.alias(k) for k, v in own.items())))
    # nodes whose pointer has come to its end are joined to, but not joined any more: their null keys would meet in one task
    ended, going = rows.filter("_up is null"), rows.filter("_up is not null")
    n = rows.count()
    for _ in range(max(1, n).bit_length() + 1):
        if going.isEmpty():
            break
        above = ended.unionByName(going).select(F.col("category_id").alias("_id"), F.struct("_up", *own).alias("_of"))
        rows = stored(dealt(going, n, "_up").join(dealt(above, n, "_id"), F.col("_up") == F.col("_id"), "left").select("category_id", F.col("_of._up").alias("_up"), *(v.alias(k) for k, v in combine().items())))
        ended, going = ended.unionByName(rows.filter("_up is null")), rows.filter("_up is not null")
    return ended.unionByName(going)


def depths(categories: DataFrame) -> DataFrame:
    """categories(category_id, parent_id), ids distinct -> (category_id, root_id, depth) of all that hang below a root.

    Members of cycles, what hangs below them and children of unknown parents are left out, as are null ids.
    """
    is_root = F.col("parent_id").isNull()
    own = {"root_id": F.when(is_root, F.col("category_id")), "depth": (~is_root).cast("int")}
    found = _doubled(categories, own, lambda: {"root_id": F.coalesce("root_id", "_of.root_id"), "depth": F.col("depth") + F.coalesce("_of.depth", F.lit(0))})
    return found.filter("_up is null and root_id is not null").select("category_id", "root_id", "depth")


def below(categories: DataFrame, root) -> DataFrame:
    """Ids of a node and of all below it, in a cycle too."""
    found = _doubled(categories, {"hit": F.col("category_id") == F.lit(root)}, lambda: {"hit": F.col("hit") | F.coalesce("_of.hit", F.lit(False))})
    return found.filter("hit").select("category_id")


def paths(categories: DataFrame, separator: str = "/") -> DataFrame:
    """categories(category_id, parent_id, name, ...) without cycles or unknown parents -> all their columns and path. A null name is
    left out of paths."""
    name = F.coalesce("name", F.lit(""))
    joined = lambda: {"path": F.when(F.col("_of.path").isNull() | (F.col("_of.path") == ""), F.col("path")).when(F.col("path") == "", F.col("_of.path")).otherwise(F.concat("_of.path", F.lit(separator), "path"))}
    return categories.join(_doubled(categories, {"path": name}, joined).select("category_id", "path"), "category_id")
