"""A Merkle manifest of a table, in DataFrame operations only.

The rows of a group, in order, are the leaves of a tree in which every ``_ARITY`` consecutive nodes have one parent; the roots of
the groups are the leaves of one more tree of the same kind. A node is labelled with the interval [lo, hi) of leaf ranks that it
covers. Levels come in buckets of ``_LEVELS``: a block holds the ``_WIDTH`` nodes that share an ancestor at the top of their bucket,
so ancestors inside the bucket are found in the block, and one containment join per bucket attaches what lies above it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.ranks import numbered
from parcelry.sources.scratch import discard, keep

_ARITY, _LEVELS = 3, 4
_WIDTH = _ARITY**_LEVELS
_FEW = 10_000  # rows of a table that is broadcast


class Manifest(NamedTuple):
    rows: DataFrame
    nodes: DataFrame


def hashed(*texts: str | Column) -> Column:
    """The lower-case hex SHA-256 of texts in a row, as UTF-8."""
    return F.sha2(F.concat(*texts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values: each as its UTF-8 byte count, a colon and the text, or as a hyphen if it is null."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def proof_digest(path: str) -> Column:
    """The digest of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded_root(leaf: Column, path: str) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda node, s: hashed(s["before"], node, s["after"]))


def merkle_manifest(rows: DataFrame, *, group_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf") -> Manifest:
    """Give every row its place in the tree, and list the nodes.

    ``rows`` has a digest per row, as of leaf_digest. Returns ``rows``: the same rows with ``rank`` (in the group, from 0), ``subroot`` (of its group),
    ``root`` and ``path`` (for each level up to the root the joined digests of the siblings ``before`` and ``after`` the node; a
    node alone under its parent has neither); and ``nodes``: the group, ``level`` (0: leaves), ``lo``, ``hi`` and ``digest`` of the nodes of the groups.

    Leaves ascend by ``order_col`` (nulls first), then by digest; rows equal in both are interchangeable, and each is a leaf. A group with one
    row has its leaf as root, and so does a table with one group. Groups are ordered by their UTF-8 bytes, null first; null is
    a group of its own. Columns named like a result are replaced. An empty table gives no rows and no nodes. Runs jobs when it is called.

    Only digests, ids and the other columns of ``rows`` move: once into ranges of the order and once into blocks. No group meets in a task.
    """
    results = ("rank", "subroot", "root", "path")
    rows = rows.drop(*[c for c in rows.columns if c.lower() in results])
    carried = [c for c in rows.columns if c != leaf_col]
    leaves, sizes, used = _ranked(rows, group_col, order_col, leaf_col)
    blocks = _block_tables(leaves, sizes["leaves"], carried)
    discard(*used)
    tops = blocks[-1].select(F.col("grp").alias("rank"), F.col("top.digest").alias("digest"))
    # The tree over the groups: one group, whose leaves are the subroots.
    upper = _block_tables(tops.select(F.lit(0).cast("long").alias("grp"), "rank", "digest", F.lit(sizes["groups"]).cast("long").alias("n")), sizes["groups"], [])
    none = F.array().cast("array<struct<before:string,after:string>>")
    start = upper[-1].select("grp", "block", F.col("top.lo").alias("lo"), F.col("top.hi").alias("hi"), none.alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("top.digest").alias("root"))
    over = _paths(upper, start)
    over = over.select(F.col("rank").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root")
    start = blocks[-1].select("grp", F.col("top.lo").alias("lo"), F.col("top.hi").alias("hi")).join(_small(over), "grp")
    placed = _paths(blocks, start)
    out = placed.select(*[F.col("carried")[c].alias(c) for c in carried], F.col("digest").alias(leaf_col), "rank", "subroot", "root", "path")
    out = out.select(*rows.columns, *results) if rows.columns else out
    group = blocks[0].filter("block = 0").select("grp", F.col("members")[0]["carried"][group_col].alias(group_col))
    return Manifest(out, _nodes(blocks).join(_small(group), "grp").select(group_col, "level", "lo", "hi", "digest"))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a table of few rows; a larger one is joined by its key, which is unique on both sides or spread over ranges."""
    return F.broadcast(table) if len(table.select(F.lit(1)).head(_FEW + 1)) <= _FEW else table


def _ranked(rows: DataFrame, group_col: str, order_col: str, leaf_col: str) -> tuple[DataFrame, dict[str, int], tuple[DataFrame, ...]]:
    """(grp, rank, digest, n, carried): the groups numbered from 0 in their order, and each row's place in its group of n; counts; the tables this reads.

    Rows are sorted by ranges, so a group may lie in many of them; what a group has in earlier ranges is added to the places in a range.
    """
    carried = F.struct(*[F.col(c) for c in rows.columns if c != leaf_col])
    flat = rows.select(F.col(group_col).alias("of"), F.col(order_col).alias("at"), F.col(leaf_col).alias("digest"), carried.alias("carried"), F.monotonically_increasing_id().alias("tie"))
    order = ("of", "at", "digest", "tie")
    ranged = flat.repartitionByRange(*order).sortWithinPartitions(*order).drop("at", "tie")
    held = keep(ranged.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id() % F.lit(1 << 33)}), "leaves")
    per = held.groupBy("range", "of").agg(F.min("nth").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = keep(per.withColumns({"before": F.coalesce(F.sum("held").over(earlier), F.lit(0)), "n": F.sum("held").over(Window.partitionBy("of"))}), "parts")
    groups = keep(numbered(per.select("of", "n").distinct(), ["of"], "grp").withColumn("grp", F.col("grp") - 1), "groups")
    sizes = groups.agg(F.count("*").alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("leaves")).head().asDict()
    part = per.join(_small(groups.select(F.col("of").alias("of2"), "grp")), F.col("of").eqNullSafe(F.col("of2")))
    part = keep(part.select(F.col("range").alias("range2"), "of2", "grp", "n", "first", "before"), "places")
    placed = held.join(_small(part), (F.col("range") == F.col("range2")) & F.col("of").eqNullSafe(F.col("of2")))
    return placed.select("grp", (F.col("nth") - F.col("first") + F.col("before")).alias("rank"), "digest", "n", "carried"), sizes, (held, per, groups, part)


def _block_tables(nodes: DataFrame, most: int, carried: Sequence[str]) -> list[DataFrame]:
    """The blocks of each bucket of levels, from the leaves up to the bucket in which the largest group, of ``most`` leaves, has one node left."""
    tables: list[DataFrame] = []
    level = nodes.select("grp", "n", "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *["carried"] * bool(carried))
    while not tables or most > 1:
        tables.append(keep(_blocks(level, bool(carried and not tables)), "blocks"))
        level = tables[-1].select("grp", F.ceil(F.col("n") / _WIDTH).alias("n"), F.col("block").alias("rank"), "top.*")
        most = -(-most // _WIDTH)
    return tables


def _blocks(nodes: DataFrame, leaves: bool) -> DataFrame:
    """A row per block: its nodes with their paths inside the block, the levels above them, and the node on top."""
    fields = ("lo", "hi", "digest", *["carried"] * leaves)
    members = F.array_sort(F.collect_list(F.struct("rank", *fields)), lambda x, y: F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).otherwise(0))
    rows = nodes.groupBy("grp", "n", F.expr(f"rank DIV {_WIDTH}").alias("block")).agg(members.alias("members"))
    node = lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))
    rows = rows.withColumn("l0", F.transform("members", node))
    # A small group's tree ends where one node is left; a large one's goes through the whole bucket.
    height = reduce(lambda c, k: c.when(F.col("n") <= _ARITY**k, k), range(1, _LEVELS), F.when(F.col("n") <= 1, 0)).otherwise(_LEVELS)
    rows = rows.withColumn("height", height)
    for k in range(1, _LEVELS + 1):
        rows = rows.withColumn(f"l{k}", F.when(F.col("height") >= k, _parents(F.col(f"l{k - 1}"))).otherwise(F.col(f"l{k - 1}")))
        rows = rows.withColumn(f"s{k}", F.when(F.col("height") >= k, _siblings(F.col(f"l{k - 1}"), F.col(f"l{k}"))))
    # The ancestor of the i-th node k levels up is number i / 3^k of its level.
    path = lambda i: F.array_compact(F.array(*[F.get(f"s{k}", F.floor(i / _ARITY ** (k - 1)).cast("int")) for k in range(1, _LEVELS + 1)]))
    place = lambda x, i: F.struct(*[x[f].alias(f) for f in ("rank", *fields)], path(i).alias("path"))
    inner = F.array(*[F.when(F.col("height") >= k, F.col(f"l{k}")) for k in range(1, _LEVELS)])
    return rows.select("grp", "n", "block", F.transform("members", place).alias("members"), inner.alias("inner"), F.get(f"l{_LEVELS}", F.lit(0)).alias("top"), "height")


def _run(level: Column, i: Column) -> Column:
    return F.slice(level, i * _ARITY + 1, F.lit(_ARITY))


def _parents(level: Column) -> Column:
    def parent(i: Column) -> Column:
        run = _run(level, i)
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / _ARITY).cast("int")), parent)


def _siblings(level: Column, parents: Column) -> Column:
    """For each node the digests of what its parent's interval holds before and after its own."""

    def joined(nodes: Column) -> Column:
        return F.array_join(F.transform(nodes, lambda y: y["digest"]), "")

    def of_children(parent: Column, i: Column) -> Column:
        run = F.filter(_run(level, i), lambda y: (y["lo"] >= parent["lo"]) & (y["hi"] <= parent["hi"]))
        return F.transform(run, lambda x: F.struct(joined(F.filter(run, lambda y: y["hi"] <= x["lo"])).alias("before"), joined(F.filter(run, lambda y: y["lo"] >= x["hi"])).alias("after")))

    return F.flatten(F.transform(parents, of_children))


def _paths(tables: Sequence[DataFrame], start: DataFrame) -> DataFrame:
    """A row per node of the lowest bucket with its whole path: from the top down, each bucket's blocks meet the ancestors that contain them."""
    above = start
    for table in reversed(tables):
        above = _small(above.withColumnsRenamed({"grp": "grp2", "block": "block2", "lo": "lo2", "hi": "hi2"}))
        contained = (F.col("lo2") <= F.col("top.lo")) & (F.col("top.hi") <= F.col("hi2"))
        met = table.join(above, (F.col("grp") == F.col("grp2")) & (F.col("block") == F.col("block2")) & contained)
        each = met.select("grp", "above", "subroot", "root", F.explode("members").alias("m")).select("grp", "m.*", "above", "subroot", "root")
        each = each.withColumn("path", F.concat("path", "above")).drop("above")
        above = each.select("grp", F.col("rank").alias("block"), "lo", "hi", F.col("path").alias("above"), "subroot", "root")
        if table is not tables[0]:
            above = keep(above, "paths")
    return each


def _nodes(tables: Sequence[DataFrame]) -> DataFrame:
    """All nodes of the groups' trees with their levels."""
    found = []
    for t, table in enumerate(tables):
        node = lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))
        if t == 0:
            found.append(table.select("grp", F.lit(0).alias("level"), F.explode(F.transform("members", node)).alias("x")))
        levels = table.select("grp", "height", "top", F.posexplode("inner").alias("k", "level")).withColumn("k", F.col("k") + 1)
        whole = levels.filter("k < height").select("grp", (F.col("k") + t * _LEVELS).alias("level"), F.explode("level").alias("x"))
        top = table.filter("height > 0").select("grp", (F.col("height") + t * _LEVELS).alias("level"), F.col("top").alias("x"))
        found += [whole, top]
    return reduce(DataFrame.unionByName, found).select("grp", "level", "x.*")
