"""Operator 12: a Merkle manifest of a table, folded in blocks of leaves by higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import written
from veilmark.llm.ranking import numbered

_DIGITS = 64


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The lower-case hex SHA-256 of the fields of a row, put together."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


@dataclass(frozen=True)
class Shape:
    """`fanout` nodes are a run, whose digest is their parent; a block folds `depth` levels within one row."""

    fanout: int = 16
    depth: int = 2

    @property
    def block(self) -> int:
        return self.fanout**self.depth

    def height(self, nodes: str) -> str:
        """SQL: levels above `nodes` nodes until one is left."""
        powers, p = [], 1
        while p < 1 << 62:
            powers.append(f"{p}L")
            p *= self.fanout
        return f"size(filter(array({', '.join(powers)}), p -> {nodes} > p))"

    def runs(self, level: str) -> str:
        """SQL: the text of each run of a level, its digests side by side."""
        return f"transform(sequence(0, (size({level}) - 1) div {self.fanout}), r -> array_join(slice({level}, r * {self.fanout} + 1, {self.fanout}), ''))"

    def folded(self) -> str:
        """SQL over (members, height): struct(level, runs) after at most `depth` levels; runs[k] are the runs of level k."""
        runs = self.runs("acc.level")
        return (
            f"aggregate(sequence(1, {self.depth}), named_struct('level', transform(members, m -> m.node), 'runs', cast(array() as array<array<string>>)), "
            f"(acc, k) -> if(k <= height, named_struct('level', transform({runs}, t -> sha2(t, 256)), 'runs', concat(acc.runs, array({runs}))), acc))"
        )

    def path(self, member: str) -> str:
        """SQL: the steps of the member numbered `member` up through its block: the run it is in, and its place there."""
        powers = ", ".join(str(self.fanout**k) for k in range(self.depth + 1))
        return f"transform(runs, (texts, k) -> named_struct('run', texts[cast({member} div array({powers})[k + 1] as int)], 'place', cast(({member} div array({powers})[k]) % {self.fanout} as int)))"


def climb(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """Folds the trees of `nodes` (tree, at, group_rows, node, more columns) block by block up to one node each.

    The first table holds blocks of leaves, each further one blocks of the tops of the one before; rows are
    (tree, block, tree_nodes, members, runs, top). A block is at most fanout**depth members, whatever a tree's size.
    A last block collapses as many levels as the full ones, so a run of one has a parent while its tree has others.
    """
    more = [c for c in nodes.columns if c not in ("tree", "at", "group_rows", "node")]
    stages = []
    while True:
        member = F.struct("at", "node", *more)
        blocks = nodes.groupBy("tree", F.expr(f"at div {shape.block}").alias("block")).agg(F.max("group_rows").alias("tree_nodes"), F.sort_array(F.collect_list(member)).alias("members"))
        blocks = blocks.withColumn("height", F.expr(shape.height("tree_nodes"))).withColumn("folded", F.expr(shape.folded()))
        stage = written(blocks.select("tree", "block", "tree_nodes", "members", F.col("folded.runs").alias("runs"), F.col("folded.level")[0].alias("top")))
        stages.append(stage)
        widest = stage.agg(F.max("tree_nodes")).first()[0] or 0
        if widest <= shape.block:
            return stages
        above = F.expr(f"(tree_nodes + {shape.block - 1}) div {shape.block}")
        nodes, more = stage.select("tree", F.col("block").alias("at"), above.alias("group_rows"), F.col("top").alias("node")), []


def descend(stages: list[DataFrame], tops: DataFrame, shape: Shape) -> DataFrame:
    """The members of the first stage with their whole `path`; `tops` (tree, path, more) is what follows above each tree."""
    above = tops.withColumn("block", F.lit(0).cast("bigint"))
    kept = [c for c in tops.columns if c not in ("tree", "path")]
    for i, stage in reversed(list(enumerate(stages))):
        up = above.withColumnsRenamed({"tree": "up_tree", "block": "up_block", "path": "up_path"})
        joined = stage.join(up, stage["tree"].eqNullSafe(up["up_tree"]) & (stage["block"] == up["up_block"]))
        step = F.expr(f"explode(transform(members, (m, i) -> named_struct('m', m, 'path', {shape.path('i')})))")
        rows = joined.select("tree", "up_path", *kept, step.alias("step"))
        path = F.concat("step.path", "up_path").alias("path")
        if i:
            above = rows.select("tree", F.col("step.m.at").alias("block"), path, *kept)
        else:
            return rows.select("tree", "step.m.*", path, *kept)
    raise ValueError("a tree has at least one stage")


def merkle_manifest(leaves: DataFrame, order: Sequence[Column], shape: Shape = Shape()) -> DataFrame:
    """One row for each row of `leaves` (tree, node, more columns): these, `subroot`, `root` and `path`.

    `node` is a leaf's digest and `tree` the group it belongs to. In a group, leaves stand by `order`, and `fanout`
    consecutive nodes are hashed to one until a single node is left, the subroot; a lone leaf is its own. The
    subroots, by group (null first, bytewise), are folded to the root in the same way. `path` holds the steps from
    leaf to root: struct<run: the digests of a run side by side, place: where the own one stands>.

    Groups of any size are split over tasks, in the numbering by ranges and in blocks after it, and no group, tree
    or level is ever in one row; each stage is a written table, so a lost executor costs a part of one stage. An
    empty table gives no rows. `order` decides ties; rows that tie entirely are put in some fixed order. The columns
    at, path, root, subroot and group_rows must not be among those of `leaves`.
    """
    more = [c for c in leaves.columns if c not in ("tree", "node")]
    held = written(leaves.withColumn("tie", F.monotonically_increasing_id()))
    groups = climb(numbered(held, ["tree"], [*order, F.col("node"), F.col("tie")]).drop("tie"), shape)
    subroots = written(groups[-1].select(F.col("tree").alias("name"), F.col("top").alias("node")))
    top = climb(numbered(subroots, [], [F.col("name").asc_nulls_first()]).withColumn("tree", F.lit(0)), shape)
    found = top[-1].select("top").first()
    none = F.expr("cast(array() as array<struct<run: string, place: int>>)")
    roots = leaves.sparkSession.range(1).select(F.lit(0).alias("tree"), none.alias("path"))
    paths = descend(top, roots, shape).select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot"))
    rows = descend(groups, written(paths), shape)
    return rows.select("tree", "node", *more, "subroot", F.lit(found[0] if found else None).cast("string").alias("root"), "path")


def siblings(step: str) -> tuple[str, str]:
    """SQL: the digests before and after the own one in a step of a path."""
    return f"substring({step}.run, 1, {_DIGITS} * {step}.place)", f"substring({step}.run, {_DIGITS} * {step}.place + {_DIGITS + 1})"


def proof(path: str = "path") -> Column:
    """All siblings of a path, level by level and left to right, as one string."""
    left, right = siblings("s")
    return F.expr(f"array_join(transform({path}, s -> concat({left}, {right})), '')")


def folded_root(leaf: str, path: str = "path") -> Column:
    """The root that the digest `leaf` (SQL) has with the siblings of a path."""
    left, right = siblings("s")
    return F.expr(f"aggregate({path}, {leaf}, (acc, s) -> sha2(concat({left}, acc, {right}), 256))")
