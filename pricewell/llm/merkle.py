"""Operator 11: Merkle manifest of a dataset, built from higher-order SQL functions.

Rows become leaves, the leaves of each group a tree of runs of ``RUN`` nodes,
the groups' roots one more tree. Ordered leaves are gathered into arrays of a
fixed size; sequence, slice, transform and aggregate collapse ``LEVELS`` levels
of such a block at once, and the blocks' roots are the next round's leaves. No
task sees a whole group: ranks come from a range partitioning, and all that
grows with a group is its number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewell.llm.shared import released, stored

RUN, LEVELS = 16, 2
BLOCK = RUN**LEVELS
#: Rows up to which the ranges' offsets and the groups' paths are broadcast.
BROADCAST_ROWS = 200_000

_PATH = "array<struct<before: string, after: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """Digest of the columns' texts, each behind its length in bytes, a null as one dash."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def folded_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _bounded(df: DataFrame, side: DataFrame) -> DataFrame:
    """side, to be broadcast only where its rows are few."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def _positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows with pos, the rank inside ``key`` by order (nulls first), and left, the levels of the key's tree.

    Ranges of (key, order) are sorted by one task each; a row's rank is its place
    in the range plus what earlier ranges hold of its key. Equal rows are dealt
    out by a random last column, so they don't meet in one range.
    """
    ranged = rows.withColumn("_tie", F.rand(11)).repartitionByRange("key", *order, "_tie").sortWithinPartitions("key", *order, "_tie")
    ranged = stored(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("_at", 33)
    sizes = ranged.groupBy("key", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(whole)
    levels = F.size(F.filter(F.sequence(F.lit(0), F.lit(14)), lambda i: F.expr("1L") * F.pow(F.lit(RUN), i).cast("long") < total))
    sizes = stored(sizes.select("key", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), levels.alias("left")), "ranges")
    placed = ranged.withColumn("_part", part).join(_bounded(ranged, sizes), ["key", "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), [ranged, sizes]


_COLLAPSED = f"""aggregate(slice(sequence(1, {LEVELS}), 1, least(left, {LEVELS})),
    named_struct('nodes', transform(rows, r -> r.node), 'runs', cast(array() as array<array<string>>)),
    (tree, level) -> transform(
        array(transform(sequence(0, cast((size(tree.nodes) - 1) div {RUN} as int)), run -> array_join(slice(tree.nodes, run * {RUN} + 1, {RUN}), ''))),
        runs -> named_struct('nodes', transform(runs, r -> sha2(r, 256)), 'runs', concat(tree.runs, array(runs))))[0])"""

# Of a block's row i: the digests before and after its node in the run of each level.
_OWN = f"""transform(sequence(1, size(runs)), level -> transform(
        array(named_struct('run', runs[level - 1][cast(i div shiftleft(1, 4 * level) as int)], 'own', cast((i div shiftleft(1, 4 * (level - 1))) % {RUN} as int))),
        s -> named_struct('before', substring(s.run, 1, 64 * s.own), 'after', substring(s.run, 64 * s.own + 65)))[0])"""


def _blocks(nodes: DataFrame) -> list[DataFrame]:
    """The rounds' blocks: key, block, left, rows (structs with node), top. The last round has one block a key.

    nodes: key, pos, left, node; other columns go with the node.
    """
    most = nodes.agg(F.max("left")).first()[0] or 0
    rounds, carried = [], [c for c in nodes.columns if c not in ("key", "pos", "left")]
    for i in range(max(1, -(-most // LEVELS))):
        block = F.shiftrightunsigned("pos", 4 * LEVELS).alias("block")
        rows = nodes.groupBy("key", block).agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("pos", *carried))).alias("rows"))
        rounds.append(stored(rows.withColumn("top", F.expr(f"{_COLLAPSED}.nodes[0]")), f"blocks-{i}"))
        nodes = rounds[-1].select("key", F.col("block").alias("pos"), F.greatest(F.col("left") - LEVELS, F.lit(0)).alias("left"), F.col("top").alias("node"))
        carried = ["node"]
    return rounds


def _paths(rounds: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The first round's rows with path, from the node up: what stands before and after it in each run.

    tops: key, path and the carried columns, for each key's root.
    """
    down = tops.withColumn("block", F.lit(0).cast("long"))
    for i, blocks in reversed([*enumerate(rounds)]):
        side = _bounded(blocks, down) if i == len(rounds) - 1 else down
        joined = blocks.join(side, ["key", "block"]).withColumn("runs", F.expr(f"{_COLLAPSED}.runs"))
        own = f"if(size(runs) = 0, cast(array() as {_PATH}), {_OWN})"
        rows = joined.select("key", *carried, F.expr(f"inline(transform(rows, (r, i) -> named_struct('row', r, 'path', concat({own}, path))))"))
        down = rows.select("key", *carried, F.col("row.pos").alias("block"), "path") if i else rows.select("key", *carried, "row.*", "path")
    return down


def manifest(leaves: DataFrame, group: str, order: str) -> tuple[DataFrame, list[DataFrame]]:
    """Every leaf with subroot (its group's root), root, and path, its proof; and the stored tables behind it, to be released once it is read.

    leaves: node (a leaf's digest), the group and order columns; all others are
    carried along, but those named subroot, root or path give way to the result's.
    Groups are ordered bytewise, the null group first; leaves by order, null
    first, then by node; equal leaves stand in any order. While several nodes
    remain, each ``RUN`` consecutive ones (the last ones: fewer, even one) become
    their digest. A lone leaf is its own root, with an empty path. An empty table
    gives no rows. Groups of any size and number are dealt out by ranges.
    """
    others = [c for c in leaves.columns if c != "node"]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    inner = leaves.select(key.alias("key"), F.col(f"`{order}`").alias("order"), "node", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    inner = stored(inner, "leaves")  # the ranges' sample reads them once more
    placed, old = _positions(inner, ["order", "node"])
    groups = _blocks(placed.drop("order"))
    released(inner, *old)
    subroots = groups[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("top").alias("node"))
    placed, old = _positions(subroots, ["name"])
    whole = _blocks(placed)
    released(*old)
    empty = F.expr(f"cast(array() as {_PATH})")
    of_groups = _paths(whole, whole[-1].select("key", empty.alias("path"), F.col("top").alias("root")), ["root"])
    tops = stored(of_groups.select(F.col("name").alias("key"), "path", "root", F.col("node").alias("subroot")), "tops")
    found = ["node", "subroot", "root", "path"]
    rows = _paths(groups, tops, ["subroot", "root"])
    return rows.select(*found, *(F.col("row").getField(c).alias(c) for c in others if c not in found)), [*groups, *whole, tops]


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p.before, p.after)), ""))


def folded(node: Column, path: str = "path") -> Column:
    """The root that node and the siblings of path give."""
    return F.aggregate(path, node, lambda below, p: F.sha2(F.concat(p.before, below, p.after), 256))
