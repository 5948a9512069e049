"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, and a proof for every row.

No group is sorted to find its leaves' places. The ids of a group form a bitmap whose non-zero 64-bit words are made by ``bit_or`` where the rows lie and merged by one shuffle; words lie in
containers of 1,024, and a popcount directory holds for each word how many leaves of its group come before. A leaf's place is its word's entry plus the set bits below its own. Places then deal
leaves to slot arrays of ``FANOUT ** LEVELS``; a task turns one array into the node above it, and round by round the arrays shrink to a root. On the way down each array gets the path from its
node to the root, so that a leaf's proof takes one array and one path, however large its group.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship
from .common import stage

FANOUT = 16
#: Levels that one slot array spans.
LEVELS = 2
SLOTS = FANOUT ** LEVELS
#: Words of a container, as a power of two.
CONTAINER = 10


def field(column: Column) -> Column:
    """A value as text that no other value gives: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    """Lower-case hex sha256 of the columns' fields, one after the other."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z in lower case and all else unchanged."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which nulls match nulls."""
    other = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def _numbered(groups: DataFrame, col: str) -> DataFrame:
    """``groups`` with g, the place of each distinct value in its order, nulls first; ranges are sorted apart and then counted."""
    ranges = groups.repartitionByRange(F.col(col).asc_nulls_first()).sortWithinPartitions(F.col(col).asc_nulls_first())
    ranges = stage(ranges.withColumn("at", F.monotonically_increasing_id()), "groups").withColumn("part", F.shiftright("at", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranges.join(parts, "part").withColumn("g", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (id, grp, leaf, row, any more columns) with g (place of the group), total (leaves of the group) and i (place of the leaf in its group).

    Leaves ascend by id, null ids first. Rows of one group and id are ordered by leaf, equal leaves by ``row``, which must be a fixed number with the partition in its upper bits.
    """
    leaves = leaves.withColumn("word", F.shiftright("id", 6)).withColumn("bit", F.col("id").bitwiseAND(63).cast("int"))
    words = stage(leaves.groupBy("grp", "word").agg(F.coalesce(F.expr("bit_or(shiftleft(1L, bit))"), F.lit(0)).alias("bits"), F.count("*").alias("rows")), "words")
    words = words.withColumn("container", F.shiftright("word", CONTAINER))
    containers = words.groupBy("grp", "container").agg(F.sum("rows").alias("rows"))
    groups = _numbered(containers.groupBy("grp").agg(F.sum("rows").alias("total")), "grp")
    earlier = Window.partitionBy("grp").orderBy(F.col("container").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    containers = containers.select("grp", "container", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("grp", "container").orderBy(F.col("word").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    directory = words.withColumn("before", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    directory = _same(_same(directory, containers, ["grp", "container"], "inner"), groups, ["grp"], "inner")
    directory = directory.select("grp", "word", "bits", "g", "total", (F.col("base") + F.col("before")).alias("before"))

    doubtful = words.where("word is null or rows > bit_count(bits)").select("grp", "word")
    tie, extra = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    if not doubtful.isEmpty():  # null ids or several rows of one id: their places among themselves, and how far they shift later ids of their word
        several = _same(leaves, doubtful, ["grp", "word"], "left_semi").groupBy("grp", "id", "word", "bit").agg(F.count("*").alias("n")).where("id is null or n > 1")
        several = stage(several, "several")
        shifts = several.where("id is not null").groupBy("grp", "word").agg(F.collect_list(F.struct("bit", (F.col("n") - 1).alias("more"))).alias("shifts"))  # at most 64
        directory = _same(directory, shifts, ["grp", "word"], "left")
        leaves = _same(leaves, _order(_same(leaves, several.select("grp", "id"), ["grp", "id"], "left_semi")), ["row"], "left")
        tie = F.coalesce(F.col("tie"), F.lit(0).cast("bigint"))
        extra = F.expr("aggregate(coalesce(shifts, array()), 0L, (sum, s) -> sum + if(s.bit < bit, s.more, 0L))")
    found = _same(leaves, directory, ["grp", "word"], "inner")
    below = F.expr("if(id is null, 0, bit_count(bits & ~shiftleft(-1L, bit)))")
    return found.withColumn("i", F.col("before") + below + extra + tie).drop("word", "bit", "bits", "before", "shifts", "tie")


def _order(twins: DataFrame) -> DataFrame:
    """(row, tie): place of each row among the rows of its group and id. Counts by the first digits of the leaf, then by leaf and partition, so that no task orders all rows of an id."""
    twins = twins.select("grp", "id", "leaf", "row", F.substring("leaf", 1, 2).alias("head"), F.shiftright("row", 33).alias("part"))
    runs = stage(twins.groupBy("grp", "id", "head", "leaf", "part").agg(F.count("*").alias("n")), "runs")

    def earlier(keys: list[str], order: list[str]) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    heads = runs.groupBy("grp", "id", "head").agg(F.sum("n").alias("n")).select("grp", "id", "head", earlier(["grp", "id"], ["head"]).alias("heads_before"))
    runs = runs.select("grp", "id", "head", "leaf", "part", earlier(["grp", "id", "head"], ["leaf", "part"]).alias("runs_before"))
    runs = _same(runs, heads, ["grp", "id", "head"], "inner").drop("head")
    number = F.row_number().over(Window.partitionBy("grp", "id", "leaf", "part").orderBy("row")) - 1
    return _same(twins.withColumn("number", number), runs, ["grp", "id", "leaf", "part"], "inner").select("row", (F.col("heads_before") + F.col("runs_before") + F.col("number")).alias("tie"))


def _levels(total: int) -> int:
    """Levels between so many nodes and one."""
    n = 0
    while total > 1:
        total, n = -(-total // FANOUT), n + 1
    return n


def _climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a slot array and of each level above; every node is its hex text."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([hashlib.sha256("".join(below[k:k + FANOUT]).encode()).hexdigest() for k in range(0, len(below), FANOUT)])
    return found


def _array(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    """(rows by slot, nodes by slot, levels to climb) of one slot array."""
    table = table.take(pa.compute.sort_indices(table["i"])) if len(table) > 1 else table
    return table, [b.hex() for b in table["node"].to_pylist()], min(LEVELS, _levels(table["total"][0].as_py()))


def _up(nodes: DataFrame) -> DataFrame:
    """One node per slot array of ``nodes`` (g, i, total, node)."""
    def reduce_array(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        table, hexes, levels = _array(table)
        total = table["total"][0].as_py()
        for _ in range(levels):
            total = -(-total // FANOUT)
        node = bytes.fromhex(_climb(hexes, levels)[-1][0])
        return pa.table({"g": table["g"].slice(0, 1), "i": table["array"].slice(0, 1), "total": pa.array([total], pa.int64()), "node": pa.array([node], pa.binary())})

    ship(nodes.sparkSession)
    arrays = nodes.select("g", "i", "total", "node", F.floor(F.col("i") / SLOTS).alias("array"))
    return arrays.groupBy("g", "array").applyInArrow(reduce_array, "g bigint, i bigint, total bigint, node binary")


def _down(nodes: DataFrame, paths: DataFrame, keep: list[str]) -> DataFrame:
    """Paths of ``nodes``, from the paths of the nodes above: the columns ``keep`` and ``lefts``, ``rights``: per level up to the root the hex text of the siblings before and after."""
    def extend(members: pa.Table, above: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        members, hexes, levels = _array(members)
        tree = _climb(hexes, levels)
        runs = [["".join(level[k:k + FANOUT]) for k in range(0, len(level), FANOUT)] for level in tree[:levels]]
        up_left, up_right = above["lefts"][0].as_py(), above["rights"][0].as_py()
        lefts, rights = [], []
        for k in range(len(hexes)):
            left, right = [], []
            for run in runs:
                k, slot = divmod(k, FANOUT)
                left.append(run[k][:64 * slot])
                right.append(run[k][64 * slot + 64:])
            lefts.append(left + up_left)
            rights.append(right + up_right)
        text = pa.list_(pa.string())
        top = pa.array([above["top"][0].as_py()] * len(members), pa.binary())
        return pa.table({**{c: members[c] for c in keep}, "top": top, "lefts": pa.array(lefts, text), "rights": pa.array(rights, text)})

    ship(nodes.sparkSession)
    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep)
    arrays = nodes.select(*dict.fromkeys(["g", "i", "total", "node", *keep]), F.floor(F.col("i") / SLOTS).alias("array"))
    paths = paths.withColumnRenamed("i", "array")
    return arrays.groupBy("g", "array").cogroup(paths.groupBy("g", "array")).applyInArrow(extend, f"{kinds}, top binary, lefts array<string>, rights array<string>")


def _tree(nodes: DataFrame) -> list[DataFrame]:
    """Staged nodes of each round, the last with one node per group."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > 1:
        rounds.append(stage(_up(rounds[-1]), "nodes"))
    return rounds


def _walk(rounds: list[DataFrame], paths: DataFrame, keep: list[str]) -> DataFrame:
    """Paths of the nodes of the first round, from those of the last round's."""
    if len(rounds) == 1:
        return _same(rounds[0].select("g", "i", *[c for c in keep if c not in ("g", "i")]), paths.drop("i"), ["g"], "inner").select(*keep, "top", "lefts", "rights")
    for k in range(len(rounds) - 2, -1, -1):
        paths = _down(rounds[k], paths, keep if k == 0 else ["g", "i"])
        if k:
            paths = stage(paths, "paths")
    return paths


def hashed(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, grp, leaf, altered, row) of all rows of ``docs``: the leaf over ``fields``, and a second leaf with the columns ``altered`` in their place where ``where`` holds, else null. Ids are integers or null."""
    leaf = F.unhex(digest(*[F.col(c) for c in fields]))
    other = F.unhex(digest(*[(altered or {}).get(c, F.col(c)) for c in fields])) if altered else F.lit(None).cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("leaf"),
                       (F.when(where, other) if where is not None else other).alias("altered"), F.monotonically_increasing_id().alias("row"))


def manifest(leaves: DataFrame) -> DataFrame:
    """A row per leaf of ``hashed``: id, grp, i (place in its group), leaf, altered, subroot, root (hex text) and lefts, rights, the proof.

    Per group, leaves ascend by id (null ids first; rows of one id by leaf). While there are several nodes, every 16 in a row, the last fewer, become the sha256 of their hex texts; the last node is
    the group's subroot (a lone leaf itself). Subroots in order of the groups' names, null first and then by bytes, give the root in the same way. ``lefts`` and ``rights`` hold the siblings of each
    level. Repeated rows are leaves of their own; an empty table has no rows.
    """
    spark = leaves.sparkSession
    placed = stage(places(stage(leaves, "leaves")).withColumnRenamed("leaf", "node"), "placed")
    rounds = _tree(placed)
    groups = rounds[-1].select("g", F.col("node").alias("top"))
    tops = stage(groups.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), F.lit(groups.count()).cast("bigint").alias("total"), F.col("top").alias("node")), "subroots")
    over = _tree(tops)
    root = over[-1].first()
    root = root.node if root else b""
    summit = spark.createDataFrame([(0, 0, bytes(root), [], [])], "g bigint, i bigint, top binary, lefts array<string>, rights array<string>")
    paths = _walk(over, summit, ["i", "node"])  # i: the group's number
    paths = paths.select(F.col("i").alias("g"), F.lit(0).cast("bigint").alias("i"), F.col("node").alias("top"), "lefts", "rights")
    paths = stage(paths, "paths")
    found = _walk(rounds, paths, ["id", "grp", "i", "node", "altered"])
    hexed = [F.lower(F.hex(c)).alias(name) for c, name in (("node", "leaf"), ("altered", "altered"), ("top", "subroot"))]
    return found.select("id", "grp", "i", *hexed, F.lit(bytes(root).hex()).alias("root"), "lefts", "rights")


def proof_digest(lefts: str = "lefts", rights: str = "rights") -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.zip_with(lefts, rights, lambda a, b: F.concat(a, b))).cast("binary"), 256)


def folded(leaf: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(F.arrays_zip(F.col(lefts).alias("a"), F.col(rights).alias("b")), leaf, lambda node, level: F.sha2(F.concat(level["a"], node, level["b"]).cast("binary"), 256))
