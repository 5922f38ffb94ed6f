"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends the tree by draws of its id: at each level every child has the clock -ln(u) / weight, u in (0, 1) from
an MD5 of id and child, and the child whose clock is first takes the row. A node weighs what its shards weigh
together, so a shard gets its share of all weight. A clock depends on the row, the child and the child's weight alone:
where weights change, rows move into subtrees that gained weight or out of those that lost some, and no others change
places. `grow` adds a shard as a region of its own; the clocks of the others stay, so rows move into the new one alone.
(A shard added within a rack also moves rows between the racks and shards of the region that gained.)

The draws need no shuffle: the tree, whose size is the number of shards, is held by every task. Slots come from one
range partitioning by shard and id: places in each range are counted there, and a table of one row a range and shard
carries the counts on. Neither a shard nor rows that share an id are gathered in one task: a row's number breaks ties.

The law is that of `key`: id and tree decide. What a row's text or its copies are does not matter, so equal texts go
where their ids send them. Defined cases: null ids draw as the word null and stay in one shard; rows that repeat an id
share their shard and have a slot each; null text has no bytes, size 1 and CRC 0; columns other than the two named are
ignored by `shard_slots` and kept by `place`; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import NO_ID, fresh, stage
from ledgerline.storage import shared_path


class Shard(NamedTuple):
    region: int
    rack: int  # numbered within its region
    shard: int  # numbered over the whole tree
    weight: float = 1.0


def layout(shards: int, *, regions: int = 2, racks: int = 2) -> list[Shard]:
    """A tree of that many shards of equal weight, dealt over regions and racks in runs."""
    return [Shard(i * regions // shards, i * regions * racks // shards % racks, i) for i in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """tree and one more shard, a region of its own."""
    return [*tree, Shard(1 + max((s.region for s in tree), default=-1), 0, 1 + max((s.shard for s in tree), default=-1), weight)]


def _levels(tree: list[Shard]) -> list[dict[tuple[int, ...], dict[int, float]]]:
    """For each level the children of its nodes with their weights; a node is its path from the root."""
    if len({s.shard for s in tree}) < len(tree):
        raise ValueError("a shard stands in the tree once")
    levels: list[dict[tuple[int, ...], dict[int, float]]] = [{}, {}, {}]
    for s in tree:
        if s.weight < 0:
            raise ValueError(f"shard {s.shard} weighs less than nothing")
        for k, child in enumerate((s.region, s.rack, s.shard)):
            below = levels[k].setdefault((s.region, s.rack)[:k], {})
            below[child] = below.get(child, 0.0) + s.weight
    levels = [{node: {c: w for c, w in below.items() if w > 0} for node, below in level.items()} for level in levels]
    if not levels[0].get(()):
        raise ValueError("no shard of the tree has weight")
    return levels


def _first(children: Column, key: Column) -> Column:
    """The child whose clock is first; of equal clocks the smaller number."""
    # 52 bits of the digest are exact in a double and never 0 or 1 with a half added.
    u = lambda c: (F.conv(F.substring(F.md5(F.concat_ws("/", key, c["name"]).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    clocks = F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("clock"), c["child"].alias("child")))
    return F.array_min(clocks)["child"]


def place(docs: DataFrame, tree: list[Shard], *, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """docs with the shard of each row as a column shard_col (int), in place of one of that name."""
    spark = docs.sparkSession
    key, region, rack, below, drawn = fresh(docs, "_key", "_region", "_rack", "_below", "_shard")
    done = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    for level, (nodes, found) in enumerate(zip(_levels(tree), (region, rack, drawn), strict=True)):
        path = [region, rack][:level]
        rows = [(*node, [("/".join(map(str, (*node, c))), c, w) for c, w in sorted(children.items())]) for node, children in nodes.items() if children]
        table = spark.createDataFrame(rows, ", ".join([*(f"`{p}` int" for p in path), f"`{below}` array<struct<name: string, child: int, weight: double>>"]))
        # As many rows as the level has nodes.
        done = done.join(F.broadcast(table), path) if path else done.crossJoin(F.broadcast(table))
        done = done.withColumn(found, _first(F.col(below), F.col(key))).drop(below)
    return done.select(*[f"`{c}`" for c in docs.columns if c.lower() != shard_col.lower()], F.col(drawn).alias(shard_col))


def shard_slots(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, shard, slot and, where a grown tree is given, grown_shard of each row.

    Slots number the rows of a shard from 0 by id (null last), size and CRC.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = place(rows, tree)
    rows = place(rows, grown, shard_col="grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    order = ["shard", F.coalesce("doc_id", F.lit(NO_ID)), F.col("doc_id").isNull(), "size", "text_crc32", "tie"]
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # The number of a range stands above bit 33, the place within it below; a shard's rows are one run of each range.
    at = stage(at.withColumn("part", F.shiftright("at", 33)), "shard-order")
    runs = at.groupBy("shard", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "part", (F.col("begin") - before).alias("shift"))
    return at.join(runs, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: list[Shard], path: str | None = None, *, id_col: str = "doc_id") -> str:
    """Write docs as Parquet, a folder shard=... for each shard, and return where. Every task writes its rows of a shard itself: no shuffle."""
    path = path or shared_path(docs.sparkSession, "shards")
    place(docs, tree, id_col=id_col).write.partitionBy("shard").parquet(path)
    return path
