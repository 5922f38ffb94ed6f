"""Chat formatting over a prefix tree.

Conversations that share their initial turns share those turns' nodes. Nodes are laid out once, depth first: the
different conversations are sorted by their paths, the hashes of their turns in a row, and a node belongs to the
first conversation that runs through it. What belongs to one conversation is the rest of its path, so it is one
run of the stream, and the runs in the order of the paths are the depth-first order, however deep. A node carries
its position (characters from its root down to it, so position ids restart where branches do), the stream
intervals of its ancestors that it attends to, and the interval under the loss mask.

Only the turns' numbers and hashes are sorted and joined; their texts meet the finished layout in one join by
conversation. Turns that very many conversations share (at most a thousand nodes, each with a thousandth of all
turns) are looked up in a broadcast table, so no key of a join is hot.

Template: `<turn ROLE>\\nTEXT\\n</turn>\\n`, with a backslash before each of `\\ < >` in ROLE and TEXT, so no text
can hold a template string and unescaping gives it back.

Defined cases: null text and null role are empty; turns of a conversation are ordered by turn (null first),
then role, then text, so ties and repeated rows have one order; a null conv_id is one conversation; columns other
than conv_id, turn, role and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import NO_ID, stage, workers_import_us

LEARNT_ROLE = "assistant"
#: Nodes that hold this share of all turns are looked up in a broadcast table, which has so many rows at most.
_HOT_SHARE = 1000
_ESCAPED = re.compile(r"([\\<>])")
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)\n</turn>\n", re.DOTALL)
_TURNS = "conv_id long, depth int, node binary, parent binary, position long, path binary, role string, content string"


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its content begins and ends in it."""
    head, content = f"<turn {escape(role)}>\n", escape(text)
    return f"{head}{content}\n</turn>\n", len(head), len(head) + len(content)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def turn_rows(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id (null as NO_ID), depth from 1, node (a hash of all turns down to it), parent, position, role and formatted content.

    path, of a conversation's last turn alone: eight bytes of each turn's node.
    """
    workers_import_us(conversations.sparkSession)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    names, types = [c.split()[0] for c in _TURNS.split(", ")], (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.string())

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)
        conv_held, node, path, position, held = None, b"", bytearray(), 0, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != conv_held:
                    if held:
                        out.append((*held[:5], bytes(path), *held[6:]))
                    conv_held, node, path, position = conv, b"", bytearray(), 0
                elif held:
                    out.append(held)
                parent = node
                node = hashlib.blake2b(parent + f"\x1f{len(role)}\x1f{role}{text}".encode("utf-8", "replace"), digest_size=16).digest()
                path += node[:8]
                content, _, _ = formatted(role, text)
                held = (conv, len(path) // 8, node, parent, position, None, role, content)
                position += len(content)
            yield batch_of(out)
        if held:
            yield batch_of([(*held[:5], bytes(path), *held[6:])])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(chain, _TURNS)


def _running(rows: DataFrame, length: str) -> DataFrame:
    """(rank, begins): sums of the column length of all rows of a smaller rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            within = []
            for n in batch.column(1).to_pylist():
                within.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(within, pa.int64()), batch.column(1), pa.array([part] * len(batch), pa.int32())], ["rank", "within", "length", "part"])

    ordered = rows.select("rank", F.col(length).cast("long").alias("length")).repartitionByRange("rank").sortWithinPartitions("rank")
    placed = stage(ordered.mapInArrow(run, "rank long, within long, length long, part int"), "chat-stream")
    ends = placed.groupBy("part").agg(F.max(F.col("within") + F.col("length")).alias("end"))  # a row a partition
    before = ends.select("part", (F.sum("end").over(W.orderBy("part")) - F.col("end")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("rank", (F.col("within") + F.col("before")).alias("begins"))


def layout(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of staged turns: runs (a row per different conversation) and shared (a row per turn that is in another one's run).

    runs: conv_id (the smallest of equal conversations), leaf, rank (of its path), first_depth, begins and position of
    its first own turn, and segments: the stream intervals of the turns above that, joined where they touch.
    shared: conv_id, depth, node, begins, ends.
    """
    ends = turns.filter("path is not null").groupBy(F.col("node").alias("leaf")).agg(F.min("conv_id").alias("conv_id"), F.first("path").alias("path"))
    ranked = stage(ends.repartitionByRange("path").sortWithinPartitions("path").select("leaf", "conv_id", F.monotonically_increasing_id().alias("rank")), "chat-ranked")
    steps = turns.select("conv_id", "depth", "node", "position", F.length("content").cast("long").alias("length")).join(ranked.select("conv_id", "rank"), "conv_id")
    steps = stage(steps, "chat-steps")
    nodes = stage(steps.groupBy("node").agg(F.min("rank").alias("owner"), F.count(F.lit(1)).alias("n"), F.first("depth").alias("depth"), F.first("position").alias("position"), F.first("length").alias("length")), "chat-nodes")
    own = stage(nodes.groupBy(F.col("owner").alias("rank")).agg(F.min("depth").alias("first_depth"), F.sum("length").alias("length"), F.min("position").alias("position")), "chat-own")
    runs = stage(own.join(_running(own, "length"), "rank").join(ranked, "rank").select("conv_id", "leaf", "rank", "first_depth", "begins", "position"), "chat-runs")

    # Where the turns are that are in another conversation's run: first those of the few nodes that very many share.
    total = steps.count()
    at = F.col("o.begins") + F.col("n.position") - F.col("o.position")
    places = nodes.filter("n > 1").alias("n").join(runs.alias("o"), F.col("n.owner") == F.col("o.rank")).select("n.node", "n.n", "n.owner", at.alias("begins"), (at + F.col("n.length")).alias("ends"))
    places = stage(places, "chat-places")
    is_hot = F.col("n") * _HOT_SHARE > total
    found = lambda rows, table: rows.join(table, "node").filter("rank <> owner").select("rank", "conv_id", "depth", "node", "begins", "ends")
    hot = places.filter(is_hot).drop("n")  # the n of all nodes add up to total: under _HOT_SHARE rows
    left = steps.join(F.broadcast(hot.select("node")), "node", "left_anti")
    shared = found(steps, F.broadcast(hot)).unionByName(found(left, places.filter(~is_hot).drop("n")))
    shared = stage(shared, "chat-shared")

    # A row where a segment begins, with the end of the one before: a conversation's turns stream by, only its segments are gathered.
    order = W.partitionBy("rank").orderBy("depth")
    cuts = shared.select("rank", "depth", "begins", "ends", F.lag("ends").over(order).alias("before"))
    cuts = cuts.withColumn("segment", F.sum(F.when(F.col("begins").eqNullSafe(F.col("before")), 0).otherwise(1)).over(order))
    pieces = cuts.groupBy("rank", "segment").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"))
    segments = pieces.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("segment", "begins", "ends"))).alias("segments"))
    segments = segments.select("rank", F.expr("transform(segments, x -> named_struct('begins', x.begins, 'ends', x.ends))").alias("segments"))
    runs = runs.join(segments, "rank", "left").withColumn("segments", F.coalesce("segments", F.expr("cast(array() as array<struct<begins: bigint, ends: bigint>>)")))
    return stage(runs, "chat-laid-out"), shared.drop("rank")


def tree_of(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """A row per node: conv_id (whose run it is in), node, parent, depth, role, content, begins, length, position, attends_to, loss."""
    rows = turns.drop("path").join(runs.select("conv_id", "first_depth", F.col("begins").alias("run_begins"), F.col("position").alias("run_position"), "segments"), "conv_id").filter("depth >= first_depth")
    rows = rows.withColumn("begins", F.col("run_begins") + F.col("position") - F.col("run_position")).withColumn("length", F.length("content").cast("long"))
    # The turns of the own run above a node touch each other, and the segment before where that ends.
    joined = (
        "if(depth = first_depth, segments, if(size(segments) > 0 and element_at(segments, -1).ends = run_begins,"
        " concat(slice(segments, 1, size(segments) - 1), array(named_struct('begins', element_at(segments, -1).begins, 'ends', begins))),"
        " concat(segments, array(named_struct('begins', run_begins, 'ends', begins)))))"
    )
    head = F.length(F.regexp_extract("content", r"(?s)\A(<turn (?:[^\\<>]|\\.)*>\n)", 1))
    loss = F.when(F.col("role") == LEARNT_ROLE, F.struct((F.col("begins") + head).alias("begins"), (F.col("begins") + F.col("length") - len("\n</turn>\n")).alias("ends")))
    return rows.select("conv_id", "node", "parent", "depth", "role", "content", "begins", "length", "position", F.expr(joined).alias("attends_to"), loss.alias("loss"))


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """The prefix tree of conversations (conv_id, turn, role, text), a row per node.

    node, parent, depth, role, content; begins and length in the stream; position; attends_to: the stream intervals of
    its ancestors, joined where they touch; loss: the interval of the stream to learn from, null for other roles;
    conv_id: the smallest of the conversations that are laid out first through it.
    """
    turns = stage(turn_rows(conversations), "chat-turns")
    return tree_of(turns, layout(turns)[0]).withColumn("conv_id", F.nullif("conv_id", F.lit(NO_ID)))


def read_back(tree: DataFrame, runs: DataFrame, shared: DataFrame) -> DataFrame:
    """(leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each different conversation.

    Everything is read from what the tree emits: the nodes that a conversation's last one attends to and those of its
    own run, their content and their loss intervals, put together by their place in the stream.
    """
    parts = tree.select("conv_id", "depth", "node", "begins", "content", (F.col("loss.begins") - F.col("begins")).alias("a"), (F.col("loss.ends") - F.col("begins")).alias("b"))
    others = shared.select("conv_id", "depth", "node").join(parts.drop("conv_id", "depth", "begins"), "node")
    steps = parts.drop("begins").unionByName(others).select("conv_id", "depth", "content", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chars, learnt = None, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        types, names = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)
        for batch in batches:
            out = []
            for conv, content, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if conv != held:
                    if n:
                        out.append((held, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
                    held, n, chars, learnt, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(content):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    n += 1
                if a is not None:
                    text = unescape(content[a:b])
                    loss.update(text.encode("utf-8", "replace"))
                    learnt += len(text)
                chars += len(content)
            yield batch_of(out)
        if n:
            yield batch_of([(held, n, turns.hexdigest(), learnt, loss.hexdigest(), chars)])

    read = steps.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.join(runs.select("conv_id", "leaf"), "conv_id").drop("conv_id")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id with the columns of read_back for each conversation. Equal conversations are read back once."""
    turns = stage(turn_rows(conversations), "chat-turns")
    runs, shared = layout(turns)
    tree = stage(tree_of(turns, runs), "chat-tree")
    read = stage(read_back(tree, runs, shared), "chat-read")
    ends = turns.filter("path is not null").select(F.nullif("conv_id", F.lit(NO_ID)).alias("conv_id"), F.col("node").alias("leaf"))
    return ends.join(read, "leaf").drop("leaf")
