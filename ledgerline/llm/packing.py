"""Best-fit packing planned on the histogram of lengths.

Texts are tokenized and cut into pieces. The plan is made from how many pieces have each length (at most
max_tokens numbers, whatever the corpus): best fit, longest first, where all open sequences with the same
room left are one group. Each group that takes pieces becomes one line of the plan, a range of ranks within
a length. Pieces get their rank within their length and take the slot that the plan has for it.

Ranks need no task to see all pieces of a length: pieces are counted by length and bucket of doc_id, the
buckets' running sums are added to ranks within a bucket.

Defined cases: null or empty text is the end id alone; rows that repeat a doc_id are packed each for itself
(pieces are then told apart by row); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm import chunks, word_tokens
from ledgerline.llm.common import fresh, id_and_text, spread, stage, workers_import_us

MAX_TOKENS, END_ID = 4096, 1
_PLAN = "plan_length int, first_rank long, last_rank long, first_sequence long, each int, base int"


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: the first row, all ids one after another, and where each row's ids end."""
    table = word_tokens.table(path)
    for at, to in chunks.slices(texts):
        words, numbers, offsets = chunks.cut(pc.replace_substring(texts.slice(at, to - at), "\n", " "))
        parts, two = word_tokens.parts(words)
        rows = table.look_up(parts)[two]
        sizes = np.add.reduceat(table.size[rows].sum(axis=1)[numbers], offsets[:-1])
        ends, rows = np.cumsum(sizes), rows[numbers].ravel()
        yield at, np.insert(table.gather(rows[table.size[rows] > 0]), ends, end_id), ends + np.arange(1, to - at + 1)


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of max_tokens ids of each text."""
    workers_import_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, ends in token_ids(batch.column(1), path, end_id):
                sizes = np.diff(ends, prepend=0)
                n = -(-sizes // max_tokens)
                row = np.repeat(np.arange(len(ends)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_tokens
                length = np.minimum(sizes[row] - start, max_tokens)
                raw, first = ids.astype("<u4").tobytes(), (ends - sizes)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(id_and_text(docs, id_col=id_col, text_col=text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts by length.

    Each line (length, first rank, last rank, first sequence, pieces in each sequence, offset of the first in
    it) sends consecutive ranks to consecutive sequences. A group of open sequences with the same room is
    (first, number); what is in them is contiguous from 0, so room alone says where the next piece goes.
    """
    open_by_room: dict[int, list[tuple[int, int]]] = {}
    lines, sequences = [], 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            open_by_room.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = sorted((r for r in open_by_room if r >= length), reverse=True)
        while left:
            if fits and not open_by_room.get(fits[-1]):
                open_by_room.pop(fits.pop(), None)
                continue
            if fits:
                room = fits[-1]
                first, number = open_by_room[room].pop()
            else:
                room, first = max_tokens, sequences
                number = -(-left // (max_tokens // length))
                sequences += number
            each = room // length
            full, rest = divmod(min(left, number * each), each)
            taken = full * each + rest
            lines.append((length, rank, rank + taken - 1, first, each, max_tokens - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), number - full - bool(rest))
            rank, left = rank + taken, left - taken
    return lines


def pack(cut: DataFrame, *, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """sequence_id and offset for each row of cut, which has doc_id, piece and length; other columns stay, whatever their names.

    Columns of cut that are called sequence_id or offset are replaced.
    """
    spark, columns = cut.sparkSession, [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket, rank, before, *names = fresh(cut, "_bucket", "_rank", "_before", "_length", "_first", "_last", "_sequence", "_each", "_base")
    sequence = names[3]
    length, first, last, _, each, base = map(F.col, names)
    cut = stage(cut.select(*[f"`{c}`" for c in columns]).withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pack-pieces")
    counted = stage(cut.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    lines = spark.createDataFrame(plan(histogram, max_tokens), _PLAN).toDF(*names)

    sums = counted.select("length", bucket, (F.sum("n").over(W.partitionBy("length").orderBy(bucket)) - F.col("n")).alias(before))
    ranked = cut.withColumn(rank, F.row_number().over(W.partitionBy("length", bucket).orderBy(*[c for c in ("doc_id", "piece", "ids_crc32") if c in columns])) - 1)
    ranked = ranked.join(sums, ["length", bucket]).withColumn(rank, F.col(rank) + F.col(before))
    # A line either ends its length (and opens three groups at most) or uses a group up, whose room then falls by
    # half or more: under 12 * 3 * max_tokens lines of 36 bytes, 6 MB, whatever the input.
    placed = ranked.join(F.broadcast(lines), (F.col("length") == length) & F.col(rank).between(first, last))
    place = base + ((F.col(rank) - first) % each) * F.col("length")
    return placed.select(*[f"`{c}`" for c in columns], F.expr(f"`{sequence}` + (`{rank}` - `{names[1]}`) div `{names[4]}`").alias("sequence_id"), place.alias("offset"))


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each text."""
    cut = pieces(docs, path, id_col=id_col, text_col=text_col, max_tokens=max_tokens, end_id=end_id)
    return pack(cut, max_tokens=max_tokens).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
