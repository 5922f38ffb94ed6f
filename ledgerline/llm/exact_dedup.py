"""Exact dedup with counting quotient filters.

Every partition builds a counting quotient filter over its documents' 64-bit fingerprints. A filter is cut
into segments of quotients; filters of one segment meet in one task and merge by their sorted remainders,
adding counts, which loses nothing. Fingerprints that occur once are done. The documents of the others are
grouped by their normalised bytes themselves, so equal fingerprints of different texts stay apart.

A segment spans 2^14 quotients whatever the filter's size, and lists its occupied quotients in two bytes each where a
bitmap would take more; the number of segments follows the row count, so that one holds about 2^21 fingerprints of
the corpus. A filter takes under 16 bytes a fingerprint up to 10^10 rows, and goes out in batches of a few megabytes.
Candidates are picked by their fingerprints before their texts are sent: up to BROADCAST_ROWS repeated fingerprints, which
are counted first, are broadcast, so only candidates' texts move and copies collapse in each task; where there are more,
all texts move once by fingerprint and a salt of the id, so that a text that a third of all rows hold is dealt out.

Defined cases: null text is empty; null doc_id sorts after all ids; rows that repeat a doc_id and its text
are one document and share their decision; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, NO_ID, fresh, id_and_text, stage, workers_import_us

#: Fingerprints that a task gathers before it hands its filter on; later filters merge with it as any other.
FLUSH = 1 << 21
#: A segment spans 2^WIDTH_BITS quotients and holds about 2^SEGMENT_ROWS_BITS fingerprints of all rows.
WIDTH_BITS, SEGMENT_ROWS_BITS = 14, 21
#: Bytes of filters that a task hands on at once.
_BATCH_BYTES = 4 << 20
#: Repeated fingerprints that are broadcast at most, some 30 MB of them; more of them meet the texts by a shuffle.
BROADCAST_ROWS = 1 << 19
_SALTS = 8
_TENS = "100000000000000000000"  # above any 64-bit difference


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def encode_segment(fps: np.ndarray, counts: np.ndarray, segment_bits: int, quotient_bits: int) -> bytes:
    """A filter segment from its sorted distinct fingerprints: occupied quotients, run ends, counter flags, slots.

    A remainder that occurs more than once is followed by a slot that holds its count. Occupied quotients are a bitmap
    or, where that is shorter, a list.
    """
    width = 1 << (quotient_bits - segment_bits)
    r = np.uint64(64 - quotient_bits)
    quotients = (fps >> r).astype(np.int64) & (width - 1)
    last = np.append(quotients[1:] != quotients[:-1], True)
    occupied = quotients[last]
    listed = 16 * len(occupied) < width
    if listed:
        head = occupied.astype("<u2").tobytes()
    else:
        bits = np.zeros(width, bool)
        bits[occupied] = True
        head = np.packbits(bits).tobytes()
    at = np.arange(len(fps)) + np.append(0, np.cumsum(counts > 1)[:-1])
    slots = np.zeros(len(fps) + int((counts > 1).sum()), np.uint64)
    counter, ends = np.zeros(len(slots), bool), np.zeros(len(slots), bool)
    slots[at] = fps & ((np.uint64(1) << r) - np.uint64(1))
    slots[at[counts > 1] + 1] = counts[counts > 1].astype(np.uint64)
    counter[at[counts > 1] + 1] = True
    ends[at[last]] = True
    return np.array([len(slots), len(occupied) if listed else 0], "<u4").tobytes() + head + b"".join(np.packbits(x).tobytes() for x in (ends, counter)) + slots.tobytes()


def decode_segment(blob: bytes, segment: int, segment_bits: int, quotient_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts that encode_segment was given."""
    width = 1 << (quotient_bits - segment_bits)
    n, listed = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    cut = [8, 8 + (2 * listed or -(-width // 8))]
    cut += [cut[1] + -(-n // 8), cut[1] + 2 * -(-n // 8)]
    head = blob[cut[0] : cut[1]]
    occupied = np.frombuffer(head, "<u2").astype(np.int64) if listed else np.flatnonzero(np.unpackbits(np.frombuffer(head, np.uint8), count=width))
    ends = np.unpackbits(np.frombuffer(blob[cut[1] : cut[2]], np.uint8), count=n).astype(bool)
    counter = np.unpackbits(np.frombuffer(blob[cut[2] : cut[3]], np.uint8), count=n).astype(bool)
    slots = np.frombuffer(blob[cut[3] :], np.uint64)
    at = np.flatnonzero(~counter)
    run = np.cumsum(ends[at]) - ends[at]
    quotient = (np.uint64(segment) << np.uint64(quotient_bits - segment_bits)) | occupied[run].astype(np.uint64)
    counted = np.append(counter[1:], False)[at]
    counts = np.ones(len(at), np.int64)
    counts[counted] = slots[at[counted] + 1].astype(np.int64)
    return (quotient << np.uint64(64 - quotient_bits)) | slots[at], counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts of several segments as one: a merge of sorted runs, counts added."""
    fps, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(fps, kind="stable")
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1]))
    return fps[first], np.add.reduceat(counts, first)


def filter_bits(rows: int) -> tuple[int, int]:
    """Bits of a segment's number and of a quotient, for a corpus of so many rows."""
    segment_bits = min(40, max(6, math.ceil(math.log2(max(rows, 1))) - SEGMENT_ROWS_BITS))
    return segment_bits, segment_bits + WIDTH_BITS


def build_filter(fps: np.ndarray, segment_bits: int, quotient_bits: int) -> Iterator[tuple[int, bytes]]:
    """The segments of a filter over fps: number and content."""
    fps, counts = np.unique(fps, return_counts=True)
    segment = (fps >> np.uint64(64 - segment_bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(fps)], strict=True):
        yield int(segment[a]), encode_segment(fps[a:b], counts[a:b], segment_bits, quotient_bits)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """The values of the long column fp that occur more than once, with their counts n. rows: how many there are, to size the filter."""
    workers_import_us(fingerprints.sparkSession)
    s, q = filter_bits(rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["segment", "filter"])

        def filters() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for number, blob in build_filter(np.concatenate(held), s, q):
                out.append((number, blob))
                size += len(blob)
                if size >= _BATCH_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FLUSH:
                yield from filters()
                held.clear()
        if sum(map(len, held)):
            yield from filters()

    def join(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        fps, counts = merge([decode_segment(x.as_py(), segment, s, q) for x in table.column("filter")])
        return pa.table({"fp": fps[counts > 1].view(np.int64), "n": counts[counts > 1]})

    built = fingerprints.select("fp").mapInArrow(build, "segment long, filter binary")
    return built.groupBy("segment").applyInArrow(join, "fp long, n long")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are once all of [\\x20\\x09-\\x0D] is deleted; the row with the most code points
    in its original text stays, then the smallest doc_id.
    """
    base = id_and_text(docs, id_col=id_col, text_col=text_col)
    norm = normalised(F.col("text"))
    signed = stage(base.select("doc_id", F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("text_sha256")), "exact-signed")
    repeated = stage(repeated_fingerprints(signed, signed.count()), "exact-repeated").select("fp")

    # Candidates meet by their bytes. Both grouping steps combine within a task, so a hot text costs a row a task.
    rank = F.length("text").cast("decimal(10,0)") * F.lit(_TENS).cast("decimal(21,0)") + (F.lit(str(NO_ID)).cast("decimal(20,0)") - F.coalesce("doc_id", F.lit(NO_ID)).cast("decimal(20,0)"))
    texts = base.select("doc_id", F.xxhash64(norm).alias("fp"), norm.alias("norm"), rank.alias("rank"))
    if repeated.count() <= broadcast_rows:
        candidates = texts.join(F.broadcast(repeated), "fp", "left_semi")
    else:
        asked = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        candidates = texts.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(_SALTS))).join(asked.hint("shuffle_hash"), ["fp", "salt"], "left_semi")
    same = candidates.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("rank"))
    best = (F.lit(str(NO_ID)).cast("decimal(20,0)") - (F.col("rank") % F.lit(_TENS).cast("decimal(21,0)"))).cast("long")
    groups = same.filter("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), F.nullif(best, F.lit(NO_ID)).alias("keep_id"), "group_size")
    return signed.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of equal texts."""
    decided = stage(exact_groups(docs, id_col=id_col, text_col=text_col).select("doc_id", "kept", "text_sha256"), "exact-decided")
    own_id, own_sha = fresh(docs, "own_id", "own_sha")
    sha = F.sha2(normalised(F.coalesce(docs[text_col], F.lit(""))), 256)
    own = [F.col(own_id).eqNullSafe(docs[id_col].cast("long")), F.col(own_sha) == sha]
    named = lambda rows: rows.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    # The same plan at every size: decisions grow with the rows, so they are never broadcast; each text moves once.
    stay = docs.join(stage(named(decided.filter("not kept")), "exact-gone").hint("shuffle_hash"), own, "left_anti")
    # Rows that repeat an id and its text share their decision; of those that stay one is enough.
    again = stage(named(decided.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1")), "exact-again")
    if again.isEmpty():
        return stay
    one = docs.join(again, own, "left_semi").withColumn(own_sha, sha).dropDuplicates([id_col, own_sha]).drop(own_sha)
    return stay.join(again, own, "left_anti").unionByName(one)
