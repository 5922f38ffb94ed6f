"""SimHash near-dedup with deletion-variant signatures.

A pair of 64-bit fingerprints that differs in three bits at most differs by one bit at most in one of two
32-bit segments. Each distinct fingerprint is indexed under its segments with one bit deleted, 64 keys in
all; equal keys meet, pairs are verified on all 64 bits, and a pair counts only under the first key that
shows it, so no link is lost and none repeats. Large buckets yield a spanning forest of their links, not all
pairs; buckets beyond a limit stream on to a second index by the other segment's halves, where at most 2^18
distinct fingerprints can share a key.

Defined cases: null or blank text has fingerprint zero and links like any other; null doc_id sorts after all
ids; rows that repeat a doc_id have one fingerprint each, and neither a null nor a repeated doc_id links rows:
components are those of the fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import NO_ID, id_and_text, spread, stage, workers_import_us
from ledgerline.llm.components import min_labels

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints under one key that are compared in one go; beyond it the second index takes over.
BUCKET = 16384
#: Runs shorter than this are compared at all offsets at once, longer ones by a search for their forest.
SHORT = 32
_BLOCK = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """SimHash of UTF-8 text: over XXH64 of its word 3-shingles, a bit is set if it is in over half of them."""
    words = text.lower().split()  # on bytes: A-Z alone, and exactly [\x20\x09-\x0D]
    if not words:
        return 0
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), _BLOCK):
        h = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the unsigned fingerprint's 64 bits as a long."""
    workers_import_us(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1).cast(pa.binary())), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return spread(id_and_text(docs, id_col=id_col, text_col=text_col)).mapInArrow(sign, "doc_id long, fp long")


def _near(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether pairs that share key and differ by x are links, and key is the first that shows it."""
    low = x & _LOW
    high = x >> np.uint64(32)
    first = (key >> 31) & 31 == 0  # pairs whose segment is equal share all its keys; the first one counts
    return (np.bitwise_count(x) <= RADIUS) & np.where(key >> 36 == 0, (low != 0) | first, (np.bitwise_count(low) >= 2) & ((high != 0) | first))


def _forest(fps: np.ndarray, linked) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among fps: a node and the new nodes that it reaches, again and again."""
    while len(fps):
        found, fps = [fps[0]], fps[1:]
        while found and len(fps):
            node = found.pop()
            near = linked(node ^ fps)
            if near.any():
                yield node, fps[near]
                found.extend(fps[near])
                fps = fps[~near]


def links(key: np.ndarray, fps: np.ndarray, near=_near) -> tuple[np.ndarray, np.ndarray]:
    """Links among fps whose keys are equal, as two columns. key is sorted."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    some = np.repeat((sizes > 1) & (sizes < SHORT), sizes)
    k, f = key[some], fps[some]
    for d in range(1, SHORT):
        i = np.flatnonzero(k[d:] == k[:-d])
        if not len(i):
            break
        i = i[near(k[i], f[i] ^ f[i + d])]
        a.append(f[i])
        b.append(f[i + d])
    for at, n in zip(starts[sizes >= SHORT], sizes[sizes >= SHORT], strict=True):
        for node, found in _forest(np.unique(fps[at : at + n]), lambda x, at=at: near(key[at : at + 1], x)):
            a.append(np.full(len(found), node, np.uint64))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def _compare(limit: int | None, near=_near):
    """Over rows (key, fp) sorted by key: links as (a, b, -1), rows of keys with over limit fingerprints as (fp, 0, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key=None):
            columns = [x.view(np.int64) for x in (a, b)] + [np.full(len(a), -1) if key is None else key]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "key"])

        key, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), -1
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            n = int(np.searchsorted(key, over, "right")) if over >= 0 else 0
            if n:
                yield out(fps[:n], np.zeros(n, np.uint64), key[:n])
                key, fps = key[n:], fps[n:]
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if cut:
                yield out(*links(key[:cut], fps[:cut], near))
                key, fps = key[cut:], fps[cut:]
            if limit and len(key) > limit:
                over = int(key[0])
                yield out(fps, np.zeros(len(fps), np.uint64), key)
                key, fps = key[:0], fps[:0]
        if len(key):
            yield out(*links(key, fps, near))

    return run


def _without_bit(value: str, at: str) -> str:
    return f"(shiftleft(shiftrightunsigned({value}, {at} + 1), {at}) | ({value} & (shiftleft(1L, {at}) - 1)))"


def near_pairs(distinct: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links that connect all of distinct.fp (long, each once) that lie within RADIUS bits of each other."""
    workers_import_us(distinct.sparkSession)
    half = "(shiftrightunsigned(fp, 32 * segment) & 4294967295L)"
    keys = distinct.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("v")).selectExpr("fp", "v", "cast(v div 32 as int) segment", "v % 32 bit")
    keys = keys.selectExpr(f"shiftleft(cast(v as bigint), 31) | {_without_bit(half, 'bit')} key", "fp")
    found = stage(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(bucket), "a long, b long, key long"), "links")
    pairs, more = found.filter("key = -1").select("a", "b"), found.filter("key >= 0")
    if more.isEmpty():
        return pairs
    # Of the other segment, three bits differ at most: one of its halves differs by one at most.
    quarter = "(shiftrightunsigned(fp, 32 * (1 - segment) + 16 * part) & 65535L)"
    rows = more.select(F.col("a").alias("fp"), F.col("key").alias("outer"), F.explode(F.expr("sequence(0, 31)")).alias("v"))
    rows = rows.selectExpr("fp", "outer", "v", "cast(shiftright(outer, 36) as int) segment", "cast(v div 16 as int) part", "v % 16 bit")
    rows = rows.selectExpr("fp", f"shiftleft(cast(v as bigint), 15) | {_without_bit(quarter, 'bit')} inner", "outer")
    # outer has 37 bits, inner 20: together they fit one key.
    rows = rows.selectExpr("shiftleft(outer, 20) | inner key", "fp")
    within = lambda key, x: np.bitwise_count(x) <= RADIUS
    return pairs.unionByName(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(None, within), "a long, b long, key long").select("a", "b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id of each row: the smallest doc_id reachable over links of RADIUS bits at most."""
    signed = stage(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-signed")
    classes = stage(signed.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep")), "simhash-classes")
    labels = min_labels(stage(near_pairs(classes.select("fp"), bucket=bucket), "simhash-pairs"))
    labelled = stage(classes.join(labels, classes.fp == labels.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("root")), "simhash-roots")
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    return signed.join(stage(labelled.join(smallest, "root").select("fp", "component"), "simhash-labels"), "fp", "left").select("doc_id", "fp", F.nullif("component", F.lit(NO_ID)).alias("component_id"))


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
