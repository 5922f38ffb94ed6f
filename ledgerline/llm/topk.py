"""Exact top-k search by inner product, column by column with branch and bound.

Candidates stay where they are; queries go to all of them a block at a time, by broadcast, and a block is bounded in
bytes. A task takes its candidates in batches that lie dimension by dimension. Scores are summed one block of
dimensions at a time; what the dimensions still to come can add is bounded by the product of the remaining norms, and
candidates whose upper bound falls below the best k-th score known are compacted away. That bound is the task's own
so far, and begins with the k-th best score among a first block of candidates that all queries meet beforehand. A task
hands on its best k of each query; these meet in one window per query.

So each vector is written once and read once a round; nothing is copied for each pair of blocks. The work itself is
queries times candidates, as asked.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no
part; missing dimensions of shorter vectors count as 0, and vectors are put in blocks and batches with others of
their length, so one of very many dimensions widens no others; rows that repeat a vec_id are candidates each, but
never for their own id; columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import stage, workers_import_us
from ledgerline.storage import shared_path

#: Numbers (8 bytes each) of a block of queries and of a batch of candidates, rows of a batch at most, dimensions summed at once.
QUERY_NUMBERS, CANDIDATE_NUMBERS, CANDIDATE_ROWS, DIMENSION_BLOCK = 1 << 21, 1 << 20, 8192, 16
_LONG = 2**63 - 1


def _columns(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as one row per dimension."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return np.ascontiguousarray(out.T)


def best(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, bounds: np.ndarray | None = None):
    """For each query: positions of its k best candidates and their scores. Both hold whole numbers, a row per dimension.

    bounds: for each query a score that k others have at least; candidates below it may be left out.
    """
    bounds = np.full(len(query_ids), -np.inf) if bounds is None else bounds
    top = max(np.abs(columns).max(initial=0), np.abs(queries).max(initial=0))
    if top * top * max(1, len(columns)) >= 2**53:  # beyond exact doubles: whole numbers of any size
        a, b = (np.frompyfunc(int, 1, 1)(x) for x in (queries, columns))
        for q, own in zip(a.T, query_ids, strict=True):
            scores = np.array([max(-_LONG, min(_LONG, int(x))) for x in (b * q[:, None]).sum(axis=0)], np.int64)
            at = np.flatnonzero(ids != own)
            yield _sorted(at, scores[at], ids, k)
        return
    energy = np.argsort(-(columns**2).sum(axis=1), kind="stable")  # dimensions that say most come first
    columns, queries = columns[energy], queries[energy]
    cuts = list(range(0, len(columns), DIMENSION_BLOCK))
    rest = [np.sqrt((columns[c + DIMENSION_BLOCK :] ** 2).sum(axis=0)) for c in cuts]
    for at in range(0, queries.shape[1], 256):
        part = queries[:, at : at + 256]
        first = part[:DIMENSION_BLOCK].T @ columns[:DIMENSION_BLOCK]
        for q, own, sums, bound in zip(part.T, query_ids[at : at + 256], first, bounds[at : at + 256], strict=True):
            left = np.flatnonzero(ids != own)
            sums = sums[left]
            for n, c in enumerate(cuts):
                if n:
                    sums = sums + q[c : c + DIMENSION_BLOCK] @ columns[c : c + DIMENSION_BLOCK, left]
                slack = rest[n][left] * (np.sqrt((q[c + DIMENSION_BLOCK :] ** 2).sum()) * (1 + 1e-9)) + 1e-6 * (n + 1 < len(cuts))
                if len(left) > k or bound > -np.inf:
                    least = max(bound, np.partition(sums - slack, len(left) - k)[len(left) - k] if len(left) > k else -np.inf)
                    stay = sums + slack >= least
                    left, sums = left[stay], sums[stay]
            yield _sorted(left, np.rint(sums).astype(np.int64), ids, k)


def _sorted(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[at], -scores))[:k]
    return at[order], scores[order]


def blocks(sizes: np.ndarray, numbers: int, rows: int) -> Iterator[np.ndarray]:
    """Positions of vectors of the given sizes, the short first, in blocks that are numbers large as rows of their longest one."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < rows and (to + 1 - at) * max(1, int(sizes[order[to]])) <= numbers:
            to += 1
        yield order[at:to]
        at = to


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> None:
        self.queries, self.query_ids, self.bounds, self.k = queries, query_ids, bounds.astype(float), k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]

    def take(self, columns: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, a row per dimension of the longer of them and the queries."""
        dims = max(len(columns), len(self.queries))
        wide = lambda x: np.vstack([x, np.zeros((dims - len(x), x.shape[1]))]) if len(x) < dims else x
        for n, (at, scores) in enumerate(best(wide(self.queries), self.query_ids, wide(columns), ids, self.k, self.bounds)):
            if len(at):
                both, sums = np.concatenate([self.held[n][0], ids[at]]), np.concatenate([self.held[n][1], scores])
                order, scores = _sorted(np.arange(len(both)), sums, both, self.k)
                self.held[n] = both[order], scores
                if len(scores) == self.k:
                    self.bounds[n] = max(self.bounds[n], float(scores[-1]) - (abs(float(scores[-1])) * 1e-12 if abs(scores[-1]) >= 2**53 else 0))

    def batch(self) -> pa.RecordBatch:
        sizes = [len(a) for a, _ in self.held]
        join = lambda i: np.concatenate([np.zeros(0, np.int64), *(h[i] for h in self.held)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.query_ids, sizes)), pa.array(join(0)), pa.array(join(1))], ["query_id", "vec_id", "score"])


def _search(vectors: DataFrame, block, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each task for each query of the broadcast block (ids, vectors, bounds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, bounds = block.value
        found = Best(queries, query_ids, bounds, k)
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            for at in blocks(np.diff(lists.offsets.to_numpy()), CANDIDATE_NUMBERS, CANDIDATE_ROWS):
                part = lists.take(pa.array(at))
                found.take(_floored(part, scale), ids[at])
        yield found.batch()

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def _floored(lists: pa.ListArray, scale: int) -> np.ndarray:
    return np.floor(scale * _columns(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0))))


def top_k(vectors: DataFrame, *, k: int = 20, query_every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", query_numbers: int = QUERY_NUMBERS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner products of floor(scale * x).

    Queries are the rows whose id is divisible by query_every, candidates all rows but the query's own; ties
    go to the smaller vec_id. query_numbers: components of a block of queries, which the driver holds one at a time.
    """
    spark = vectors.sparkSession
    workers_import_us(spark)
    given = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    held = stage(given.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "vectors")
    # Queries of one length class are numbered; a block is a range of their numbers.
    asking = held.filter(F.col("vec_id") % query_every == 0).withColumn("width", F.greatest(F.ceil(F.log2(F.size("v") + 1)), F.lit(0)).cast("int"))
    rows = {r.width: max(1, query_numbers >> r.width) for r in asking.select("width").distinct().collect()}  # 32 rows at most
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = F.create_map(*[F.lit(x) for pair in rows.items() for x in pair])[F.col("width")]
    # Blocks are dealt by hash: as many as hold rows on average, told apart further where one has come out larger.
    counts = {r.width: r.n for r in asking.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for w, n in counts.items() for x in (w, -(-n // rows[w]))])[F.col("width")]
    dealt = asking.select("width", F.pmod(F.xxhash64("vec_id"), parts).cast("long").alias("part"), "vec_id", "v", size.alias("rows"))
    within = F.row_number().over(W.partitionBy("width", "part").orderBy("vec_id")) - 1
    dealt = stage(dealt.withColumn("more", (within / F.col("rows")).cast("long")).drop("rows").repartitionByRange("width", "part", "more").sortWithinPartitions("width", "part", "more"), "top-k-queries")
    first = held.limit(CANDIDATE_ROWS).filter(F.size("v") <= CANDIDATE_NUMBERS // CANDIDATE_ROWS).coalesce(1)
    first = stage(first, "top-k-first")
    out = shared_path(spark, "top-k-found")
    for n, key in enumerate(dealt.select("width", "part", "more").distinct().orderBy("width", "part", "more").toLocalIterator()):
        block = dealt.filter((F.col("width") == key.width) & (F.col("part") == key.part) & (F.col("more") == key.more)).select("vec_id", "v").toArrow().combine_chunks()
        ids, queries = block.column("vec_id").to_numpy(), _floored(block.column("v").chunk(0), scale)
        sent = spark.sparkContext.broadcast((ids, queries, np.full(len(ids), -np.inf)))
        beforehand = _search(first, sent, k, scale).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect()  # a row a query of the block
        sent.unpersist()
        least = {r.query_id: float(r.least) for r in beforehand}
        sent = spark.sparkContext.broadcast((ids, queries, np.array([least.get(i, -np.inf) for i in ids.tolist()])))
        _search(held, sent, k, scale).write.parquet(f"{out}/block={n}")
        sent.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
