"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a dozen statistics, put on log or root scales. Counts, sums and sums of products of the
labelled rows are added up by class in Spark over all of them; the driver sees two small matrices. Each
class covariance is shrunk towards a multiple of the identity and kept as the inverse of its Cholesky factor,
so a log density costs one triangular product. The score is the logistic function of the log-density
difference, over the number of statistics so that it does not saturate.

Defined cases: null or empty text has the statistics of no characters; labels without doc_id or quality are
left out, the larger of repeated labels counts; with one class alone every score is that class, with no
labels 0.5; rows that repeat a doc_id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import id_and_text, spread, stage, workers_import_us

SHRINKAGE = 0.1
STATISTICS = ("word_length", "upper", "digits", "symbols", "bars", "shouts", "stops", "breaks", "same_as_before", "variety", "repeated_lines", "commonest", "beyond_ascii")
#: A short text says little: shares are taken as if so many characters or words of ordinary text came with it.
PRIOR_CHARS, PRIOR_WORDS = 120, 25
_D = len(STATISTICS)


def _bytes(of: str) -> np.ndarray:
    return np.frombuffer(of.encode(), np.uint8)


_UPPER, _LOWER, _DIGITS, _SYMBOLS = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789"), _bytes("#$%&*+/<=>@\\^_`~{}[]")


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    upper, beyond = count[_UPPER].sum(), count[128:].sum()
    each = Counter(words)

    def share(part: float, whole: float, usual: float, weight: float = PRIOR_CHARS) -> float:
        return np.log((part + weight * usual) / (whole + weight) + 1e-3)

    return [
        np.log((sum(map(len, words)) + 5 * PRIOR_WORDS) / (len(words) + PRIOR_WORDS)), share(upper, upper + count[_LOWER].sum() + beyond, 0.02),
        share(count[_DIGITS].sum(), len(raw), 0.005), share(count[_SYMBOLS].sum(), len(raw), 0.001), share(count[ord("|")], len(raw), 0), share(count[ord("!")], len(raw), 0),
        share(count[ord(".")] + count[ord(",")], len(raw), 0.025), share(len(lines) - 1, len(raw), 0.003), share(sum(map(eq, words, words[1:])), len(words), 0.005, PRIOR_WORDS),
        np.log1p(len(each) + PRIOR_WORDS) / np.log1p(len(words) + PRIOR_WORDS), share(len(lines) - len(set(lines)), len(lines), 0.02, 10),
        share(max(each.values(), default=0), len(words), 0.06, PRIOR_WORDS), share(beyond, len(raw), 0.02),
    ]


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor of the covariance, its log determinant with the log prior."""

    mean: np.ndarray
    inverse: np.ndarray
    offset: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of statistics: 0 to 1, higher for class 1."""
        if len(self.offset) == 1:
            return np.full(len(x), float(self.offset[0]))
        z = [(((x - m) @ i.T) ** 2).sum(axis=1) for m, i in zip(self.mean, self.inverse, strict=True)]
        logit = (self.offset[1] - z[1] / 2) - (self.offset[0] - z[0] / 2)
        return 1 / (1 + np.exp(-np.clip(logit / _D, -500, 500)))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)


def statistics_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row."""
    workers_import_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return spread(id_and_text(docs, id_col=id_col, text_col=text_col)).mapInArrow(run, "doc_id long, x array<double>")


def fit(table: DataFrame, labels: DataFrame, *, shrinkage: float = SHRINKAGE) -> Model:
    """From a statistics table and (doc_id, quality) of the rows to learn from, all of which count."""
    labels = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _vectors(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(y):
                own = np.column_stack([np.ones((y == c).sum()), x[y == c]])
                flat = (own.T @ own).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["quality", "cell", "total"])

    rows = table.join(labels, "doc_id").select("quality", "x").mapInArrow(moments, "quality int, cell int, total double")
    sums: dict[int, np.ndarray] = {}
    for r in rows.groupBy("quality", "cell").agg(F.sum("total").alias("total")).collect():  # (_D + 1)^2 numbers a class
        sums.setdefault(1 if r.quality else 0, np.zeros((_D + 1) ** 2))[r.cell] += r.total
    if len(sums) < 2:
        return Model(np.zeros((1, _D)), np.zeros((1, _D, _D)), np.array([float(next(iter(sums), 0.5))]))
    moments2 = {c: s.reshape(_D + 1, _D + 1) for c, s in sums.items()}
    pooled = moments2[0] + moments2[1]
    mean = pooled[0, 1:] / pooled[0, 0]
    scale = 1 / np.sqrt(np.maximum(np.diag(pooled)[1:] / pooled[0, 0] - mean**2, 1e-9))  # shrink on a common scale
    means, inverses, offsets = [], [], []
    for c in (0, 1):
        m = moments2[c]
        n, mu = m[0, 0], m[0, 1:] / m[0, 0]
        cov = (m[1:, 1:] / n - np.outer(mu, mu)) * np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / _D, 1e-6) * np.eye(_D)
        factor = np.linalg.cholesky(cov)
        means.append(mu)
        inverses.append(np.linalg.inv(factor) * scale)
        offsets.append(np.log(n / pooled[0, 0]) - np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(inverses), np.array(offsets))


def fold(doc_id, folds: int):
    """crc32 of doc_id as text modulo folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shrinkage: float = SHRINKAGE, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; learnt from labelled rows outside the held-out fold."""
    table = stage(statistics_table(docs, id_col=id_col, text_col=text_col), "quality-statistics")
    model = fit(table, labels.filter(fold(F.col("doc_id"), folds) != held_out_fold), shrinkage=shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_vectors(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shrinkage: float = SHRINKAGE, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more. Texts are scored where they lie, without a shuffle."""
    table = statistics_table(docs, id_col=id_col, text_col=text_col)
    labelled = labels.filter(fold(F.col("doc_id"), folds) != held_out_fold)
    model = fit(table, labelled, shrinkage=shrinkage)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array([statistics(t.as_py()) for t in text]).reshape(-1, _D)))

    return docs.filter(score(F.coalesce(docs[text_col], F.lit(""))) >= 0.5)
