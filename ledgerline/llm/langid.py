"""Language identification with segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A word's probability is the sum
over all its segmentations into pieces, by a forward algorithm; no piece crosses a white-space marker, so a
text's log probability is the sum over its marked words, and a word is scored once for each distinct word a
worker meets. Between two characters that stand side by side in no piece every segmentation has a cut, so the sum
over a word is the product of the sums over the parts between such places: exact, and what keeps text without
blanks short. Parts of any length are summed whole; beyond 32 characters in logarithms, as probabilities would vanish. Probabilities are learnt by expectation maximisation over all segmentations of the words of a
bounded sample of training rows; the sums are added up in Spark, one number per language and piece.

Defined cases: null text and text without a letter get 'und' and score 0; with no training rows every text
does; characters outside the vocabulary weigh alike in all languages; rows that repeat a doc_id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import chunks
from ledgerline.llm.common import spread, stage, workers_import_us
from ledgerline.llm.quality import fold

MARK = "▁"
#: Training rows that are taken for a language, about; all of them where there are fewer.
TRAINING_ROWS = 1000
ROUNDS, SMOOTHING = 3, 0.1
SHORT, FLOOR = 32, 1e-7
_EDGES = " \t\r\x0b\x0c.,;:!?|%&$*#\"'()[]{}<>=+-/\\_~`^@"
UNKNOWN = "und"


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the marker in front."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({p for i in range(sp.get_piece_size()) if re.fullmatch(f"{MARK}?[^\\W\\d_]*", p := sp.id_to_piece(i)) and p == p.lower() and p})


class Lattice:
    """All segmentations of words into pieces; probabilities are a row per piece and a column per language."""

    def __init__(self, pieces: list[str]) -> None:
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def parts(self, word: str) -> list[str]:
        """The marked word, cut where no piece can span."""
        whole, found, at = MARK + word, [], 0
        for i in range(1, len(whole)):
            if whole[i - 1 : i + 1] not in self.beside:
                found.append(whole[at:i])
                at = i
        return [*found, whole[at:]]

    def _by_part(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct parts of words, and for each occurrence its word and its part."""
        number: dict[str, int] = {}
        cut = [self.parts(w) for w in words]
        numbers = [number.setdefault(p, len(number)) for ps in cut for p in ps]
        return list(number), np.repeat(np.arange(len(words)), [len(ps) for ps in cut]), np.array(numbers, np.int64)

    def spans(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Of words of one length: the piece at each span, -1 where there is none."""
        get, n = self.number.get, len(words[0])
        return {(i, j): np.array([get(w[i:j], -1) for w in words]) for i in range(n) for j in range(i + 1, min(n, i + self.longest) + 1)}

    @staticmethod
    def chances(spans: dict, probs: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        found = {}
        for (i, j), p in spans.items():
            if j == i + 1 or (p >= 0).any():
                found[i, j] = np.where((p >= 0)[:, None], probs[p], FLOOR if j == i + 1 else 0.0)
        return found

    @staticmethod
    def forward(chances: dict, n: int, rows: int, k: int) -> list[np.ndarray]:
        alpha = [np.ones((rows, k))] + [np.zeros((rows, k)) for _ in range(n)]
        for (i, j), p in sorted(chances.items(), key=lambda x: x[0][1]):
            alpha[j] += alpha[i] * p
        return alpha

    def _ending(self, part: str) -> Iterator[tuple[int, list[int], list[int]]]:
        """For each place in part: where the pieces that end there begin, and their numbers; -1 for a character that is none."""
        get = self.number.get
        for j in range(1, len(part) + 1):
            found = [(i, p) for i in range(max(0, j - self.longest), j) if (p := get(part[i:j], -1 if i == j - 1 else None)) is not None]
            yield j, [i for i, _ in found], [p for _, p in found]

    def _logs(self, probs: np.ndarray) -> np.ndarray:
        """Logarithms of probs, with that of FLOOR as the last row, which -1 picks."""
        return np.log(np.maximum(np.vstack([probs, np.full((1, probs.shape[1]), FLOOR)]), 1e-300))

    def _log_forward(self, part: str, logs: np.ndarray) -> np.ndarray:
        alpha = np.zeros((len(part) + 1, logs.shape[1]))
        for j, begins, pieces in self._ending(part):
            alpha[j] = np.logaddexp.reduce(alpha[begins] + logs[pieces], axis=0)
        return alpha

    def log_chance(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log probability of each word, a column per language."""
        parts, owner, numbers = self._by_part(words)
        sizes, found = np.fromiter(map(len, parts), np.int64, len(parts)), np.zeros((len(parts), probs.shape[1]))
        for n in np.unique(sizes[sizes <= SHORT]):
            which = np.flatnonzero(sizes == n)
            alpha = self.forward(self.chances(self.spans([parts[i] for i in which]), probs), n, len(which), probs.shape[1])
            found[which] = np.log(np.maximum(alpha[n], 1e-300))
        if (long := np.flatnonzero(sizes > SHORT)).size:
            logs = self._logs(probs)
            for i in long:
                found[i] = self._log_forward(parts[i], logs)[-1]
        out = np.zeros((len(words), probs.shape[1]))
        np.add.at(out, owner, found[numbers])
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words, taken counts times, under one column of probs."""
        total = np.zeros(len(self.number))
        parts, owner, numbers = self._by_part(words)
        times = np.bincount(numbers, np.asarray(counts, float)[owner], minlength=len(parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for n in np.unique(sizes[sizes <= SHORT]):
            which = np.flatnonzero(sizes == n)
            own = [parts[i] for i in which]
            spans = self.spans(own)
            chances = self.chances(spans, probs)
            alpha = self.forward(chances, n, len(own), 1)
            beta = [np.zeros((len(own), 1)) for _ in range(n)] + [np.ones((len(own), 1))]
            for (i, j), p in sorted(chances.items(), key=lambda x: -x[0][0]):
                beta[i] += p * beta[j]
            weight = times[which] / np.maximum(alpha[n][:, 0], 1e-300)
            for (i, j), p in chances.items():
                has = spans[i, j] >= 0
                total += np.bincount(spans[i, j][has], (alpha[i] * p * beta[j])[has, 0] * weight[has], minlength=len(total))
        logs = self._logs(probs)
        for i in np.flatnonzero(sizes > SHORT):
            alpha = self._log_forward(parts[i], logs)[:, 0]
            beta = np.full(len(alpha), -np.inf)
            beta[-1] = 0
            for j, begins, pieces in reversed(list(self._ending(parts[i]))):
                through = logs[pieces, 0] + beta[j]
                beta[begins] = np.logaddexp(beta[begins], through)
                has = np.array(pieces) >= 0
                np.add.at(total, np.array(pieces)[has], times[i] * np.exp(alpha[begins] + through - alpha[-1])[has])
        return total


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words without marks at their ends, occurrences, and each text's first occurrence."""
    words, numbers, offsets = chunks.cut(pc.replace_substring(pc.utf8_lower(texts), "\n", " "))
    bare = pc.utf8_trim(pa.array(words, pa.string()), characters=_EDGES).dictionary_encode()
    return bare.dictionary.to_pylist(), bare.indices.to_numpy(zero_copy_only=False)[numbers], offsets


def learn(rows: DataFrame, pieces: list[str], *, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (a column each) from rows (text, lang)."""
    workers_import_us(rows.sparkSession)
    lattice = Lattice(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in chunks.slices(batch.column(0)):
                words, numbers, offsets = _words(batch.column(0).slice(at, to - at))
                langs = batch.column(1).slice(at, to - at).dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
                cells, n = np.unique(lang.astype(np.int64) * len(words) + numbers, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(cells // len(words))), pa.array(words, pa.string()).take(pa.array(cells % len(words))), pa.array(n)], ["lang", "word", "n"])

    table = rows.mapInArrow(count, "lang string, word string, n long").filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = stage(table, "langid-words")
    languages = sorted(r.lang for r in table.select("lang").distinct().collect())
    probs = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces)))
    for _ in range(rounds if languages else 0):
        given = probs

        def expect(batches: Iterator[pa.RecordBatch], given: np.ndarray = given) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(pieces), len(languages)))
            for batch in batches:
                lang, words, n = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, name in enumerate(languages):
                    if len(which := np.flatnonzero(lang == name)):
                        total[:, k] += lattice.expected([words[i] for i in which], n[which].astype(float), given[:, k : k + 1])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], ["piece", "k", "n"])

        sums = table.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        total = np.full(probs.shape, SMOOTHING)
        for r in sums.collect():  # pieces x languages at most
            total[r.piece, r.k] += r.n
        probs = total / total.sum(axis=0)
    return languages, probs


def identify(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out_fold: int = 2, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learnt from rows with a language outside the held-out fold.

    A row is in the sample by the hash of its doc_id, at a rate that gives training_rows a language.
    """
    spark = docs.sparkSession
    workers_import_us(spark)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    known = base.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out_fold))
    rates = {r.lang: min(1.0, training_rows / r.n) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    pieces = vocabulary(path)
    languages, probs = [], np.zeros((len(pieces), 0))
    if rates:
        rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
        sample = known.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < rate * 1_000_000))
        languages, probs = learn(sample.select("text", "lang"), pieces)
    name, model = uuid.uuid4().hex, spark.sparkContext.broadcast((pieces, languages, probs))  # vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScores.of(name, model)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            for at, to in chunks.slices(texts):
                own = letters[at:to].astype(bool) & bool(scorer.languages)
                pred, score = np.full(to - at, UNKNOWN, object), np.zeros(to - at)
                if own.any():
                    words, numbers, offsets = _words(texts.slice(at, to - at))
                    sums = np.add.reduceat(scorer.look_up(words)[numbers], offsets[:-1])
                    chance = np.exp(sums - sums.max(axis=1, keepdims=True))
                    chance /= chance.sum(axis=1, keepdims=True)
                    best = chance.argmax(axis=1)
                    pred[own], score[own] = np.array(scorer.languages, object)[best[own]], chance[np.arange(to - at), best][own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = spread(base.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "lang_pred", "score")


class WordScores:
    """Log probabilities of the distinct words that this worker has met, for one model."""

    _last: tuple[str, WordScores] | None = None

    def __init__(self, pieces: list[str], languages: list[str], probs: np.ndarray) -> None:
        self.lattice, self.languages, self.probs = Lattice(pieces), languages, probs
        self._clear()

    @classmethod
    def of(cls, name: str, model) -> WordScores:
        if cls._last is None or cls._last[0] != name:
            cls._last = (name, cls(*model.value))
        return cls._last[1]

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held, self.used = np.zeros((1024, len(self.languages))), 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities for each word."""
        if self.used > chunks.KEPT_CHUNKS:
            self._clear()
        new = [w for w in words if w not in self.row]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            to = self.used + len(part)
            if to > len(self.held):
                self.held = np.concatenate([self.held, np.zeros((max(len(self.held), to), len(self.languages)))])
            self.held[self.used : to] = self.lattice.log_chance(part, self.probs)
            if "" in part:
                self.held[self.used + part.index("")] = 0
            self.row.update(zip(part, range(self.used, to), strict=True))
            self.used = to
        return self.held[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]
