"""Spelling variants: words of one text corpus that differ by one code point, by a dictionary of trie-node pairs.

Words are sorted, and as they stream past, the nodes of their trie are numbered: a word takes over the nodes of what it
shares with the word before and numbers the rest. Reversed words give the nodes of suffixes in the same way. So a word
of length m is, at each place i, the pair (node of its first i code points, node of the rest), and with the code point at
i skipped the pair (node of the first i, node of what follows i + 1). Two words are near if a skipped pair of one equals
a skipped pair of the other (replaced) or a plain pair of it (deleted, inserted); no strings are compared. A code point
skipped within a run of the same counts at the run's first place alone, so each near pair meets exactly once.

Words that share a pair are at most as many as the alphabet has code points (90 here), and one more that has nothing at
that place; each group yields a row a member, its number of near words and the best of them, not pairs. Ranges of sorted
words are numbered by their tasks apart; nodes that reach over the border of ranges, at most the length of one word for
each border, are renamed by a broadcast table. Forms are followed to their roots by pointer doubling over staged tables.

Defined cases: null and blank texts have no words; a null id is written as nothing before the colon; rows that repeat an
id count each; words of any length are whole; ties in n go to the smaller word in code-point order; columns other than
the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import id_and_text, spread, stage, workers_import_us

RUN = "[A-Za-zÀ-ÿ]+"
#: One occurrence in so many loses a code point, as the hash of document and word says.
LOSSY = 97
#: Distinct words that a task counts before it hands them on, and characters of a text whose words are listed all at once.
WORDS, LISTED = 1 << 17, 1 << 20


def occurrences(doc_id: str, text: bytes, run: re.Pattern, lossy: int | None) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts; bytes are lowered, which lowers A-Z alone."""
    lowered = text.lower().decode()
    found = run.findall(lowered) if len(lowered) <= LISTED else (m[0] for m in run.finditer(lowered))
    for word, n in Counter(found).items():
        if lossy and (h := zlib.crc32(f"{doc_id}:{word}".encode())) % lossy == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: str = RUN, lossy: int | None = LOSSY) -> DataFrame:
    """(word, n) of each distinct word of docs; lossy None leaves all words as they are."""
    workers_import_us(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pattern = Counter(), re.compile(run)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for doc_id, text in zip(ids, texts, strict=True):
                for word, n in occurrences("" if doc_id is None else str(doc_id), text.as_buffer().to_pybytes(), pattern, lossy):
                    found[word] += n
                if len(found) >= WORDS:
                    yield out()
                    found.clear()
        yield out()

    counted = spread(id_and_text(docs, id_col=id_col, text_col=text_col)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """How many code points a and b begin with in common."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _numbered(words: DataFrame) -> DataFrame:
    """words (key, word, n) sorted by word, with at (their place, in order), part (its range) and nodes, one for each prefix.

    The root is node 0 in all ranges; other nodes have their range above bit 40.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, path, at, free = "", [0], part << 33, (part + 1) << 40
        for batch in batches:
            nodes, ends = [], [0]
            for word in batch.column(1).to_pylist():
                both = shared(last, word)
                del path[both + 1 :]
                path.extend(range(free, free + len(word) - both))
                free += len(word) - both
                nodes.extend(path)
                ends.append(len(nodes))
                last = word
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nodes, pa.int64()))
            places = pa.array(range(at, at + len(batch)), pa.int64())
            at += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, places, pa.array([part] * len(batch), pa.int32()), lists], ["key", "word", "n", "at", "part", "nodes"])

    ranged = words.select("key", "word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return stage(ranged.mapInArrow(number, "key long, word string, n long, at long, part int, nodes array<long>"), "trie")


def _borders(numbered: DataFrame) -> DataFrame | None:
    """(node, first) of nodes that an earlier range numbered already: of its first word's nodes, those shared with the word before."""
    ends = F.struct("word", "nodes")
    ranges = numbered.groupBy("part").agg(F.min_by(ends, "at").alias("begin"), F.max_by(ends, "at").alias("end")).orderBy("part")
    again, last, path = {}, "", [0]
    for row in ranges.toLocalIterator():
        both = shared(last, row["begin"]["word"])
        again |= dict(zip(row["begin"]["nodes"][1 : both + 1], path[1 : both + 1], strict=True))
        last, path = row["end"]["word"], [again.get(x, x) for x in row["end"]["nodes"]]
    return numbered.sparkSession.createDataFrame(list(again.items()), "node long, first long") if again else None


def _renamed(rows: DataFrame, col: str, borders: DataFrame | None) -> DataFrame:
    if borders is None:
        return rows
    table = F.broadcast(borders.select(F.col("node").alias("_node"), F.col("first").alias("_first")))
    return rows.join(table, F.col(col) == F.col("_node"), "left").withColumn(col, F.coalesce("_first", col)).drop("_node", "_first")


def _pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(p, s, kind, at, n): kind 2 is a word's plain pair, 1 a skipped one, 0 one skipped within a run of the same code point."""
    begins, ends = _borders(forward), _borders(backward)
    both = forward.select("at", "word", "n", F.col("nodes").alias("p")).join(backward.select(F.col("key").alias("at"), F.reverse("nodes").alias("s")), "at")
    # A word's code points and those before them, to tell where a run begins.
    points = F.split("word", "")
    firsts = F.transform(F.arrays_zip(points.alias("c"), F.concat(F.array(F.lit("")), F.slice(points, 1, F.size(points) - 1)).alias("b")), lambda x: F.when(x["c"] == x["b"], 0).otherwise(1))
    many = F.size("p")
    skipped = both.select("at", "n", F.inline(F.arrays_zip(F.slice("p", 1, many - 1).alias("p"), F.slice("s", 2, many - 1).alias("s"), firsts.alias("kind"))))
    plain = both.select("at", "n", F.inline(F.arrays_zip(F.col("p"), F.col("s")))).select("at", "n", "p", "s", F.lit(2).alias("kind"))
    return _renamed(_renamed(skipped.unionByName(plain), "p", begins), "s", ends)


def _near(pairs: DataFrame) -> DataFrame:
    """(at, n_near, best) of each word with near words; best is (-n, at) of the one with the largest n."""
    member = F.struct((-F.col("n")).alias("less"), F.col("at").alias("at"), F.col("kind").alias("kind"))
    groups = pairs.groupBy("p", "s").agg(F.array_sort(F.collect_list(member)).alias("m")).filter("size(m) > 1")
    # What is near a plain pair is skipped pairs of run beginnings; what is near a skipped one is the others, and the plain one if it is a run's beginning.
    found = groups.select(F.explode(F.expr("""
        transform(m, x -> named_struct('at', x.at, 'near', filter(m, y ->
            y.at <> x.at and case when x.kind = 2 then y.kind = 1 when y.kind = 2 then x.kind = 1 else true end)))
    """)).alias("x")).filter("size(x.near) > 0")  # fmt: skip
    return found.groupBy("x.at").agg(F.sum(F.size("x.near")).cast("long").alias("n_near"), F.min(F.struct(F.col("x.near")[0]["less"].alias("less"), F.col("x.near")[0]["at"].alias("at"))).alias("best"))


def _roots(words: DataFrame) -> DataFrame:
    """words with root: form is followed until a word has none. n doubles at each step at least, so few rounds do."""
    left = stage(words.filter("form_at is not null").select("at", F.col("form_at").alias("root_at")), "forms")
    while True:
        further = left.select(F.col("at").alias("_at"), F.col("root_at").alias("_root"))
        jumped = stage(left.join(further, F.col("root_at") == F.col("_at"), "left").select("at", F.coalesce("_root", "root_at").alias("root_at"), F.col("_root").isNotNull().alias("moved")), "roots")
        left = jumped.select("at", "root_at")
        if jumped.filter("moved").isEmpty():
            return words.join(left, "at", "left")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of words (word, n; words are distinct and not null).

    A word's form is its near word of largest n where that is twice its own n at least; root is what forms lead to.
    """
    workers_import_us(words.sparkSession)
    forward = _numbered(stage(words.select(F.lit(0).cast("long").alias("key"), "word", "n"), "words"))
    backward = _numbered(forward.select(F.col("at").alias("key"), F.reverse("word").alias("word"), "n"))
    near = _near(_pairs(forward, backward))
    listed = forward.select("at", "word", "n").join(near, "at", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    listed = stage(listed.select("at", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.at")).alias("form_at"), F.when(fits, -F.col("best.less")).alias("form_n")), "variants")
    rooted = _roots(listed)
    names = listed.select(F.col("at").alias("_at"), F.col("word").alias("_word"))
    forms, roots = names.select(F.col("_at").alias("form_at"), F.col("_word").alias("form")), names.select(F.col("_at").alias("root_at"), F.col("_word").alias("root"))
    # Most words have no form; only those that have one are looked up.
    with_form = rooted.filter("form_at is not null").join(forms, "form_at").join(roots, "root_at").select("word", "form", "root", "n", "n_near", "form_n")
    without = rooted.filter("form_at is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return with_form.unionByName(without)


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, run: str = RUN, lossy: int | None = LOSSY) -> DataFrame:
    """`variants` of the words of docs that have min_chars code points and min_count occurrences at least."""
    counted = count_words(docs, id_col=id_col, text_col=text_col, run=run, lossy=lossy)
    return variants(counted.filter((F.length("word") >= min_chars) & (F.col("n") >= min_count)))
