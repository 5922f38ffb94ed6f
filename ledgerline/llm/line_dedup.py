"""Line dedup with DataFrame functions only.

The hashes of all lines are range-partitioned and sorted by hash, document and position; a running window
streams each hash's first document. What comes back is a keep bitmap for each document that loses lines:
64 lines a word, and only words with a dropped line are stored, so most documents need none.

A line that a third of all documents hold would end in one task, so each range is dealt by a salt of the
document id first: within a salt all but the first document's lines are settled, and only those firsts (at
most one document a salt) meet again under their bare hash.

Defined cases: null or empty text is one empty line; null doc_id sorts after all ids; rows that repeat a
doc_id are one document for the search and each keeps its own bitmap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, NO_ID, ascii_lower, id_and_text, stage


#: Most bytes of bitmaps that are sent to every executor, at BITMAP_BYTES a document and WORD_BYTES a stored word of 64 lines.
BROADCAST_BYTES, BITMAP_BYTES, WORD_BYTES = 64 << 20, 120, 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_hash, doc_id, text): doc is the id with null last, doc_hash tells rows that share an id apart."""
    base = id_and_text(docs, id_col=id_col, text_col=text_col)
    return base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("doc_hash"), "doc_id", "text")


def _bitmaps(keyed: DataFrame, least: int) -> DataFrame:
    spark = keyed.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = keyed.select("doc", "doc_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc", "doc_hash", "pos", line_key(F.col("line")).alias("key"))
    # Two 64-bit hashes of differing seeds: lines are told apart by 128 bits.
    hashed = lines.filter(F.length("key") >= least).select("doc", "doc_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))
    hashed = stage(hashed, "line-hashes").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))

    running = lambda *keys: F.min("doc").over(W.partitionBy(*keys).orderBy("doc", "pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    salted = hashed.repartitionByRange("h1", "h2", "salt").withColumn("first", running("h1", "h2", "salt"))
    later = salted.filter("doc > first")
    firsts = salted.filter("doc = first").drop("first").withColumn("first", running("h1", "h2")).filter("doc > first")
    dropped = later.select("doc", "doc_hash", "pos").unionByName(firsts.select("doc", "doc_hash", "pos"))
    words = dropped.groupBy("doc", "doc_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
    return words.groupBy("doc", "doc_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("keep_bitmap"))


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, text_hash and keep_bitmap of each document that loses lines.

    keep_bitmap maps the number of a word of 64 lines to its bits, bit i of word w for line 64 w + i, 1 for a
    line that stays; words without a dropped line are left out. A line goes when its key (stripped, A-Z lower)
    has min_chars code points at least and a smaller doc_id holds it too.
    """
    return _bitmaps(_keyed(docs, id_col, text_col), min_chars).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("doc_hash").alias("text_hash"), "keep_bitmap")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped, text (the lines that stay)."""
    keyed = _keyed(docs, id_col, text_col)
    bitmaps = stage(_bitmaps(keyed, min_chars), "line-bitmaps")
    size = bitmaps.agg(F.coalesce(F.sum(BITMAP_BYTES + WORD_BYTES * F.size("keep_bitmap")), F.lit(0))).first()[0]
    both = keyed.join(bitmaps.hint("broadcast" if size <= BROADCAST_BYTES else "shuffle_hash"), ["doc", "doc_hash"], "left")
    kept = F.expr("if(keep_bitmap is null, split(text, '\\n', -1), filter(split(text, '\\n', -1), (line, i) -> coalesce(getbit(try_element_at(keep_bitmap, shiftright(i, 6)), i & 63), 1) = 1))")
    cut = both.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), kept.alias("kept"))
    return cut.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
