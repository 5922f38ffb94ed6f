"""SentencePiece encoding and decoding by distinct chunk.

No piece of the vocabulary has a white-space marker after another character, so pieces cannot cross from one
marked word into the next and a text's ids are those of its marked words in a row. Each task keeps a table of
the distinct marked words that it has met, segments each once with the library, and joins ids back by
position. The table stays with the task's worker: sending every word occurrence to one table for the whole
corpus would shuffle many times the text itself.

Defined cases: null text is empty (the end id alone); runs of spaces, spaces at the ends and marker
characters in a text go with the word after them; rows that repeat a doc_id have a result each; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from ledgerline.llm import chunks
from ledgerline.llm.common import id_and_text, spread, workers_import_us

MARK = "▁"
_UNEVEN = f"  |^ | $|^$|{MARK}"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[sentencepiece.SentencePieceProcessor, chunks.ChunkTable]:
    """The library's model at path, and this worker's table of marked words without their first marker."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross white-space markers; words cannot be segmented alone")

    def make(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x if w else [sp.piece_to_id(MARK)] for w, x in zip(words, sp.encode(words, num_threads=1), strict=True)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.int64)

    return sp, chunks.ChunkTable(make)


def encode(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of texts: their row numbers, all ids with end ids one after another, and where each row's end."""
    sp, table = codec(path)
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False).astype(bool)
    for which in (np.flatnonzero(~uneven), np.flatnonzero(uneven)):
        part = texts.take(pa.array(which))
        for at, to in chunks.slices(part):
            if uneven[which[at]]:
                found = [[w[1:] for w in _MARKED.findall(MARK + t.replace(" ", MARK))] if t else [] for t in part.slice(at, to - at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
                words = list({w for x in found for w in x})
                number = {w: i for i, w in enumerate(words)}
                numbers = np.array([number[w] for x in found for w in x], np.int64)
            else:
                words, numbers, offsets = chunks.cut(part.slice(at, to - at))
            rows = table.look_up(words)[numbers]
            ends = np.concatenate([[0], np.cumsum(table.size[rows])]).astype(np.int64)[offsets[1:]]
            yield which[at:to], np.insert(table.gather(rows), ends, sp.eos_id()), ends + np.arange(1, to - at + 1)


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array with the end id) and decoded (the ids read back) of each text."""
    return _each(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256 of each text."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _each(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids), sha(" ".join(map(str, ids))), sha(text)))


def _each(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    workers_import_us(docs.sparkSession)
    base = spread(id_and_text(docs, id_col=id_col, text_col=text_col))
    schema = pa.schema([("doc_id", pa.int64())] + [(c.split()[0], {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = codec(path)
        for batch in batches:
            for rows, ids, ends in encode(batch.column(1), path):
                every = ids.tolist()
                made = [make(x := every[a:b], sp.decode(x)) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(x, schema.field(i + 1).type) for i, x in enumerate(zip(*made, strict=True)))], schema=schema)

    return base.mapInArrow(run, f"doc_id long, {columns}")
