"""Ids of the word BPE tokenizer, by distinct chunk.

Its pre-tokens never cross white space, so a text's ids are its chunks' ids in a row. Most chunks are letters and
then marks, two pre-tokens, and case is lost in the tokenizer: such a chunk is taken as its two parts, so that a word is
encoded once whatever its case and the marks after it. New parts are encoded together in one text; pre-tokens end in
ids that carry the word-end mark, which tells where a part ends.
Chunks with characters outside ASCII and Latin-1 letters, or with the start of a special token, are encoded
one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ledgerline.llm.chunks import ChunkTable

_PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's own pre-token pattern for such chunks (fixed value), on lower-case text.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


#: Letters and then marks, as most chunks are: one pre-token, or two.
_LETTERS, _MARKS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+", r"[!-/:;=>?@\[-`{-~]*"
_SIMPLE = re.compile(f"({_LETTERS})({_MARKS})")


def pre_tokens(chunk: str) -> int:
    """How many pre-tokens a plain chunk has; 0 of any other."""
    if m := _SIMPLE.fullmatch(chunk):
        return 1 + (m.end(1) < len(chunk))
    return len(_PRE_TOKENS.findall(chunk.lower())) if _PLAIN.fullmatch(chunk) and "<|" not in chunk else 0


def parts(chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct parts of chunks, and the numbers of the two parts of each: letters in lower case and the marks after them, or the chunk and nothing."""
    words = pa.array(chunks, pa.string())
    found = pc.extract_regex(words, pattern=f"^(?P<word>{_LETTERS})(?P<marks>{_MARKS})$")
    first = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "word")), words)
    both = pa.concat_arrays([first, pc.fill_null(pc.struct_field(found, "marks"), "")]).dictionary_encode()
    return both.dictionary.to_pylist(), both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T


@lru_cache(maxsize=2)
def table(path: str) -> ChunkTable:
    """This worker's table for the tokenizer file at path."""
    tokenizer = Tokenizer.from_file(path)
    ids = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(ids.values()) + 3, bool)
    ends[[i for t, i in ids.items() if t.endswith("</w>")]] = True

    def each(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([i for f in found for i in f], np.int64)

    def make(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(pre_tokens, chunks), np.int64, len(chunks))
        plain = counts > 0
        together, counts = [c for c, n in zip(chunks, counts.tolist(), strict=True) if n], counts[plain]
        flat = np.array(tokenizer.encode_batch_fast([" ".join(together)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(ends[flat])
        if len(last) != counts.sum():
            return each(chunks)
        to = np.append(-1, last)[np.cumsum(counts)] + 1
        sizes = np.zeros(len(chunks), np.int64)
        sizes[plain] = np.diff(to, prepend=0)
        other_sizes, other = each([c for c, p in zip(chunks, plain, strict=True) if not p])
        sizes[~plain] = other_sizes
        values = np.empty(int(sizes.sum()), np.int64)
        is_plain = np.repeat(plain, sizes)
        values[is_plain], values[~is_plain] = flat, other
        return sizes, values

    return ChunkTable(make)
