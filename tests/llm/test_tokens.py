import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from ledgerline.llm import packing, piece_codec

SF = "/root/testdata/sf0.001"
WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", "  a b ", "a", "\t", "▁x ▁▁ y", "  ", " ", "It's I'LL we'd 12ab34 é́x ﬁ ÅßΣΣ Straße <|endoftext|> x<|startoftext|>y", "x y z\x1cq\x85r",
    "日本語 テスト \U0001f600!!", "a\x00b", "é ́x", "İstanbul ŒŸ ×÷ªº µ", "a\r\nb", "don't \"quoted\" (x) — dash…", "İ'S'T '' ' '' '''s",
]


def word_ids(text, tk=tokenizers.Tokenizer.from_file(WORD)):  # noqa: B008
    return [*tk.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_are_the_librarys():
    for at, ids, ends in packing.token_ids(pa.array(HARD), WORD):
        starts = np.append(0, ends[:-1])
        assert [ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == [word_ids(t) for t in HARD[at : at + len(ends)]]


def test_chunks_of_letters_and_marks_have_the_librarys_ids():
    chunks = ["word", "Word.", "ÀÉ!?", "dogs'", "it's", "don't.", "a<|b", "x>", "'s", "(a)", "a1b", "ß", "end...)", "q_r", "I'LL'", "a'", "a''s", "\xd7a", "naïve;"]
    texts = [*chunks, " ".join(chunks), " ".join(reversed(chunks))]
    for at, ids, ends in packing.token_ids(pa.array(texts), WORD):
        starts = np.append(0, ends[:-1])
        assert [ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == [word_ids(t) for t in texts[at : at + len(ends)]]


def test_piece_ids_are_the_librarys(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = spark.createDataFrame(list(enumerate([*HARD, None])), "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    want = sorted(((r.doc_id is None, r.doc_id), len(i := sp.encode(r.text or "", add_eos=True)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for r in docs.collect() if r.doc_id is not None)
    got = sorted(((r.doc_id is None, r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.digests(docs, PIECE).collect() if r.doc_id is not None)
    assert got == want and piece_codec.digests(none, PIECE).count() == 0
    assert piece_codec.encode_decode(odd, PIECE).filter("doc_id = 1").first().decoded == "Alpha beta gamma delta epsilon zeta."


def packed(docs, **more):
    rows = packing.pack_documents(docs, WORD, **more).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():  # gapless from 0
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= more.get("max_tokens", 4096)
    return rows, by


@pytest.mark.parametrize("most", [4096, 64])
def test_packing_holds_every_piece_once(spark, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, by = packed(docs, max_tokens=most)
    want = {}
    for d in docs.collect():
        ids = word_ids(d.text)
        for k, a in enumerate(range(0, len(ids), most)):
            part = ids[a : a + most]
            want[d.doc_id, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert len(by) <= 1.02 * -(-sum(x[1] for x in want.values()) // most) + 1


def test_packing_odd_rows(odd, none):
    rows, _ = packed(odd)
    assert len([r for r in rows if r.doc_id == 6]) == 2 and {r.length for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert packed(none)[0] == []


def test_pack_keeps_columns_whatever_their_names(spark):
    schema = "doc_id long, piece int, length long, _bucket string, _Rank string, before string, each string, base string, first_rank string, `a.b` string, offset string"
    rows = [(i, 0, 1 + i % 9, *"stuvwxy", "z") for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, schema), max_tokens=10).collect()
    assert got[0].__fields__[:10] == [c.split()[0].strip("`") for c in schema.split(", ")][:10]
    assert sorted(tuple(r)[:10] for r in got) == sorted(r[:10] for r in rows)
    taken = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, at, n), (s2, at2, _) in zip(taken, taken[1:], strict=False):
        assert at2 == (at + n if s == s2 else 0) and at + n <= 10


def test_plan_is_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        most = int(rng.integers(5, 60))
        counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, most + 1, 12)}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((r for r in rooms if r >= length), default=None)
                if fit is None:
                    rooms.append(most - length)
                else:
                    rooms.remove(fit)
                    rooms.append(fit - length)
        used = set()
        for length, a, b, first, each, _base in packing.plan(counts, most):
            used |= {first + (r - a) // each for r in range(a, b + 1)}
            assert length
        assert len(used) == len(rooms)
