import hashlib
import re

import numpy as np
import pytest

from ledgerline.llm import exact_dedup, line_dedup

SF = "/root/testdata/sf0.001"


def slow_exact(rows):
    """(doc_id, keep_id, group_size, kept, sha) by plain Python."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    late = lambda i: 2**63 - 1 if i is None else i
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), late(i), i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("source", ["odd", "table"])
def test_exact_groups(spark, odd, source):
    docs = odd if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_exact([(r.doc_id, r.text) for r in docs.collect()])
    for most in (exact_dedup.BROADCAST_ROWS, 0):  # repeated fingerprints broadcast, and met by a shuffle
        got = sorted([tuple(r) for r in exact_dedup.exact_groups(docs, broadcast_rows=most).collect()], key=str)
        assert got == want


def test_drop_copies_keeps_one_row_a_group_and_all_columns(odd, none):
    kept = exact_dedup.drop_copies(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and none.count() == exact_dedup.drop_copies(none).count() == 0
    texts = [re.sub(r"\s", "", r.text or "") for r in rows]
    assert len(texts) == len(set(texts)) and {r.doc_id for r in rows} == {1, 2, 5, -7, 8, 9, 10, 11}


def test_colliding_fingerprints_stay_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "d")], "doc_id long, text string")
    whole = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: whole(*c) * 0)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_filter_segments_round_trip_and_merge():
    rng = np.random.default_rng(3)
    q, s = 18, 6
    parts, whole = [], []
    for _ in range(5):
        fps = rng.integers(0, 2**63, 400, dtype=np.uint64) >> np.uint64(6)  # all in segment 0 of 64
        fps = np.concatenate([fps, fps[:50], np.full(7, 12345, np.uint64)])
        whole.append(fps)
        u, n = np.unique(fps, return_counts=True)
        for segment in np.unique(u >> np.uint64(64 - s)):
            own = u >> np.uint64(64 - s) == segment
            back = exact_dedup.decode_segment(exact_dedup.encode_segment(u[own], n[own], s, q), int(segment), s, q)
            assert (back[0] == u[own]).all() and (back[1] == n[own]).all()
            parts.append(back)
    u, n = np.unique(np.concatenate(whole), return_counts=True)
    got = exact_dedup.merge(parts)
    assert (got[0] == u).all() and (got[1] == n).all()


@pytest.mark.parametrize("rows", [10**3, 10**6, 10**8, 10**10])
def test_filters_take_few_bytes_a_fingerprint(rows):
    """A full filter of a corpus of so many rows: bytes a fingerprint with 20 for each segment's row, and nothing lost."""
    fps = np.random.default_rng(rows).integers(0, 2**64, min(rows, exact_dedup.FLUSH), dtype=np.uint64)
    s, q = exact_dedup.filter_bits(rows)
    built = list(exact_dedup.build_filter(fps, s, q))
    assert sum(len(x) + 20 for _, x in built) < (16 if rows >= 10**6 else 24) * len(fps) + 100
    back = np.concatenate([exact_dedup.decode_segment(x, n, s, q)[0] for n, x in built])
    assert (back == np.unique(fps)).all()


def test_drop_copies_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", "z", "w"), (2, "a ", "x", "y", "z", "w"), (2, "a ", "x", "y", "z", "w"), (3, None, "x", "y", "z", "w")], "doc_id long, text string, _id string, _sha string, own_id string, OWN_SHA string")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def slow_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    late = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), 2**63), late(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == late(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("source", ["odd", "table"])
def test_lines(spark, odd, source, monkeypatch):
    docs = odd if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_lines([(r.doc_id, r.text) for r in docs.collect()])
    for most in (line_dedup.BROADCAST_BYTES, -1):  # bitmaps sent to the texts, and met by a shuffle
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
        assert sorted([tuple(r) for r in line_dedup.dedup_lines(docs).collect()], key=str) == want


def test_bitmaps_hold_changed_words_alone(spark, none):
    lines = [f"a line with number {i}" for i in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*map(str, range(70)), lines[5], "own line of two"])), (3, "nothing shared")], "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(docs).collect()
    assert [(r.doc_id, dict(r.keep_bitmap)) for r in rows] == [(2, {1: ~(1 << 6)})]
    assert line_dedup.dedup_lines(none).count() == 0
