import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from ledgerline.llm.components import min_labels

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for i, a in zip(ids, fps, strict=True):
            for j, b in zip(ids, fps, strict=True):
                if (a ^ b).bit_count() <= 3:
                    label[i] = min(label[i], label[j])
        if label == before:
            return label


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows.items()}
    want = slow_components(list(fps), list(fps.values()))
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex()).collect()
    assert {r.doc_id: (r.hex, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in rows}


def test_spark_hash_is_the_contracts(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h == np.uint64(xxhash.xxh64_intdigest("a b c", 42)).astype(np.int64)


def dense(n=900):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = {0, base[0]}
    while len(fps) < n:
        x = base[int(rng.integers(len(base)))] if rng.random() < 0.8 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, int(rng.integers(0, 4))):
            x ^= 1 << int(b)
        fps.add(x)
    return sorted(fps)


def test_large_buckets_and_second_index(spark):
    fps = dense()
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    index = {int(np.uint64(x).astype(np.int64)): i for i, x in enumerate(fps)}
    want = slow_components(list(range(len(fps))), fps)
    for bucket in (simhash.BUCKET, 8):
        pairs = [(index[r.a], index[r.b]) for r in simhash.near_pairs(frame, bucket=bucket).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
        label = list(range(len(fps)))
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        assert label == [want[i] for i in range(len(fps))]


def test_components_on_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 400), (400, 500), (400, 300)]
    got = {r.node: r.label for r in min_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {300: 300, 400: 300, 500: 300}


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 13 and simhash.near_duplicates(none).count() == 0
    by = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert by[3] == by[4] == by[5] == (0, 3) and by[1][1] == by[2][1] == by[6][1] == by[None][1] == 1


def test_null_and_repeated_ids_do_not_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (None, a.upper() + " "), (9, b), (None, b.upper() + " "), (None, "other words alone here"), (3, "x y z u"), (3, "p q r s"), (4, "P q r s")]
    # Fingerprints apart and yet near: one bit each, of which the smallest id is null or shared.
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = simhash.fingerprints

    def signed(docs, **_):
        """Rows without an id and those of id 3 get a neighbour of their text's fingerprint."""
        flip = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == 3), F.lit(1)).otherwise(F.lit(0))
        return real(docs).withColumn("fp", F.col("fp").bitwiseXOR(flip.cast("long")))

    simhash.fingerprints = signed
    try:
        got = sorted((str(r.doc_id), r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    finally:
        simhash.fingerprints = real
    assert got == sorted([("5", 5), ("None", 5), ("9", 9), ("None", 9), ("None", 0), ("3", 3), ("3", 3), ("4", 3)])
