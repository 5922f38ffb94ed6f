import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import shards, spelling, whitening


def plain_words(rows, least=5, often=3, lossy=97):
    found = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                found[run if h % lossy else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    return {w: n for w, n in found.items() if len(w) >= least and n >= often}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def plain_variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def as_dict(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_one_apart():
    assert one_apart("abc", "abd") and one_apart("abc", "ac") and one_apart("a", "") and one_apart("aab", "ab")
    assert not one_apart("abc", "abc") and not one_apart("abc", "cba") and not one_apart("abcd", "ab")


def test_words_of_odd_texts(spark, odd):
    odd = odd.unionByName(odd.withColumn("text", F.concat(F.lit("lines wards worde wörd× Àbcdé "), "text")))
    counted = {r["word"]: r["n"] for r in spelling.count_words(odd).filter("length(word) >= 5 and n >= 3").collect()}
    assert counted == plain_words(odd.select("doc_id", "text").collect())
    assert len(counted) > 8 and as_dict(spelling.spelling_variants(odd)) == plain_variants(counted)


@pytest.mark.parametrize("letters", ["ab", "aé", "abcdefgh"])
def test_variants_of_random_words(spark, letters):
    random.seed(letters)
    words = {"".join(random.choices(letters, k=random.randint(0, 7))): random.randint(1, 40) for _ in range(300)}
    words |= {"y" * 3000: 3, "y" * 3001: 6, "y" * 2999 + "x": 1}
    # Ranges of few words each, so that nodes reach over borders.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert as_dict(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain_variants(words)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_words(spark, none):
    assert spelling.spelling_variants(none).collect() == []
    assert spelling.spelling_variants(none.select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("text"))).collect() == []


def test_eigenvectors_of_awkward_matrices():
    random_ = np.random.default_rng(3)
    for m in (1, 2, 3, 9, 40):
        a = random_.standard_normal((m, m))
        q = np.linalg.qr(a)[0]
        twice = q @ np.diag([5.0] * (m // 2) + [1.0] * (m - m // 2)) @ q.T
        for v in (a @ a.T, np.eye(m), np.zeros((m, m)), a[:, :1] @ a[:, :1].T, (twice + twice.T) / 2, np.diag(np.arange(m) % 3.0), 1e-9 * (a + a.T)):
            values, vectors = whitening.components(v, 8)
            size = max(np.abs(v).max(), 1e-300)
            assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], rtol=0, atol=1e-13 * m * size)
            assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
            assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-12 * m * size


def white(df):
    rows = whitening.whiten(df).collect()
    return rows, {(r["vec_id"], r["component"]): r for r in rows}


def test_whitening_against_numpy(spark):
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    bad = [(-1, None), (-2, [1.0, None] * 32), (-3, [float("nan")] * 64), (-4, [float("inf")] * 64), (-5, []), (-6, [1.0] * 7), (-7, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, i) for i, v in given + bad], "vec_id long, embedding array<double>, component long").repartition(5)
    rows, found = white(df)
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in given]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = (n * np.array(x) - np.array(total)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n}
    for k in range(8):
        got = np.array([found[i, k + 1]["whitened"] for i, _ in given])
        want = y @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
    assert all(r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], total, strict=True)) for i, _ in enumerate(given) for r in [found[given[i][0], 3]])
    assert all(abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in rows)


def test_whitening_of_little(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "vec_id long, embedding array<float>")
    assert whitening.whiten(make()).collect() == [] and whitening.whiten(make((1, None))).collect() == []
    rows, _ = white(make((1, [0.5, 2.0])))
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows] == [(c, 1, 0, None, 0.0, None) for c in (1, 2)]
    rows, _ = white(make((1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [1.5, 2.0])))  # repeated and null ids, a constant dimension
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in rows) == [("1", 1, 1024**2)] * 2 + [("1", 2, 1024**2)] * 2 + [("None", c, 4 * 1024**2) for c in (1, 2)]
    one = [r["whitened"] for r in rows if r["component"] == 1]
    assert abs(sum(one)) < 1e-12 and abs(sum(w * w for w in one) / 3 - 1) < 1e-12 and all(r["whitened"] is None for r in rows if r["component"] == 2)
    far, _ = white(make((1, [3e15]), (2, [-3e15])))  # deviations beyond a long
    assert {r["deviation"] for r in far} == {None} and {round(abs(r["whitened"]), 9) for r in far} == {1.0}


def slots(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r["shard"]].append(r["slot"])
    return {s: sorted(v) == list(range(len(v))) for s, v in found.items()}


def test_sharding_of_odd_rows(spark, odd, none):
    tree = shards.layout(16)
    placed = shards.shard_slots(odd, tree, shards.grow(tree))
    rows = placed.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1 and all(slots(placed).values())
    assert shards.shard_slots(none, tree).collect() == []
    assert [r["shard"] for r in shards.place(odd.filter("doc_id = 8").withColumn("shard", F.lit("x")), tree).collect()] == [r["shard"] for r in rows if r["doc_id"] == 8]


def test_one_more_shard_takes_rows_into_itself_alone(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = shards.layout(16)
    for _ in range(2):
        more = shards.grow(tree)
        both = shards.place(shards.place(ids, tree), more, shard_col="then")
        new, n = len(tree), len(more)
        assert both.filter(f"then <> shard and then <> {new}").isEmpty()
        assert abs(both.filter(f"then = {new}").count() - 20000 / n) < 6 * (20000 / n) ** 0.5
        counts = [r["count"] for r in both.groupBy("then").count().collect()]
        assert len(counts) == n and max(abs(c - 20000 / n) for c in counts) < 6 * (20000 / n) ** 0.5
        tree = more


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), "id")
    tree = shards.layout(16)
    heavier = [s._replace(weight=2.0) if s.shard == 6 else s for s in tree]  # region 0, rack 1
    moved = shards.place(shards.place(ids, tree), heavier, shard_col="then").filter("shard <> then")
    assert not moved.isEmpty()
    assert moved.filter("then >= 8").isEmpty()  # nothing goes to region 1
    assert moved.filter("shard < 8 and then < 4").isEmpty()  # within region 0 nothing goes to rack 0
    assert moved.filter("shard between 4 and 7 and then <> 6").isEmpty()  # within the rack all goes to shard 6
    gone = [s._replace(weight=0.0) if s.shard == 6 else s for s in tree]
    lost = shards.place(shards.place(ids, tree), gone, shard_col="then").filter("shard <> then")
    assert lost.filter("then = 6").isEmpty() and lost.filter("shard >= 8").isEmpty()
    for bad in ([], [s._replace(weight=0.0) for s in tree], [s._replace(weight=-1.0) for s in tree], [*tree, tree[0]]):
        with pytest.raises(ValueError):
            shards.place(ids, bad)


def test_a_hot_id_is_numbered_by_many_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 2 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    assert all(slots(shards.shard_slots(rows, shards.layout(4))).values())


def test_shards_are_written_by_folder(spark, odd):
    tree = shards.layout(3, regions=1, racks=1)
    path = shards.write_shards(odd, tree)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert back.select("doc_id", "shard").exceptAll(shards.place(odd, tree).select("doc_id", "shard")).isEmpty()
