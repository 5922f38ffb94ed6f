import zlib

import numpy as np
import public_tokenizers

from ledgerline.llm import langid, quality, topk

SF = "/root/testdata/sf0.01"
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t, _ in held]) > 0.97
    good, bad = [s for _, t, s in held if t], [s for _, t, s in held if not t]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_quality_moments_match_numpy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.statistics_table(docs), labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    x = np.array([quality.statistics(r.text) for r in docs.collect() if truth.get(r.doc_id) == 1])
    assert np.allclose(model.mean[1], x.mean(axis=0))


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0), (None, 1), (8, None), (1, 0)], "doc_id long, quality int")
    assert len(quality.score_documents(odd, labels).collect()) == 13
    assert quality.score_documents(none, labels).count() == 0
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    one = labels.filter("quality = 1")
    assert {r.score for r in quality.score_documents(odd, one).collect()} == {1.0}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs, PIECE).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    lattice = langid.Lattice(pieces)
    probs = np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 2).T

    def every(text):
        if not text:
            return np.ones(2)
        return sum((probs[pieces.index(text[:k])] * every(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces), np.zeros(2))

    words = ["ab", "aba", "abab", "b", "aabb"]
    assert np.allclose(np.exp(lattice.log_chance(words, probs)), [every("▁" + w) for w in words])
    counts = lattice.expected(["ab"], np.array([1.0]), probs[:, :1])
    whole = every("▁ab")[0]
    assert np.isclose(counts[pieces.index("▁ab")], probs[5, 0] / whole) and np.isclose(counts[pieces.index("ab")], probs[0, 0] * probs[4, 0] / whole)


def test_long_words_are_summed_whole():
    """Words of any length, with and without places that no piece spans, against the plain recursion; also in training."""
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aab", "c"]
    lattice, rng = langid.Lattice(pieces), np.random.default_rng(5)
    probs = rng.dirichlet(np.ones(len(pieces)), 2).T

    def slow(text):
        alpha = [np.ones(2, np.longdouble)]
        for j in range(1, len(text) + 1):
            alpha.append(sum(alpha[i] * (probs[pieces.index(text[i:j])] if text[i:j] in pieces else langid.FLOOR * (i == j - 1)) for i in range(j)))
        return np.log(alpha[-1]).astype(float)

    words = ["".join(rng.choice(list(letters), n)) for letters in ("ab", "abc", "abx", "x") for n in (24, 25, 60, 100)]
    assert np.allclose(lattice.log_chance(words, probs), [slow("▁" + w) for w in words])
    assert lattice.parts("abcab") == ["▁ab", "c", "ab"] and lattice.parts("xx") == ["▁", "x", "x"] and "".join(lattice.parts(words[3])) == "▁" + words[3]
    # What is expected of a piece is how the log chance grows with its logarithm.
    word, step = words[2], 1e-6
    for p in range(len(pieces)):
        more = probs.copy()
        more[p] *= 1 + step
        slope = (slow("▁" + word)[0] * -1 + _with(slow, more, probs, "▁" + word)) / step
        assert np.isclose(lattice.expected([word], np.array([1.0]), probs[:, :1])[p], slope, atol=1e-3)
    long = "ab" * 4000 + "c" + "日本語" * 3000
    assert np.isfinite(lattice.log_chance([long], probs)).all() and np.isfinite(lattice.expected([long], np.array([2.0]), probs[:, :1])).all()


def _with(slow, more, probs, word):
    held = probs.copy()
    probs[:] = more
    try:
        return slow(word)[0]
    finally:
        probs[:] = held


def test_language_by_enumeration(spark):
    """Predictions of a whole table against plain sums with the learnt probabilities."""
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("die katze saß auf der matte", "de"), ("le chat est sur le tapis", "fr")] * 20)], "doc_id long, text string, lang string")
    test = docs.unionByName(spark.createDataFrame([(1000, "The mat, the cat", None), (1001, "die matte!", None), (1002, "donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen", None), (1003, "12", None)], docs.schema))
    pieces = langid.vocabulary(PIECE)
    known = test.filter("lang is not null").filter(langid.fold(docs.doc_id, 4) != 2).select("text", "lang")
    languages, probs = langid.learn(known, pieces)
    number = {p: i for i, p in enumerate(pieces)}

    def slow(text):
        total = np.zeros(len(languages))
        for w in text.lower().split():
            w, alpha = "▁" + w.strip(langid._EDGES), [np.ones(len(languages))]
            for j in range(1, len(w) + 1):
                alpha.append(sum(alpha[i] * (probs[number[w[i:j]]] if w[i:j] in number else langid.FLOOR * (i == j - 1)) for i in range(max(0, j - 20), j)))
            total += np.log(alpha[-1])
        chance = np.exp(total - total.max())
        return languages[int(chance.argmax())], chance.max() / chance.sum()

    for r in langid.identify(test, PIECE).join(test.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id == 1003:
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == slow(r.text)[0] and np.isclose(r.score, slow(r.text)[1]), r


def test_quality_scores_by_plain_densities(spark):
    """Scores against log densities from whole matrices, with numpy alone."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, np.array(quality.statistics(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
    learnt = [(truth[i], x) for i, x in rows if i in truth and zlib.crc32(str(i).encode()) % 3 != 1]
    every = np.array([x for _, x in learnt])
    mean, sd = every.mean(axis=0), every.std(axis=0)
    logs = []
    for c in (0, 1):
        own = (np.array([x for y, x in learnt if y == c]) - mean) / sd
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / len(cov) * np.eye(len(cov))
        z = (np.array([x for _, x in rows]) - mean) / sd - own.mean(axis=0)
        logs.append(np.log(len(own) / len(every)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    want = {i: 1 / (1 + np.exp(-(b - a) / len(mean))) for (i, _), a, b in zip(rows, *logs, strict=True)}
    for r in quality.score_documents(docs, labels).collect():
        assert np.isclose(r.score, want[r.doc_id], atol=1e-6) and r.predicted == int(r.score >= 0.5)


def test_language_odd_rows(odd, none):
    rows = {r.doc_id: r for r in langid.identify(odd, PIECE).collect()}
    assert len(langid.identify(odd, PIECE).collect()) == 13
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "und" and rows[3].score == 0
    assert langid.identify(none, PIECE).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd.text.substr(0, 0).cast("string")).filter("false").unionByName(odd.withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))), PIECE).collect()} == {"und"}


def slow_top(rows, k=20, every=20):
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in ok:
        if i % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i))[:k]  # noqa: B905
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_top_k_with_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 40).astype(np.float32)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)]  # ties
    vectors += [(1000, None), (1001, [0.1, None]), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (None, [0.1] * 40), (1005, [0.5]), (1006, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    for blocks in ({}, {"query_numbers": 300}):
        assert {tuple(r) for r in topk.top_k(frame.repartition(3), **blocks).collect()} == slow_top(vectors)


def test_top_k_of_mixed_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, n)]) for i, n in enumerate([5, 40, 3000, 17, 64, 1] * 20)] + [(40, [1.0, 2.0]), (41, [0.5] * 300), (60, [])]
    frame = spark.createDataFrame([(i, v, "a", 1) for i, v in vectors], "vec_id long, embedding array<double>, v string, width int")
    counts = {}
    for i, _ in vectors:
        counts[i] = counts.get(i, 0) + 1
    got = {tuple(r) for r in topk.top_k(frame, query_numbers=4096).collect() if counts[r.query_id] == 1}
    assert got == {x for x in slow_top(vectors) if counts[x[0]] == 1} and len(got) > 50
    sizes = np.array([3, 100, 4, 3, 1000, 0])
    cut = list(topk.blocks(sizes, 40, 3))
    assert sorted(np.concatenate(cut).tolist()) == list(range(6)) and all(len(c) == 1 or (len(c) <= 3 and len(c) * sizes[c].max() <= 40) for c in cut)


def test_top_k_of_huge_numbers_and_none(spark):
    vectors = [(i, [float(10**7 + i), -3.5 * i, 1e6]) for i in range(30)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(frame).collect()} == slow_top(vectors)
    assert topk.top_k(frame.limit(0)).count() == 0
