"""Operators over keys that span many tasks, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators import register as rg
from ledgerline.operators.scans import in_order, running
from ledgerline.streaming import operators as so

T0 = datetime(2024, 1, 1)


@pytest.fixture
def many_ranges(spark):
    """Few rows a task, so that keys reach over several ranges."""
    for k, v in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "11")):
        spark.conf.set(k, v)
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def events(n, hot=0.7, seed=1, gaps=(0, 0, 1, 20, 45)):
    """(key, ts, event_id, bad) in order of time; one key has most rows, some have none."""
    rng, at, rows = random.Random(seed), T0, []
    for i in range(n):
        at += timedelta(seconds=rng.choice(gaps))
        rows.append((1 if rng.random() < hot else rng.choice([None, 2, 3, 4]), at, i, rng.random() < 0.85))
    return rows


@pytest.mark.parametrize("before", [False, True])
def test_running_values(many_ranges, before):
    rng = random.Random(2)
    rows = many_ranges.createDataFrame([(k, i, rng.choice([None, 1, 2, 5]), rng.choice([None, "a", "b"])) for k, _, i, _ in events(600)], "k int, i int, x int, s string")
    got = running(in_order(rows, ["k"], ["i"]), ["k"], {"total": ("sum", F.col("x")), "most": ("max", F.col("x")), "latest": ("last", F.col("s"))}, before=before)
    assert got.select("_part").distinct().count() > 5
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    want = rows.select("*", F.sum("x").over(w).alias("total"), F.max("x").over(w).alias("most"), F.last("s", ignorenulls=True).over(w).alias("latest"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert running(in_order(rows.limit(0), ["k"], ["i"]), ["k"], {"total": ("sum", F.col("x"))}).count() == 0


def bursts(rows, needed, window):
    state, fired = {}, {}
    for k, at, i, _ in rows:
        count, began = state.get(k, (0, at))
        if at - began > timedelta(seconds=window):
            count, began = 0, at
        count += 1
        fired[i] = count >= needed
        state[k] = (0, at) if fired[i] else (count, began)
    return fired


@pytest.mark.parametrize(("needed", "window", "n"), [(5, 60, 900), (1, 60, 60), (2, 0, 300), (3, 19, 300), (40, 3000, 900), (40, 300, 12)])
def test_bursts_of_a_key_that_holds_most_rows(many_ranges, needed, window, n):
    rows = events(n)
    got = so.burst_detector(many_ranges.createDataFrame(rows, "k long, ts timestamp, event_id long, bad boolean"), key="k", hits_needed=needed, window_s=window)
    found = {r["event_id"]: (r["key"], r["fired"]) for r in got.collect()}
    want = bursts(rows, needed, window)
    assert found == {i: (None if k is None else str(k), want[i]) for k, _, i, _ in rows}


def lockouts(rows, failures, window, lock):
    state, out = {}, {}
    for k, at, i, bad in rows:
        recent, until = state.get(k, ([], T0))
        if not bad:
            state[k] = ([], T0)
            continue
        recent = [x for x in recent if at - x <= timedelta(seconds=window)] + [at]
        # Failures of one instant, until a success, count together.
        more, j = 0, i + 1
        while j < len(rows) and rows[j][1] == at:
            if rows[j][0] == k and not rows[j][3]:
                break
            more, j = more + (rows[j][0] == k), j + 1
        locks = len(recent) + more >= failures
        out[i] = (k, len(recent) + more, until > at, locks)
        state[k] = (recent, at + timedelta(seconds=lock) if locks else until)
    return out


@pytest.mark.parametrize(("failures", "window", "lock"), [(5, 900, 300), (1, 0, 30), (3, 45, 20)])
def test_lockouts_of_a_key_that_holds_most_rows(many_ranges, failures, window, lock):
    rows = events(700, gaps=(0, 0, 1, 20, 45, 400))
    df = many_ranges.createDataFrame(rows, "auth_key long, ts timestamp, event_id long, is_failure boolean")
    got = so.failure_lockout(df, failures=failures, window_s=window, lock_s=lock)
    assert {r["event_id"]: (r["auth_key"], r["in_window"], r["was_locked"], r["locks"]) for r in got.collect()} == lockouts(rows, failures, window, lock)
    assert so.failure_lockout(df.filter("auth_key = 99")).count() == 0


def test_percentiles_of_a_source_with_as_many_latencies_as_calls(many_ranges):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.9 else None, rng.random(), "e" if i % 9 == 0 else None, i % 2 == 0) for i in range(500)]
    got = rg.api_call_stats(many_ranges.createDataFrame(rows, "source string, latency_ms double, error string, cached boolean")).collect()
    for r in got:
        own = sorted(x[1] for x in rows if x[0] == r["source"])
        assert (r["total"], r["p50"], r["p95"]) == (len(own), own[len(own) // 2], own[len(own) * 95 // 100])
    assert len(got) == 2


def test_features_as_of_a_report_with_most_requests(many_ranges):
    rng = random.Random(6)
    day = lambda i: None if i is None else T0 + timedelta(days=i)
    features = [(rng.choice(["r", "r", "r", "q"]), f"f{rng.randrange(3)}", v, float(v), rng.random() < 0.8, day(rng.choice([None, *range(30)]))) for v in range(120)]
    requests = [(f"p{i}", rng.choice(["r", "r", "r", "q", "none"]), day(rng.choice([None, -1, *range(35)])), {"f0": rng.randrange(120), "f1": rng.randrange(120)} if i % 3 else None) for i in range(150)]
    good = [f for f in features if f[4]]
    for i in range(0, 150, 5):  # snapshots that are there
        r = requests[i][1]
        own = {name: max((f[2] for f in good if f[0] == r and f[1] == name), default=None) for name in ("f0", "f2")}
        requests[i] = (*requests[i][:3], {k: v for k, v in own.items() if v is not None})
    newest = lambda fs: max(fs, key=lambda f: (f[5] is not None, f[5] or T0, f[2]), default=None)

    def seen(r, at):
        own = [f for f in good if f[0] == r and (at is None or f[5] is not None and f[5] <= at)]
        return {name: newest([f for f in own if f[1] == name])[2] for name in {f[1] for f in own}}

    as_of, resolved = {}, {}
    for p, r, at, snap in requests:
        then = seen(r, at)
        as_of |= {(p, name): v for name, v in then.items()}
        exact = {f[1]: f[2] for f in good if f[0] == r and snap and snap.get(f[1]) == f[2]}
        source, found = ("snapshot", exact) if exact and len(exact) == len(snap) else ("as_of", then) if then else ("latest", seen(r, None))
        resolved |= {(p, name): (v, source) for name, v in found.items()}
    f = many_ranges.createDataFrame(features, "report_id string, feature_definition_id string, computation_version int, value double, is_valid boolean, computed_at timestamp")
    q = many_ranges.createDataFrame(requests, "prediction_id string, report_id string, scored_at timestamp, snapshot map<string, int>")
    rows = rg.features_as_of(f, q).collect()
    assert {(r["prediction_id"], r["feature_definition_id"]): r["computation_version"] for r in rows} == as_of and len(rows) == len(as_of)
    rows = rg.feature_snapshot_resolve(f, q).collect()
    assert {(r["prediction_id"], r["feature_definition_id"]): (r["computation_version"], r["source"]) for r in rows} == resolved and len(rows) == len(resolved)
    assert {s for _, s in resolved.values()} == {"snapshot", "as_of", "latest"} and all(r["value"] == r["computation_version"] for r in rows)


def test_labels_of_a_company_with_most_events(many_ranges):
    rng = random.Random(7)
    day = lambda: rng.choice([None, *[(T0 + timedelta(days=rng.randrange(3000))).date()] * 20])
    company = lambda: rng.choice(["k", "k", "k", "j", None])
    reports = [(i, company(), day()) for i in range(200)] + [(200, "k", datetime(2024, 2, 29).date()), (201, "lone", datetime(2024, 1, 1).date())]
    events = [(company(), day()) for _ in range(60)] + [("k", datetime(2024, 2, 29).date())]
    got = rg.label_events(many_ranges.createDataFrame(reports, "id int, krs string, period_end date"), many_ranges.createDataFrame(events, "krs string, event_date date"), 1)
    assert got.columns == ["id", "krs", "period_end", "label"]

    def inside(k, end, e):
        last = end.replace(year=end.year + 1, day=28 if (end.month, end.day) == (2, 29) else end.day)
        return e[0] == k and e[1] is not None and end < e[1] <= last

    want = {i: int(k is not None and end is not None and any(inside(k, end, e) for e in events)) for i, k, end in reports}
    assert {r["id"]: r["label"] for r in got.collect()} == want and 0 < sum(want.values()) < len(want)


def test_what_a_user_may_see(spark):
    users = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "id long, is_active boolean, has_full_access boolean")
    grants = spark.createDataFrame([(2, "k"), (2, "k"), (3, "k")], "user_id long, krs string")
    reports = spark.createDataFrame([("a", "k"), ("b", "j"), ("c", None)], "id string, krs string")
    seen = lambda u: sorted(r["id"] for r in rg.visible_reports(users, grants, reports, u).collect())
    assert (seen(1), seen(2), seen(3), seen(9)) == (["a", "b", "c"], ["a"], [], [])


def test_the_best_run_of_trigrams(spark):
    rng = random.Random(8)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(1, 12))], sorted(set(rng.choices("abcxyz", k=rng.randrange(1, 6))))) for _ in range(300)]
    got = spark.createDataFrame(rows, "_r array<string>, _q array<string>").select("_r", "_q", rg.best_run().alias("s")).collect()
    for r in got:
        q = set(r["_q"])
        runs = [set(r["_r"][a:b]) for a in range(len(r["_r"])) for b in range(a + 1, len(r["_r"]) + 1)]
        best = max(len(x & q) / len(x | q) for x in runs)
        assert (r["s"] or 0.0) == pytest.approx(best)


def test_fuzzy_search_finds_what_trying_all_pairs_finds(spark):
    from ledgerline.functions.scalars import trigrams

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(2, 7)))
    names = spark.createDataFrame([(i, " ".join(["spolka", *(word() for _ in range(rng.randrange(1, 4)))])) for i in range(120)], "id int, name string")
    queries = spark.createDataFrame([(f"spolka {word()} {word()}",) for _ in range(12)] + [("spolka",), ("ab",), (word(),)], "query string")
    got = {(r["query"], r["id"]): r["similarity"] for r in rg.fuzzy_search(names, queries, key="id", name="name").collect()}
    want = {}
    of = lambda df, c: {r[c]: list(r["t"]) for r in df.select(c, trigrams(F.col(c)).alias("t")).collect()}
    named, asked = of(names, "name"), of(queries, "query")
    for r in names.collect():
        for text, t in asked.items():
            seq, q = named[r["name"]], set(t)
            runs = [set(seq[a:b]) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1)]
            best = round(max((len(x & q) / len(x | q) for x in runs), default=0), 6)
            if text.lower() not in r["name"].lower() and best > 0.15:
                want[text, r["id"]] = pytest.approx(best)
    assert got == want and len(want) > 100


def test_fuzzy_search_joins_no_names_back(spark):
    """Names are never a broadcast side, however small Spark takes them to be: what goes to all tasks are the names that pass."""
    names = spark.range(40000).selectExpr("id", "concat(element_at(array('red widget', 'rad bolt', 'cold plate'), cast(id % 3 as int) + 1), if(id % 4000 = 0, cast(id as string), '')) as name")
    queries = spark.createDataFrame([("rad widgt",)], "query string")
    found = rg.fuzzy_search(names, queries, key="id", name="name")
    assert found.count() == found.select("id").distinct().count() > 26000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1 and "aggregate(" not in plan


def test_amounts_meet_predictions_a_row_a_report(spark):
    """Tags of several sections give a row each, and rows of items are exchanged once, not once for each side of a comparison."""
    from ledgerline.functions import catalog
    from ledgerline.operators import analysis as an

    at = datetime(2024, 1, 1)
    reports = spark.createDataFrame([("new", "k", "s", "t", 2021, "completed", 1, at), ("old", "k", "s", "t", 2020, "completed", 1, at)], "id string, krs string, data_source_id string, report_type string, fiscal_year int, ingestion_status string, report_version int, created_at timestamp")
    items = [("new", "A", "Aktywa", 1, 1.0), ("new", "A", "Aktywa", 2, 2.0), ("new", "B", "Aktywa", 1, 3.0), ("old", "A", "Aktywa", 1, 4.0), ("old", "A", "RZiS.L", 1, 5.0)]
    items = spark.createDataFrame(items, "report_id string, section string, tag_path string, extraction_version int, value_current double")
    features = spark.createDataFrame([("new", "roa", 1, 0.5, True, at)], "report_id string, feature_definition_id string, computation_version int, value double, is_valid boolean, computed_at timestamp")
    scores = spark.createDataFrame([("p", "new", "k", "m", 2021, 1.0, "low", at, {"roa": 1})], "id string, report_id string, krs string, model_id string, fiscal_year int, raw_score double, risk_category string, scored_at timestamp, snapshot map<string, int>")
    found = an.prediction_detail(scores, features, reports, items)
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.tag_path, r.section, r.value_current, r.value_prior) for r in found.collect()), key=key)
    want = {"Aktywa": [("Aktywa", "A", 2.0, 4.0), ("Aktywa", "B", 3.0, 4.0)], "RZiS.L": [("RZiS.L", "A", None, 5.0)]}
    assert got == sorted((x for t in next(d[4] for d in catalog.FEATURES if d[0] == "roa") for x in want[t]), key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "tag_path" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_features_as_of_a_report_with_more_versions_than_a_request_carries(many_ranges, monkeypatch):
    for n in (3, 60, 89):
        monkeypatch.setattr(rg, "MANY", n)
        test_features_as_of_a_report_with_most_requests(many_ranges)


def test_versions_meet_requests_a_row_a_report(spark):
    """Requests and versions are dealt by report once, and neither by feature."""
    features = spark.createDataFrame([("r", "roa", 1, 0.5, True, T0)], "report_id string, feature_definition_id string, computation_version int, value double, is_valid boolean, computed_at timestamp")
    requests = spark.createDataFrame([("p", "r", T0, {"roa": 1})], "prediction_id string, report_id string, scored_at timestamp, snapshot map<string, int>")
    found = rg.feature_snapshot_resolve(features, requests)
    assert [tuple(r) for r in found.collect()] == [("p", "roa", 1, 0.5, "snapshot")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Window" not in plan and len(set(found.inputFiles())) <= 4


def test_items_of_predictions_are_dealt_with_numbers_for_tags(spark):
    from ledgerline.plans import QUERIES

    plan = QUERIES["prediction_detail"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert below and all("AS tag#" in line and "tag_path#" not in line.split("array_position")[0] for line in below)
