"""Operators over the register of companies, documents and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.scans import in_order, running
from ledgerline.operators.versions import latest
from ledgerline.storage import stage


def documents_current(documents: DataFrame, downloads: DataFrame) -> DataFrame:
    """Discovery with download state where there is one."""
    return documents.join(downloads, "document_id", "left")


def pending_downloads(current: DataFrame, *, without_error: bool = False) -> DataFrame:
    """Documents whose state is false or missing; optionally those without a recorded error alone."""
    rows = current.filter(~F.coalesce("is_downloaded", F.lit(False)))
    return rows.filter(F.col("download_error").isNull()) if without_error else rows


#: Versions of a report that each of its requests carries; those of reports with more are merged with the requests in the order of time.
MANY = 256

#: Orders of the crawl queue, each with a unique tie-break.
CRAWL_ORDERS = {
    "priority": lambda: [F.desc("check_priority"), F.asc_nulls_first("last_checked_on"), F.asc("krs")],
    "oldest": lambda: [F.asc_nulls_first("last_checked_on"), F.asc("krs")],
    "newest": lambda: [F.desc("first_seen_on"), F.asc("krs")],
    "sequential": lambda: [F.asc("krs")],
    "random": lambda: [F.md5(F.concat("krs", F.lit("|42")).cast("binary")), F.asc("krs")],
}


def crawl_queue(companies: DataFrame, as_of: Column, *, strategy: str = "priority", limit: int = 100, max_errors: int = 5, backoff_hours: int = 24) -> DataFrame:
    """Active companies that are not backing off after errors, in the strategy's order."""
    recent = F.col("last_checked_on").cast("timestamp") > as_of - F.make_dt_interval(hours=F.lit(backoff_hours))
    blocked = (F.col("check_error_count") >= max_errors) & F.coalesce(recent, F.lit(False))
    return companies.filter(F.col("is_active") & ~blocked).orderBy(*CRAWL_ORDERS[strategy]()).limit(limit)


def crawl_mode(companies: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """P5: never checked, with errors, or the given keys."""
    if mode == "specific_keys":
        return companies.filter(F.col("krs").isin(list(keys)))
    return companies.filter({"new_only": "last_checked_on is null", "retry_errors": "check_error_count > 0"}[mode])


def sync_budget(companies: DataFrame, known: DataFrame, cutoff: Column, batch: int) -> DataFrame:
    """Half the batch, one at least, to keys never synced, the rest to the stalest of the others."""
    fresh = companies.join(known.select("krs"), "krs", "left_anti").orderBy(F.desc("check_priority"), "krs").limit(max(1, batch // 2)).select("krs", F.lit("new").alias("why"))
    stale = companies.filter(F.col("last_checked_on") < cutoff).join(fresh.select("krs"), "krs", "left_anti").orderBy("last_checked_on", "krs").select("krs", F.lit("stale").alias("why"), "last_checked_on")
    # What the new ones leave of the batch goes to stale ones: both lists are ranked after their own limit.
    both = fresh.withColumn("_at", F.lit(None).cast("date")).unionByName(stale.withColumn("_at", F.col("last_checked_on")).limit(batch).drop("last_checked_on"))
    return both.orderBy(F.asc_nulls_first("_at"), "krs").limit(batch).drop("_at")


def statement_periods(documents: DataFrame) -> DataFrame:
    """One statement document per company and period: corrections before originals, then first seen."""
    ok = documents.filter("rodzaj = 18 and not is_deleted and not coalesce(is_ifrs, true) and okres_end is not null")
    return latest(ok, ["krs", "okres_end"], [F.desc("is_correction"), F.asc("discovered_at"), F.asc("document_id")])


def supplement_periods(periods: DataFrame, reports: DataFrame) -> DataFrame:
    """P10: periods (krs, period_end, source, is_correction), with completed reports' periods that they lack."""
    done = latest(reports.filter("ingestion_status = 'completed'"), ["krs", "period_end"], [F.desc("report_version"), F.desc("id")])
    more = done.select("krs", "period_end", F.lit("db").alias("source"), (F.col("report_version") > 1).alias("is_correction"))
    return periods.unionByName(more.join(periods.select("krs", "period_end"), ["krs", "period_end"], "left_anti"))


def key_search(companies: DataFrame, query: str) -> DataFrame:
    """by number: ten digits or more exactly, a leading 0 as prefix, else padded."""
    digits = "".join(c for c in query if c.isdigit())
    if len(digits) >= 10:
        return companies.filter(F.col("krs") == digits[:10])
    return companies.filter(F.col("krs").startswith(digits) if digits.startswith("0") else F.col("krs") == digits.zfill(10))


def name_search(companies: DataFrame, query: str, limit: int) -> DataFrame:
    """names that contain query in any case; those with data first, then prefixes, then by name. total counts all."""
    hits = companies.filter(F.lower("name").contains(query.lower()))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    top = hits.orderBy(F.desc("has_data"), F.desc(F.lower("name").startswith(query.lower())), "name", "krs").limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def fuzzy_search(names: DataFrame, queries: DataFrame, *, key: str, name: str, at_least: float = 0.15) -> DataFrame:
    """pairs (query, key, similarity) above at_least, names that contain the query left out.

    Similarity is the best set overlap between the query's trigrams and a run of the name's trigrams in order. A name that
    passes shares more than at_least of the query's n trigrams, k at least, so it has one of any n - k + 1 of them: those
    that fewest names have are looked up in the inverted index, and the common ones are no keys. (Where k is 1 each
    trigram must be looked up, as each name that has it passes.)
    """
    from ledgerline.functions.scalars import trigrams

    n = names.select(F.col(name).alias("_name")).distinct().withColumn("_r", trigrams(F.col("_name")))
    q = queries.select("query", F.array_distinct(trigrams(F.col("query"))).alias("_q")).distinct()
    index = n.select("*", F.explode(F.array_distinct("_r")).alias("_t"))
    held = index.groupBy("_t").agg(F.count(F.lit(1)).alias("_held"))
    asked = q.select("query", "_q", F.size("_q").alias("_n"), F.explode("_q").alias("_t")).join(held, "_t", "left")
    rarest = F.row_number().over(W.partitionBy("query").orderBy(F.col("_held").asc_nulls_first(), "_t"))
    asked = asked.withColumn("_rank", rarest).filter((F.col("_rank") <= F.col("_n") - F.floor(F.col("_n") * at_least + 1e-9)) & F.col("_held").isNotNull())
    asked = stage(asked.select("query", "_q", "_t", F.collect_list("_t").over(W.partitionBy("query")).alias("_asked")), "fuzzy-asked")
    # Names go to the queries' trigrams with all that is needed, and count under the first one that they share: nothing is joined back.
    first = F.get(F.filter("_r", lambda t: F.array_contains("_asked", t)), F.lit(0))
    both = index.join(asked, "_t").filter(first == F.col("_t")).filter(~F.lower("_name").contains(F.lower("query")))
    best = both.select("query", "_name", F.round(best_run(), 6).alias("similarity")).filter(F.col("similarity") > at_least)
    # Equal names are walked once; the table's rows take what their name has.
    return names.select(key, F.col(name).alias("_name")).join(stage(best, "fuzzy-best"), "_name").select("query", key, "similarity")


def best_run(r: str = "_r", q: str = "_q") -> Column:
    """The largest overlap of the set q with the set of a run of r: the size of what both have over that of what either has.

    The best run begins and ends with a member of q. From each that begins one, r is walked once with counts of what the
    run has seen, an element for the first time in the run if the one before like it stands before the begin.
    """
    return F.expr(f"""array_max(transform(filter(sequence(0, size({r}) - 1), a -> array_contains({q}, {r}[a])), a -> aggregate(
        slice(transform({r}, (t, i) -> struct(array_contains({q}, t) as m, i - coalesce(nullif(array_position(reverse(slice({r}, 1, i)), t), 0), i + 1) as p)), a + 1, size({r}) - a),
        named_struct('k', 0, 'u', size({q}), 'b', cast(0 as double)),
        (s, x) -> named_struct('k', s.k + if(x.m and x.p < a, 1, 0), 'u', s.u + if(not x.m and x.p < a, 1, 0),
            'b', greatest(s.b, if(x.m, (s.k + if(x.p < a, 1, 0)) / s.u, cast(0 as double)))),
        s -> s.b)))""")  # fmt: skip


def api_call_stats(calls: DataFrame, last: int | None = None) -> DataFrame:
    """Totals, rates to 4 places and percentiles at index floor(n p / 100), by source.

    Percentiles come from running counts over distinct latencies in order, dealt by ranges of them, so neither a source's
    calls nor its latencies meet in one task.
    """
    if last:
        calls = latest_n(calls, last)
    flag = lambda c: F.sum(c.cast("long"))
    by = calls.groupBy("source", "latency_ms").agg(F.count(F.lit(1)).alias("k"), flag(F.col("error").isNotNull()).alias("e"), flag(F.col("cached")).alias("h"))
    ranked = running(in_order(by, ["source"], ["latency_ms"]), ["source"], {"_to": ("sum", F.col("k"))})
    ranked = ranked.join(by.groupBy("source").agg(F.sum("k").alias("_n")).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    at = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    value = lambda p: F.min(F.when(F.col("_to") > at(p), F.col("latency_ms")))
    rate = lambda c: F.round(F.sum(c) / F.sum("k"), 4)
    return ranked.groupBy("source").agg(F.sum("k").alias("total"), rate("e").alias("error_rate"), rate("h").alias("cache_hit_rate"), value(50).alias("p50"), value(95).alias("p95"))


def latest_n(log: DataFrame, n: int) -> DataFrame:
    """The newest n rows of a log by (ts, event_id)."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def scoring_gaps(models: DataFrame, reports: DataFrame, scored: DataFrame) -> DataFrame:
    """Active models x completed reports that are not scored. The models are a few registry rows."""
    grid = reports.filter("ingestion_status = 'completed'").select(F.col("id").alias("report_id")).crossJoin(F.broadcast(models.filter("is_active").select(F.col("id").alias("model_id"))))
    return grid.join(scored.select("model_id", "report_id").distinct(), ["model_id", "report_id"], "left_anti")


def label_events(reports: DataFrame, events: DataFrame, years: int) -> DataFrame:
    """Reports with label 1 if an event of their company falls after period_end, within years of it.

    A sweep from the last day to the first carries the next event to each period end of a company: rows are period ends and
    events, not their pairs, and a company with a million events is dealt over tasks.
    """
    ends = reports.select("krs", F.col("period_end").cast("date").alias("at"), F.lit(0).alias("kind")).distinct()
    days = events.filter("krs is not null and event_date is not null").select("krs", F.col("event_date").cast("date").alias("at"), F.lit(1).alias("kind")).distinct()
    rows = in_order(ends.unionByName(days).withColumn("back", -F.unix_date("at")), ["krs"], ["back", "kind"])
    rows = running(rows, ["krs"], {"next": ("last", F.when(F.col("kind") == 1, F.col("at")))})
    labels = rows.filter("kind = 0").select(F.col("krs").alias("_krs"), F.col("at").alias("_end"), (F.col("next") <= F.add_months("at", 12 * years)).cast("int").alias("_hit"))
    found = reports.join(labels, (F.col("krs") == F.col("_krs")) & (F.col("period_end").cast("date") == F.col("_end")), "left")
    return found.withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_krs", "_end", "_hit")


def confirmed_events(events: DataFrame) -> DataFrame:
    """X21."""
    return events.filter(F.col("is_confirmed") | F.col("event_type").isin("bankruptcy", "restructuring"))


def features_at_version(features: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots (prediction_id, report_id, snapshot map feature -> version) to the valid features of those versions."""
    wanted = snapshots.select("prediction_id", "report_id", F.explode("snapshot").alias("feature_definition_id", "computation_version"))
    return wanted.join(features.filter("is_valid"), ["report_id", "feature_definition_id", "computation_version"])


def visible_reports(users: DataFrame, grants: DataFrame, reports: DataFrame, user_id: int) -> DataFrame:
    """The reports that a user may see: all with full access, else those of companies granted; none for a user who is not active or not known."""
    user = users.filter((F.col("id") == user_id) & F.col("is_active")).select("has_full_access").first()
    if user and user["has_full_access"]:
        return reports
    own = grants.filter(F.col("user_id") == user_id).select("krs").distinct()
    return reports.join(own if user else own.limit(0), "krs", "left_semi").select(reports.columns)


def _with_versions(features: DataFrame, requests: DataFrame, **carried: Column) -> DataFrame:
    """For each request (prediction_id, report_id, scored_at) and each feature of its report: then, the newest valid version (computed_at, computation_version, value) as of scored_at, and newest, of all.

    Requests and versions are merged in the order of time, and the newest version so far is carried along: rows grow with
    versions and with what is asked for, not with their product. A request without a time sees all. carried: columns of a
    request and a feature that go along instead of the request's own others.
    """
    version = F.struct("computed_at", "computation_version", "value")
    valid = features.filter("is_valid").select("report_id", "feature_definition_id", "computed_at", version.alias("version"))
    newest = valid.groupBy("report_id", "feature_definition_id").agg(F.max("version").alias("newest"))
    asked = requests.join(newest, "report_id").select("prediction_id", "report_id", F.col("scored_at").alias("at"), "feature_definition_id", "newest", *[c.alias(n) for n, c in carried.items()])
    # What has no time comes after all that has: versions for requests without a time alone.
    rows = valid.select("report_id", "feature_definition_id", F.col("computed_at").alias("at"), F.lit(0).alias("kind"), "version")
    rows = rows.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True).withColumn("never", F.col("at").isNull())
    key = ["report_id", "feature_definition_id"]
    rows = running(in_order(rows, key, ["never", "at", "kind", "prediction_id"]), key, {"then": ("max", F.col("version"))})
    return rows.filter("kind = 1").select("prediction_id", "report_id", "feature_definition_id", "then", "newest", *carried)


def _beside(features: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """requests with versions, the sorted valid (feature_definition_id, computed_at, computation_version, value) of their report, and the reports of more than MANY, if any, whose requests are left out.

    A report's versions are one row, written once; a window of MANY and one bounds what a task gathers of a report.
    """
    version = ["feature_definition_id", "computed_at", "computation_version", "value"]
    some = F.row_number().over(W.partitionBy("report_id").orderBy("computed_at"))
    few = features.filter("is_valid").select("report_id", *version, some.alias("_n")).filter(F.col("_n") <= MANY + 1)
    by = stage(few.groupBy("report_id").agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct(*version))).alias("versions")), "versions")
    many = by.filter(F.col("_n") > MANY).select("report_id")
    return requests.join(by.filter(F.col("_n") <= MANY).select("report_id", "versions"), "report_id"), None if many.isEmpty() else many


def _newest(versions: str) -> Column:
    """The last of each feature of sorted versions."""
    name = lambda v: v["feature_definition_id"]
    return F.filter(versions, lambda v, i: (i == F.size(versions) - 1) | ~name(F.get(versions, i + 1)).eqNullSafe(name(v)))


def _seen() -> Column:
    """Of versions, what was there at scored_at; all without a time."""
    return F.filter("versions", lambda v: F.col("scored_at").isNull() | (v["computed_at"] <= F.col("scored_at")))


def features_as_of(features: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (prediction_id, report_id, scored_at), the newest valid features computed by then; null means now."""
    asked = requests.select("prediction_id", "report_id", "scored_at")
    rows, many = _beside(features, asked)
    columns = ["prediction_id", "report_id", "feature_definition_id", "computed_at", "computation_version", "value"]
    found = rows.withColumn("_seen", _seen()).select("prediction_id", "report_id", F.inline(_newest("_seen"))).select(columns)
    if many is None:
        return found
    merged = _with_versions(features.join(many, "report_id", "left_semi"), asked.join(many, "report_id", "left_semi")).filter("then is not null")
    return found.unionByName(merged.select("prediction_id", "report_id", "feature_definition_id", "then.*"))


def resolved_snapshots(features: DataFrame, requests: DataFrame) -> DataFrame:
    """J7 with a row a request: requests (prediction_id, report_id, scored_at, snapshot, and more) and found, its (feature_definition_id, computation_version, value, source); none without any."""
    rows, many = _beside(features, requests)
    exact = F.filter("versions", lambda v: v["computation_version"] == F.col("snapshot")[v["feature_definition_id"]])
    rows = rows.withColumn("_exact", exact).withColumn("_seen", _seen())
    source = F.when((F.size("_exact") > 0) & (F.size("_exact") == F.size("snapshot")), "snapshot").when(F.size("_seen") > 0, "as_of").otherwise("latest")
    rows = rows.withColumn("_source", source)
    chosen = F.when(F.col("_source") == "snapshot", F.col("_exact")).when(F.col("_source") == "as_of", _newest("_seen")).otherwise(_newest("versions"))
    columns = ["feature_definition_id", "computation_version", "value"]
    found = rows.select(*requests.columns, F.transform(chosen, lambda v: F.struct(*[v[c].alias(c) for c in columns], F.col("_source").alias("source"))).alias("found"))
    if many is None:
        return found
    asked = requests.join(many, "report_id", "left_semi")
    merged = _merged_snapshots(features.join(many, "report_id", "left_semi"), asked).groupBy("prediction_id").agg(F.collect_list(F.struct(*columns, "source")).alias("found"))
    return found.unionByName(asked.join(merged, "prediction_id"))


def feature_snapshot_resolve(features: DataFrame, requests: DataFrame) -> DataFrame:
    """By snapshot if all its features are there, else as of scoring, else the newest; source says which."""
    return resolved_snapshots(features, requests.select("prediction_id", "report_id", "scored_at", "snapshot")).select("prediction_id", F.inline("found"))


def _merged_snapshots(features: DataFrame, requests: DataFrame) -> DataFrame:
    """feature_snapshot_resolve by a merge in the order of time, for reports of any number of versions."""
    asked = F.col("snapshot")[F.col("feature_definition_id")]
    rows = _with_versions(features, requests.select("prediction_id", "report_id", "scored_at", "snapshot"), computation_version=asked, _size=F.size("snapshot"))
    exact = features.filter("is_valid").select("report_id", "feature_definition_id", "computation_version", F.struct("computation_version", "value").alias("exact"))
    rows = rows.join(exact, ["report_id", "feature_definition_id", "computation_version"], "left").drop("computation_version")
    own = W.partitionBy("prediction_id")
    rows = rows.withColumn("_n", F.count("exact").over(own)).withColumn("_any", F.count("then").over(own))
    source = F.when((F.col("_n") > 0) & (F.col("_n") == F.col("_size")), "snapshot").when(F.col("_any") > 0, "as_of").otherwise("latest")
    version = lambda c: F.struct(f"{c}.computation_version", f"{c}.value")
    chosen = F.when(F.col("source") == "snapshot", F.col("exact")).when(F.col("source") == "latest", version("newest")).when(F.col("then").isNotNull(), version("then"))
    rows = rows.withColumn("source", source).withColumn("chosen", chosen).filter("chosen is not null")
    return rows.select("prediction_id", "feature_definition_id", "chosen.computation_version", "chosen.value", "source")


def prior_year_report(reports: DataFrame) -> DataFrame:
    """Each report with the best completed report of the year before of its company, source and type."""
    prev = reports.filter("ingestion_status = 'completed'").select("krs", "data_source_id", "report_type", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("id").alias("prior_id"), F.col("report_version").alias("_v"), F.col("created_at").alias("_c"))
    best = latest(prev, ["krs", "data_source_id", "report_type", "fiscal_year"], [F.desc("_v"), F.desc("_c"), F.desc("prior_id")]).drop("_v", "_c")
    return reports.join(best, ["krs", "data_source_id", "report_type", "fiscal_year"], "left")


def dataset_stats(matrix: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row of totals, class balance and missing shares; features without any value do not count."""
    share = [F.round(F.avg(F.col(f).isNull().cast("double")) * 100, 1).alias(f"missing_{f}") for f in features]
    one = matrix.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(label).alias("positives"), F.countDistinct("krs").alias("companies"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), *share, *[F.count(f).alias(f"_n_{f}") for f in features])
    single = matrix.groupBy("krs").agg(F.countDistinct("fiscal_year").alias("n")).filter("n = 1").agg(F.count(F.lit(1)).alias("single_year_companies"))
    mostly = sum((F.when((F.col(f"_n_{f}") > 0) & (F.col(f"missing_{f}") > 50), 1).otherwise(0) for f in features), F.lit(0))
    return one.withColumn("mostly_missing", mostly).drop(*[f"_n_{f}" for f in features]).crossJoin(F.broadcast(single))  # one row each


def not_found_ranges(keys: DataFrame, *, block: int = 1_000_000) -> DataFrame:
    """Q2: runs of consecutive keys with one status: status, first, last, n.

    The row number runs within blocks of keys. Only runs that touch the border of their block, two a block at most, can
    go on in the next; these alone are then joined, so no task sees all keys however the statuses alternate.
    """
    island = F.col("key") - F.row_number().over(W.partitionBy("_b", "status").orderBy("key"))
    runs = keys.withColumn("_b", F.floor(F.col("key") / block)).withColumn("_i", island).groupBy("_b", "status", "_i").agg(F.min("key").alias("first"), F.max("key").alias("last")).select("status", "first", "last")
    at_border = (F.pmod("first", F.lit(block)) == 0) | (F.pmod("last", F.lit(block)) == block - 1)
    w = W.partitionBy("status").orderBy("first")
    starts = F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)
    joined = runs.filter(at_border).withColumn("_new", starts).withColumn("_g", F.sum("_new").over(w)).groupBy("status", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.filter(~at_border).unionByName(joined.drop("_g")).select("status", "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))
