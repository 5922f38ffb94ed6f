"""Features and scores of reports: one wide row a report, all features as columns, long output for storage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import catalog

Get = Callable[[str], Column]

#: Features that are more than a quotient; null stands for "cannot be computed".
CUSTOM: dict[str, Callable[[Get], Column]] = {}


def register_feature(feature_id: str, required_tags: Sequence[str], make: Callable[[Get], Column]) -> None:
    """V1: register a custom feature; make gets a function from tag to column."""
    CUSTOM[feature_id] = make
    if feature_id not in {f[0] for f in catalog.FEATURES}:
        catalog.FEATURES.append((feature_id, "custom", None, None, list(required_tags)))


def _over(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0.0)))


def _rounded(c: Column) -> Column:
    """round(c, 6), by whole millionths where these are not near a tie or too many to be exact: that is round's result without its decimals."""
    millionths = c * 1e6
    plain = (F.abs(millionths) < 1e12) & (F.abs(millionths - F.floor(millionths) - 0.5) > 1e-3)
    return F.when(plain, F.floor(millionths + 0.5) / 1e6).otherwise(F.round(c, 6))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _quick(v: Get) -> Column:
    return _over(v("Aktywa_B") - _or_zero(v("Aktywa_B_I")), v("Pasywa_B_III"))


def _with_depreciation(profit: str) -> Callable[[Get], Column]:
    return lambda v: _over(v(profit) + _or_zero(v("CF.A_II_1")), v("Pasywa_B"))


def _log(tag: str) -> Callable[[Get], Column]:
    return lambda v: F.when(v(tag) > 0, F.log(v(tag)))


CUSTOM |= {
    "quick_ratio": _quick,
    "x2_poznanski": _quick,
    "log_total_assets": _log("Aktywa"),
    "log_revenue": _log("RZiS.A"),
    "x1_maczynska": _with_depreciation("RZiS.I"),
    "w3_maczynska2006": _with_depreciation("RZiS.L"),
    "x3_poznan": _with_depreciation("RZiS.L"),
    "x3_poznanski": lambda v: _over(v("Pasywa_A") + _or_zero(v("Pasywa_B_II")), v("Aktywa")),
    "x1_poznan": lambda v: _over(v("Aktywa_B") - v("Pasywa_B_III"), v("Aktywa")),
}


def pivot_tags(items: DataFrame, tags: Sequence[str], by: Sequence[str] = ("report_id",)) -> DataFrame:
    """A10: a column per tag; where sections repeat a tag, the last section's value counts."""
    return items.filter(F.col("tag_path").isin(list(tags))).groupBy(*by).agg(*[F.max_by(F.when(F.col("tag_path") == t, F.col("value_current")), F.when(F.col("tag_path") == t, F.col("section"))).alias(t) for t in tags])


def _first_missing(v: Get, tags: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(v(t).isNull(), F.lit(f"missing_tag:{t}")) for t in tags]) if tags else F.lit(None).cast("string")


def feature(definition: tuple, v: Get) -> tuple[Column, Column]:
    """Value and error of a definition (id, logic, numerator, denominator, required tags)."""
    feature_id, logic, top, bottom, required = definition
    if logic == "custom":
        if feature_id not in CUSTOM:
            return F.lit(None).cast("double"), F.lit(f"no_custom_function:{feature_id}")
        value = CUSTOM[feature_id](v)
        return F.round(value, 6), F.when(value.isNull(), F.coalesce(_first_missing(v, required), F.lit("computation_returned_null")))
    if logic == "raw_value":
        if not top:
            return F.lit(None).cast("double"), F.lit("missing_formula")
        return F.round(v(top), 6), _first_missing(v, [top])
    if logic not in ("ratio", "difference"):
        return F.lit(None).cast("double"), F.lit(f"unknown_logic:{logic}")
    if not top or not bottom:
        return F.lit(None).cast("double"), F.lit("missing_formula")
    missing = _first_missing(v, [top, bottom])
    if logic == "difference":
        return F.round(v(top) - v(bottom), 6), missing
    return F.round(_over(v(top), v(bottom)), 6), F.coalesce(missing, F.when(v(bottom) == 0, F.lit("division_by_zero")))


def _as_row(definition: tuple, place: dict[str, int]) -> tuple[int | None, int | None, int | None, Sequence[str], str | None]:
    """What feature does, as numbers: kind (0 quotient, 1 difference, 2 value), places of its operands, tags that it may miss, and what its error is else."""
    feature_id, logic, top, bottom, required = definition
    if logic == "custom":
        return (2, place[feature_id], None, required, "computation_returned_null") if feature_id in CUSTOM else (None, None, None, [], f"no_custom_function:{feature_id}")
    if logic == "raw_value":
        return (2, place[top], None, [top], None) if top else (None, None, None, [], "missing_formula")
    if logic not in ("ratio", "difference"):
        return None, None, None, [], f"unknown_logic:{logic}"
    if not top or not bottom:
        return None, None, None, [], "missing_formula"
    return int(logic == "difference"), place[top], place[bottom], [top, bottom], "division_by_zero" if logic == "ratio" else None


def compute_features(wide: DataFrame, definitions: Sequence[tuple] | None = None, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """By columns, feature_definition_id, value, is_valid, error_message; a row per report and definition.

    Definitions are unfolded as a fixed list of places in an array of a report's values, and one formula reads them: with a
    formula for each, the code of a row is too long a method for the JVM to compile.
    """
    definitions = list(definitions or catalog.FEATURES)
    get = lambda t: F.col(f"`{t}`") if t in wide.columns else F.lit(None).cast("double")
    tags = list(dict.fromkeys(t for d in definitions for t in (d[2], d[3], *d[4]) if t))
    customs = list(dict.fromkeys(d[0] for d in definitions if d[1] == "custom" and d[0] in CUSTOM))
    at_tag, at_custom = {t: i for i, t in enumerate(tags)}, {c: len(tags) + i for i, c in enumerate(customs)}
    read = [_as_row(d, at_custom if d[1] == "custom" else at_tag) for d in definitions]
    most = max(len(r[3]) for r in read)
    number, text = lambda x, n: F.lit(x).cast("int").alias(n), lambda x, n: F.lit(x).cast("string").alias(n)
    made = []
    for d, (kind, a, b, needs, error) in zip(definitions, read, strict=True):
        needs = [*needs, *[None] * (most - len(needs))]
        missed = [c for i, t in enumerate(needs) for c in (number(at_tag.get(t), f"at{i}"), text(t and f"missing_tag:{t}", f"gone{i}"))]
        made.append(F.struct(text(d[0], "id"), number(kind, "kind"), number(a, "a"), number(b, "b"), text(error, "error"), *missed))
    values = F.array(*[get(t).cast("double") for t in tags], *[CUSTOM[c](get).cast("double") for c in customs])
    rows = wide.select(*by, values.alias("_x")).select(*by, "_x", F.explode(F.array(*made)).alias("_d"))
    d = lambda n: F.col("_d")[n]
    x = lambda n: F.get("_x", d(n))
    value = F.when(d("kind") == 0, _over(x("a"), x("b"))).when(d("kind") == 1, x("a") - x("b")).when(d("kind") == 2, x("a"))
    rows = rows.select(*by, "_x", "_d", value.alias("_value"))
    missing = [F.when(d(f"at{i}").isNotNull() & x(f"at{i}").isNull(), d(f"gone{i}")) for i in range(most)]
    error = F.when(F.col("_value").isNull(), F.coalesce(*missing, d("error")))
    rows = rows.select(*by, d("id").alias("feature_definition_id"), _rounded(F.col("_value")).alias("value"), error.alias("error_message"))
    return rows.select(*by, "feature_definition_id", "value", F.col("error_message").isNull().alias("is_valid"), "error_message")


def features_wide(wide: DataFrame, ids: Sequence[str], by: Sequence[str] = ("report_id",)) -> DataFrame:
    """The given features as columns, without the long form in between."""
    get = lambda t: F.col(f"`{t}`") if t in wide.columns else F.lit(None).cast("double")
    of = {d[0]: d for d in catalog.FEATURES}
    return wide.select(*by, *[feature(of[i], get)[0].alias(i) for i in ids])


def scored(model: catalog.LinearModel) -> Column:
    """X8-X13 as a struct of feature columns: model_id, raw_score, classification, risk_category, feature_contributions, warnings.

    Where a feature is missing, raw_score is null. The score is rounded to 6 places after the sum of unrounded terms,
    by whole millionths, so that all engines agree on ties.
    """
    terms = [F.lit(c) * F.col(f) for f, c in model.coefficients.items()]
    total = F.lit(model.intercept or 0.0)
    for t in terms:
        total = total + t
    raw = F.floor(total * 1e6 + 0.5) / 1e6
    names = [*(["_intercept"] if model.intercept is not None else []), *model.coefficients]
    values = [*([F.lit(model.intercept)] if model.intercept is not None else []), *[F.round(t, 6) for t in terms]]
    label, classified = F.lit(model.cutoffs[-1][1]), F.lit(model.cutoffs[-1][2])
    for bound, name, c in reversed(model.cutoffs[:-1]):
        label, classified = F.when(raw < bound, name).otherwise(label), F.when(raw < bound, c).otherwise(classified)
    warnings = F.array().cast("array<string>")
    if model.warning:
        name, above, text, lowered, to = model.warning
        over = F.col(name) > above
        warnings = F.when(over, F.array(F.lit(text))).otherwise(warnings)
        label = F.when(over & (label == lowered), to).otherwise(label)
    return F.struct(
        F.lit(model.model_id).alias("model_id"), raw.alias("raw_score"), classified.alias("classification"), label.alias("risk_category"),
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)).alias("feature_contributions"), warnings.alias("warnings"),
    )


def score(features: DataFrame, model: catalog.LinearModel, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """The scores of one model; reports that lack a feature are left out."""
    return features.dropna(subset=list(model.coefficients)).select(*by, scored(model).alias("s")).select(*by, "s.*")


def score_all(features: DataFrame, models: Sequence[catalog.LinearModel] | None = None, by: Sequence[str] = ("report_id",)) -> DataFrame:
    """All models over one wide table of features, which is read once; columns as scored has them, models that lack a feature left out.

    Models are unfolded as a fixed list, and one formula reads their coefficients and cut-offs, see compute_features.
    """
    models = list(models or catalog.MODELS.values())
    ids = list(dict.fromkeys(f for m in models for f in (*m.coefficients, *([m.warning[0]] if m.warning else []))))
    place = {f: i for i, f in enumerate(ids)}
    most, steps = max(len(m.coefficients) for m in models), max(len(m.cutoffs) for m in models) - 1
    lit = lambda x, kind, n: F.lit(x).cast(kind).alias(n)
    made = []
    for m in models:
        terms, cuts = [*m.coefficients.items(), *[(None, None)] * (most - len(m.coefficients))], [*m.cutoffs[:-1], *[(None, None, None)] * (steps - len(m.cutoffs) + 1)]
        warned = m.warning or (None,) * 5
        made.append(F.struct(
            lit(m.model_id, "string", "model_id"), lit(m.intercept or 0.0, "double", "intercept"), lit(1 if m.intercept is not None else 2, "int", "first"), lit(len(m.coefficients) + (m.intercept is not None), "int", "n"),
            F.array(*map(F.lit, [*(["_intercept"] if m.intercept is not None else []), *m.coefficients])).alias("names"), lit(m.cutoffs[-1][1], "string", "label"), lit(m.cutoffs[-1][2], "int", "class"),
            *[c for i, (f, k) in enumerate(terms) for c in (lit(place.get(f), "int", f"at{i}"), lit(k, "double", f"k{i}"))],
            *[c for i, (bound, name, k) in enumerate(cuts) for c in (lit(bound, "double", f"below{i}"), lit(name, "string", f"label{i}"), lit(k, "int", f"class{i}"))],
            *[lit(x, kind, n) for x, kind, n in zip((place.get(warned[0]), *warned[1:]), ("int", "double", "string", "string", "string"), ("w_at", "w_above", "w_text", "w_low", "w_to"), strict=True)],
        ))
    m = lambda n: F.col("_m")[n]
    rows = features.select(*by, F.array(*[F.col(f).cast("double") for f in ids]).alias("_x")).select(*by, "_x", F.explode(F.array(*made)).alias("_m"))
    terms = [F.when(m(f"at{i}").isNull(), 0.0).otherwise(m(f"k{i}") * F.get("_x", m(f"at{i}"))) for i in range(most)]
    total = m("intercept")
    for t in terms:
        total = total + t
    rows = rows.withColumn("raw_score", F.floor(total * 1e6 + 0.5) / 1e6).filter("raw_score is not null")
    label, classified = m("label"), m("class")
    for i in reversed(range(steps)):
        below = F.col("raw_score") < m(f"below{i}")
        label, classified = F.when(below, m(f"label{i}")).otherwise(label), F.when(below, m(f"class{i}")).otherwise(classified)
    over = F.get("_x", m("w_at")) > m("w_above")
    shares = F.map_from_arrays(m("names"), F.slice(F.array(m("intercept"), *[F.round(t, 6) for t in terms]), m("first"), m("n")))
    rows = rows.withColumn("_label", label)
    return rows.select(
        *by, m("model_id").alias("model_id"), "raw_score", classified.alias("classification"), F.when(over & (F.col("_label") == m("w_low")), m("w_to")).otherwise(F.col("_label")).alias("risk_category"),
        shares.alias("feature_contributions"), F.when(over, F.array(m("w_text"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def report_values(items: DataFrame, *, source: str | None = None, dealt: bool = False) -> DataFrame:
    """The latest values of all catalogue tags, a row per report, as pivot_tags over W3 has them.

    The newest extraction of the last section that has a tag counts: first of each section by version, then of each report
    by section. So most rows meet in buffers of numbers alone, which are hashed, and only a row a section is sorted.
    Items are dealt by report once, unless they are dealt already, as those of a layout by report are.
    source: a column with the report's newest extraction, of all its items.
    """
    own = items if source else items.filter(F.col("tag_path").isin(catalog.TAGS))
    own = own if dealt else own.repartition("report_id")
    tag = lambda t, c: F.when(F.col("tag_path") == t, c)
    version = F.coalesce("extraction_version", F.lit(-(1 << 31)))
    newest = [F.max_by(tag(t, F.col("value_current")), tag(t, version)).alias(t) for t in catalog.TAGS]
    there = [F.count(tag(t, F.lit(1))).cast("int").alias(f"_n {t}") for t in catalog.TAGS]
    more = [F.max("extraction_version").cast("int").alias("_source")] if source else []
    sections = own.groupBy("report_id", "section").agg(*newest, *there, *more)
    values = [F.max_by(f"`{t}`", F.when(F.col(f"`_n {t}`") > 0, F.struct("section"))).alias(t) for t in catalog.TAGS]
    if not source:
        return sections.groupBy("report_id").agg(*values)
    known = F.max(F.greatest(*[F.col(f"`_n {t}`") for t in catalog.TAGS])).alias("_known")
    rows = sections.groupBy("report_id").agg(*values, F.max("_source").alias(source), known)
    return rows.filter("_known > 0").drop("_known")
