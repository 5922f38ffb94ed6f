"""Scalar column functions (F*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import catalog


def parse_amount(c: Column) -> Column:
    """amount text to double; missing or invalid is 0."""
    return F.coalesce(optional_amount(c), F.lit(0.0))


def optional_amount(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit(","), F.lit("."))).try_cast("double")


def header_code(raw: Column) -> Column:
    """leading capital letters and digits of a header code; empty is null."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(raw)), r"^([A-Z0-9]+)", 1), F.lit(""))


def detect_schema(code: Column, root_schema: Column) -> Column:
    """by header code, else by root tag, else the default."""
    known = F.create_map(*[F.lit(x) for kv in catalog.HEADER_CODES.items() for x in kv])
    return F.coalesce(known[code], root_schema, F.lit("SFJINZ"))


def unit_multiplier(code: Column, root_tag: Column, default: Column) -> Column:
    """1000 or 1 by the header code's last letter, else by the root tag, else the schema's."""
    root = F.upper(root_tag)
    return F.when(code.endswith("T"), 1000).when(code.endswith("Z"), 1).when(root.contains("WTYS"), 1000).when(root.contains("WZLOT"), 1).otherwise(default)


def section_of_tag(tag: Column) -> Column:
    """F7."""
    return F.when(tag.startswith("CF."), "cash_flow").when(tag.startswith("RZiS."), "rzis").otherwise("bilans")


def is_component(label: Column) -> Column:
    """F6."""
    return label.startswith("(")


def fiscal_year(period_end: Column) -> Column:
    """F8: first four characters as a number; null if they are none."""
    return F.substring(period_end, 1, 4).try_cast("int")


def logical_key(*parts: Column) -> Column:
    """F9."""
    return F.concat_ws("|", *parts)


def pct_change(current: Column, previous: Column) -> Column:
    """change in per cent of the previous amount's size; null if that is 0."""
    return F.round(F.try_divide(current - previous, F.nullif(F.abs(previous), F.lit(0.0))) * 100, 2)


def share_of_parent(value: Column, parent: Column) -> Column:
    """in per cent of the signed parent; null if that is 0."""
    return F.round(F.try_divide(value, F.nullif(parent, F.lit(0.0))) * 100, 4)


def ratio_eps(top: Column, bottom: Column) -> Column:
    """null if the denominator is below a millionth."""
    return F.round(F.when(F.abs(bottom) >= 1e-6, F.try_divide(top, bottom)), 4)


def threshold_label(value: Column, floors: Sequence[tuple[float | None, str]]) -> Column:
    """label of the first floor that value reaches, highest first; null stays null."""
    found = F.lit(None).cast("string")
    for floor, label in reversed(list(floors)):
        found = F.lit(label) if floor is None else F.when(value >= floor, label).otherwise(found)
    return F.when(value.isNotNull(), found)


def formula_tags(formula: Column, required: Column) -> Column:
    """tags named in a formula (those with . or _), then required ones; ordered, each once."""
    named = F.regexp_extract_all(formula, F.lit(r"([A-Za-z]+(?:[._][A-Za-z0-9]+)+)"), F.lit(1))
    return F.array_distinct(F.concat(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(required, F.array().cast("array<string>"))))


def tag_direction(tag: Column) -> Column:
    """true where higher is better, false where worse, null where neither."""
    return F.create_map(*[F.lit(x) for kv in catalog.TAG_DIRECTION.items() for x in kv])[tag]


def interpretation(label: Column, cutoffs: Sequence[tuple]) -> Column:
    """the model's thresholds with is_current on the one that label names."""
    lows = [None, *[c[0] for c in cutoffs[:-1]]]
    steps = [F.struct(F.lit(n).alias("label"), F.lit(lo).cast("double").alias("min"), F.lit(hi).cast("double").alias("max")) for lo, (hi, n, _) in zip(lows, cutoffs, strict=True)]
    return F.transform(F.array(*steps), lambda s: F.struct(s["label"].alias("label"), s["min"].alias("min"), s["max"].alias("max"), (s["label"] == label).alias("is_current")))


def freshness_days(ts: Column, now: Column) -> Column:
    """whole days since ts."""
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400).cast("int")


def shift_period(period: Column) -> Column:
    """an ISO date one year earlier by its text."""
    return F.concat(F.lpad((F.substring(period, 1, 4).cast("int") - 1).cast("string"), 4, "0"), F.substring(period, 5, 20))


def normalize_key(raw: Column) -> Column:
    """Digits padded to ten; anything else is null."""
    t = F.trim(raw.cast("string"))
    return F.when(t.rlike(r"^\d{1,10}$"), F.lpad(t, 10, "0"))


def file_type_class(types: Column) -> Column:
    """Best of a comma-separated list: xml, pdf, other, unknown."""
    has = F.transform(F.split(F.lower(F.coalesce(types, F.lit(""))), ","), lambda x: F.trim(x))
    return F.when(F.array_contains(has, "xml"), "xml").when(F.array_contains(has, "pdf"), "pdf").when(F.array_contains(has, "other"), "other").otherwise("unknown")


def trigrams(name: Column) -> Column:
    """Trigrams in order of lower-case words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
