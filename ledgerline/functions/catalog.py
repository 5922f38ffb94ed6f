"""Feature definitions, feature sets, models and label tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Feature id, computation, numerator tag, denominator tag, required tags.
FEATURES = [
    ("roa", "ratio", "RZiS.L", "Aktywa", ["RZiS.L", "Aktywa"]),
    ("roe", "ratio", "RZiS.L", "Pasywa_A", ["RZiS.L", "Pasywa_A"]),
    ("ros", "ratio", "RZiS.L", "RZiS.A", ["RZiS.L", "RZiS.A"]),
    ("operating_margin", "ratio", "RZiS.F", "RZiS.A", ["RZiS.F", "RZiS.A"]),
    ("gross_margin", "ratio", "RZiS.C", "RZiS.A", ["RZiS.C", "RZiS.A"]),
    ("current_ratio", "ratio", "Aktywa_B", "Pasywa_B_III", ["Aktywa_B", "Pasywa_B_III"]),
    ("quick_ratio", "custom", "Aktywa_B", "Pasywa_B_III", ["Aktywa_B", "Aktywa_B_I", "Pasywa_B_III"]),
    ("cash_ratio", "ratio", "Aktywa_B_III", "Pasywa_B_III", ["Aktywa_B_III", "Pasywa_B_III"]),
    ("debt_ratio", "ratio", "Pasywa_B", "Aktywa", ["Pasywa_B", "Aktywa"]),
    ("equity_ratio", "ratio", "Pasywa_A", "Aktywa", ["Pasywa_A", "Aktywa"]),
    ("debt_to_equity", "ratio", "Pasywa_B", "Pasywa_A", ["Pasywa_B", "Pasywa_A"]),
    ("asset_turnover", "ratio", "RZiS.A", "Aktywa", ["RZiS.A", "Aktywa"]),
    ("receivables_turnover", "ratio", "RZiS.A", "Aktywa_B_II", ["RZiS.A", "Aktywa_B_II"]),
    ("inventory_turnover", "ratio", "RZiS.B", "Aktywa_B_I", ["RZiS.B", "Aktywa_B_I"]),
    ("log_total_assets", "custom", "Aktywa", None, ["Aktywa"]),
    ("log_revenue", "custom", "RZiS.A", None, ["RZiS.A"]),
    ("x1_maczynska", "custom", "RZiS.I", "Pasywa_B", ["RZiS.I", "CF.A_II_1", "Pasywa_B"]),
    ("x2_maczynska", "ratio", "Aktywa", "Pasywa_B", ["Aktywa", "Pasywa_B"]),
    ("x3_maczynska", "ratio", "RZiS.I", "Aktywa", ["RZiS.I", "Aktywa"]),
    ("x4_maczynska", "ratio", "RZiS.I", "RZiS.A", ["RZiS.I", "RZiS.A"]),
    ("x5_maczynska", "ratio", "Aktywa_B_I", "RZiS.A", ["Aktywa_B_I", "RZiS.A"]),
    ("x6_maczynska", "ratio", "RZiS.A", "Aktywa", ["RZiS.A", "Aktywa"]),
    ("x1_poznanski", "ratio", "RZiS.L", "Aktywa", ["RZiS.L", "Aktywa"]),
    ("x2_poznanski", "custom", "Aktywa_B", "Pasywa_B_III", ["Aktywa_B", "Aktywa_B_I", "Pasywa_B_III"]),
    ("x3_poznanski", "custom", "Pasywa_A", "Aktywa", ["Pasywa_A", "Pasywa_B_II", "Aktywa"]),
    ("x4_poznanski", "ratio", "RZiS.C", "RZiS.A", ["RZiS.C", "RZiS.A"]),
    ("w1_maczynska2006", "ratio", "RZiS.F", "Aktywa", ["RZiS.F", "Aktywa"]),
    ("w2_maczynska2006", "ratio", "Pasywa_A", "Aktywa", ["Pasywa_A", "Aktywa"]),
    ("w3_maczynska2006", "custom", "RZiS.L", "Pasywa_B", ["RZiS.L", "CF.A_II_1", "Pasywa_B"]),
    ("w4_maczynska2006", "ratio", "Aktywa_B", "Pasywa_B_III", ["Aktywa_B", "Pasywa_B_III"]),
    ("x1_prusak", "ratio", "RZiS.L", "Aktywa", ["RZiS.L", "Aktywa"]),
    ("x2_prusak", "ratio", "RZiS.B", "Pasywa_B_III", ["RZiS.B", "Pasywa_B_III"]),
    ("x3_prusak", "ratio", "Aktywa_B", "Pasywa_B", ["Aktywa_B", "Pasywa_B"]),
    ("x4_prusak", "ratio", "RZiS.F", "RZiS.A", ["RZiS.F", "RZiS.A"]),
    ("x1_poznan", "custom", "Aktywa_B", "Aktywa", ["Aktywa_B", "Pasywa_B_III", "Aktywa"]),
    ("x2_poznan", "ratio", "RZiS.L", "Aktywa", ["RZiS.L", "Aktywa"]),
    ("x3_poznan", "custom", "RZiS.L", "Pasywa_B", ["RZiS.L", "CF.A_II_1", "Pasywa_B"]),
    ("x4_poznan", "ratio", "Aktywa_B", "Pasywa_B_III", ["Aktywa_B", "Pasywa_B_III"]),
]

# Feature sets in order of their members.
FEATURE_SETS = {
    "basic_20": "roa roe ros operating_margin gross_margin current_ratio quick_ratio cash_ratio debt_ratio equity_ratio debt_to_equity asset_turnover receivables_turnover inventory_turnover log_total_assets log_revenue x1_maczynska x2_maczynska x3_maczynska x4_maczynska".split(),
    "maczynska_6": "x1_maczynska x2_maczynska x3_maczynska x4_maczynska x5_maczynska x6_maczynska".split(),
    "poznanski_4": "x1_poznanski x2_poznanski x3_poznanski x4_poznanski".split(),
    "maczynska2006_4": "w1_maczynska2006 w2_maczynska2006 w3_maczynska2006 w4_maczynska2006".split(),
    "prusak_p1_4": "x1_prusak x2_prusak x3_prusak x4_prusak".split(),
    "poznan_4": "x1_poznan x2_poznan x3_poznan x4_poznan".split(),
}

TAGS = sorted({t for f in FEATURES for t in f[4]})


@dataclass(frozen=True)
class LinearModel:
    """A discriminant score: coefficients, intercept, and ascending (upper bound, label, classification)."""

    model_id: str
    feature_set: str
    coefficients: dict[str, float]
    intercept: float | None
    cutoffs: tuple[tuple[float | None, str, int], ...]
    # (feature, above which value, warning, label that is lowered, to which)
    warning: tuple[str, float, str, str, str] | None = None


def _three(low: float, high: float):
    return ((low, "critical", 1), (high, "medium", 0), (None, "low", 0))


# Published coefficients and cut-offs.
MODELS = {
    m.model_id: m
    for m in (
        LinearModel("maczynska_1994_v1", "maczynska_6", dict(zip(FEATURE_SETS["maczynska_6"], (1.5, 0.08, 10.0, 5.0, 0.3, 0.1), strict=True)), None, ((0, "critical", 1), (1, "high", 1), (2, "medium", 0), (None, "low", 0))),
        LinearModel("poznanski_2004_v1", "poznanski_4", dict(zip(FEATURE_SETS["poznanski_4"], (3.562, 1.588, 4.288, 6.719), strict=True)), -2.368, _three(0, 1), ("x2_poznanski", 4.0, "WARNING_NON_LINEAR_LIQUIDITY", "low", "medium")),
        LinearModel("maczynska_2006_v1", "maczynska2006_4", dict(zip(FEATURE_SETS["maczynska2006_4"], (9.498, 3.566, 2.903, 0.452), strict=True)), -1.498, _three(0, 1)),
        LinearModel("prusak_p1_v1", "prusak_p1_4", dict(zip(FEATURE_SETS["prusak_p1_4"], (6.5245, 0.1480, 0.4061, 2.1754), strict=True)), -1.5685, _three(-0.13, 0.65)),
        LinearModel("poznan_2000_v1", "poznan_4", dict(zip(FEATURE_SETS["poznan_4"], (3.26261, 2.16352, 0.30141, 0.68516), strict=True)), -2.40435, _three(0, 1)),
    )
}


def register_linear_model(model: LinearModel) -> None:
    """Add a model; scoring takes all that are registered."""
    MODELS[model.model_id] = model


# Direction of tags (True: higher is better).
TAG_DIRECTION = {"RZiS.A": True, "RZiS.C": True, "RZiS.F": True, "RZiS.I": True, "RZiS.L": True, "CF.A_II_1": True, "Pasywa_A": True, "Pasywa_B": False, "Aktywa_B_I": False}

# Floors and labels of yearly metrics, highest floor first.
METRIC_LABELS = {
    "equity_ratio": [(50, "Silna baza kapitalowa"), (30, "Umiarkowana"), (None, "Slaba")],
    "current_ratio": [(2, "Dobra plynnosc"), (1, "Wystarczajaca"), (None, "Niska")],
    "operating_margin": [(15, "Zdrowa rentownosc"), (5, "Umiarkowana"), (None, "Niska")],
    "net_margin": [(10, "Zyskowna"), (0, "Umiarkowana"), (None, "Strata")],
    "revenue_growth": [(5, "Wzrost"), (-5, "Stabilna"), (None, "Spadek")],
}

# Header codes and the schema that each stands for.
HEADER_CODES = {"SFJINZ": "SFJINZ", "SFJINT": "SFJINZ", "SFJMAZ": "SFJMAZ", "SFJMAT": "SFJMAZ", "SFJMIZ": "SFJMIZ", "SFJMIT": "SFJMIZ", "SFJOPZ": "SFJOPZ", "SFJOPT": "SFJOPZ", "SFZURT": "SFZURT", "SFZURZ": "SFZURT"}

# The tag of a concept in each schema.
CONCEPT_TAGS = {
    "total_assets": {"SFJINZ": "Aktywa", "SFJMAZ": "Aktywa", "SFJMIZ": "Aktywa", "SFJOPZ": "Aktywa", "SFZURT": "Aktywa"},
    "equity": {"SFJINZ": "Pasywa_A", "SFJMAZ": "Pasywa_A", "SFJMIZ": "Pasywa_A", "SFJOPZ": "Pasywa_A", "SFZURT": "Pasywa_A"},
    "current_assets": {"SFJINZ": "Aktywa_B", "SFJMAZ": "Aktywa_B", "SFJMIZ": "Aktywa_B", "SFJOPZ": "Aktywa_B"},
    "total_liabilities": {"SFJINZ": "Pasywa_B", "SFJMAZ": "Pasywa_B", "SFJMIZ": "Pasywa_B", "SFJOPZ": "Pasywa_B"},
    "short_term_liabilities": {"SFJINZ": "Pasywa_B_III", "SFJMAZ": "Pasywa_B_III", "SFJOPZ": "Pasywa_B_III"},
    "revenue": {"SFJINZ": "RZiS.A", "SFJMAZ": "RZiS.A", "SFJMIZ": "RZiS.A", "SFJOPZ": "RZiS.A", "SFZURT": "RZiS.I"},
    "operating_profit": {"SFJINZ": "RZiS.F", "SFJMAZ": "RZiS.C", "SFJOPZ": "RZiS.H", "SFZURT": "RZiS.XI"},
    "gross_profit": {"SFZURT": "RZiS.XIV"},
    "net_profit": {"SFJINZ": "RZiS.L", "SFJMAZ": "RZiS.J", "SFJMIZ": "RZiS.F", "SFJOPZ": "RZiS.O"},
}


def feature_catalog(spark: SparkSession) -> DataFrame:
    """One row per feature and set that holds it, with its ordinal there (null where no set does)."""
    places = [(s, f, i + 1) for s, fs in FEATURE_SETS.items() for i, f in enumerate(fs)]
    definitions = spark.createDataFrame([(*f,) for f in FEATURES], "id string, computation_logic string, formula_numerator string, formula_denominator string, required_tags array<string>")
    return definitions.join(spark.createDataFrame(places, "feature_set_id string, id string, ordinal int"), "id", "left")


def concept_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, t) for c, of in CONCEPT_TAGS.items() for s, t in of.items()], "concept string, schema_code string, tag_path string")


def threshold_table(spark: SparkSession) -> DataFrame:
    """A row per model and label: the scores from which and below which it holds, in ascending order."""
    rows = [(m.model_id, name, low, high, i) for m in MODELS.values() for i, (low, (high, name, _)) in enumerate(zip([None, *[c[0] for c in m.cutoffs[:-1]]], m.cutoffs, strict=True))]
    real = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(m, n, real(a), real(b), i) for m, n, a, b, i in rows], "model_id string, label string, min_score double, max_score double, ordinal int")


def tag_table(spark: SparkSession) -> DataFrame:
    """A row per feature and tag that it needs."""
    return spark.createDataFrame([(f[0], t) for f in FEATURES for t in f[4]], "feature_definition_id string, tag_path string")
