"""Registries: feature sets and groups (D3, U4), selectors (E9), models.

Names are looked up in DataFrames so that validation (P11) and the task grid
(J9) are joins, not Python loops over data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import learners

# The fourteen feature sets, in concatenation order.
ALL_FEATURE_SETS = [
    "HSVHistogram", "RGBHistogram", "LBP",
    "R3D",
    "AlexNet", "DenseNet121", "EfficientNetB3", "ResNet50", "VGG", "ViT",
    "audio_c", "audio_o",
    "emotion", "semantic",
]

_HC = ["HSVHistogram", "RGBHistogram", "LBP"]
_DV = ["AlexNet", "DenseNet121", "EfficientNetB3", "ResNet50", "VGG", "ViT"]
_AU = ["audio_c", "audio_o"]
_ES = ["emotion", "semantic"]
_T = ["R3D"]

# The nineteen named groups (name -> sets in order).
FEATURE_GROUPS = {
    "HandCrafted": _HC,
    "DeepVisual": _DV,
    "Audio": _AU,
    "Temporal": _T,
    "EmotionSemantic": _ES,
    "HandCrafted+DeepVisual": _HC + _DV,
    "HandCrafted+Audio": _HC + _AU,
    "HandCrafted+EmotionSemantic": _HC + _ES,
    "DeepVisual+Audio": _DV + _AU,
    "DeepVisual+EmotionSemantic": _DV + _ES,
    "Audio+EmotionSemantic": _AU + _ES,
    "VisualAll": _HC + _T + _DV,
    "HandCrafted+DeepVisual+Audio": _HC + _DV + _AU,
    "HandCrafted+DeepVisual+EmotionSemantic": _HC + _DV + _ES,
    "HandCrafted+Audio+EmotionSemantic": _HC + _AU + _ES,
    "DeepVisual+Audio+EmotionSemantic": _DV + _AU + _ES,
    "VisualAll+Audio": _HC + _T + _DV + _AU,
    "VisualAll+EmotionSemantic": _HC + _T + _DV + _ES,
    "All": list(ALL_FEATURE_SETS),
}

# Flattened widths of the feature sets.
FEATURE_WIDTHS = {
    "HSVHistogram": 72, "RGBHistogram": 72, "LBP": 768, "R3D": 512, "AlexNet": 12288,
    "DenseNet121": 3072, "EfficientNetB3": 4608, "ResNet50": 6144, "VGG": 12288, "ViT": 2304,
    "audio_c": 27, "audio_o": 9, "emotion": 19, "semantic": 7,
}

SELECTORS = learners.SELECTORS
MODELS = learners.MODELS


def all_combinations() -> dict[str, list[str]]:
    """U4: single sets first, then groups; a later name overrides."""
    out = {s: [s] for s in ALL_FEATURE_SETS}
    out.update(FEATURE_GROUPS)
    return out


def combos_table(spark: SparkSession, combos: dict[str, list[str]] | None = None) -> DataFrame:
    """D3 as a DataFrame (combination, feature_sets)."""
    c = combos or all_combinations()
    return spark.createDataFrame(list(c.items()), "combination string, feature_sets array<string>")


def selector(name: str):
    """The design function of a selector name (fold-fitted selection,
    PCA or identity)."""
    if name not in SELECTORS:
        raise ValueError(f"Unknown selector '{name}'. Choose from {SELECTORS}")
    from .plans.evaluate import concat_design
    return lambda rows, sets: concat_design(rows, sets, name)


def model(name: str, d: int, n: int, y_sd: float, trees: int = learners.GBT_TREES):
    """A fresh estimator for a model name."""
    return learners.make_model(name, d, n, y_sd, trees)
