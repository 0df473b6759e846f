"""Model parameters, their legacy completion, and loading of user-supplied taxonomies."""

from __future__ import annotations

import copy
import json
from typing import Any

# ---- fixed values: default parameter set ----------------------------------------------------------
NEWS_PARAMS: dict[str, Any] = {
    "min_relevance": 0.30,
    "recency_half_life_scale": 1.0,
    "shrinkage_k": 1.0,
    "corroboration_bonus": 0.15,
    "max_lookback_days": 120,
    "macro_weight_in_index": 0.40,
    "neutral_band": 15,
    "price_report_weight": 0.0,
    "baseline_days": 60,
    "min_baseline_n": 10,
}
MODEL_PARAMS: dict[str, Any] = {
    "model": "factor",
    "sentiment_input": "relative",
    "w_company": 1.0,
    "w_macro": 0.5,
    "w_index": 0.3,
    "sensitivity": 0.5,
    "drift_weight": 0.0,
    "vol_lookback_days": 60,
    "drift_lookback_days": 250,
    "beta_lookback_days": 250,
    "min_history_days": 20,
    "max_sigma_clip": 3.0,
    "neutral_threshold_sigma": 0.10,
}
SOURCE_RELIABILITY: dict[str, float] = {
    "default": 0.6,
    "reuters": 0.95,
    "bloomberg": 0.95,
    "economic times": 0.85,
    "the economic times": 0.85,
    "mint": 0.85,
    "livemint": 0.85,
    "business standard": 0.85,
    "moneycontrol": 0.8,
    "financial express": 0.8,
    "cnbc": 0.8,
    "the hindu businessline": 0.8,
    "ndtv profit": 0.75,
    "press trust of india": 0.85,
    "pti": 0.85,
}
# Values reproducing parameter sets written before a key existed.
LEGACY_VALUES: dict[str, dict[str, Any]] = {
    "news": {"price_report_weight": 1.0, "baseline_days": 60, "min_baseline_n": 10},
    "model": {"model": "factor", "sentiment_input": "raw"},
}
# Random-search bounds.
SEARCH_SPACE: dict[str, tuple[float, float]] = {
    "news.recency_half_life_scale": (0.25, 3.0),
    "news.shrinkage_k": (0.2, 5.0),
    "news.macro_weight_in_index": (0.0, 0.8),
    "model.w_company": (0.0, 2.0),
    "model.w_macro": (0.0, 1.5),
    "model.w_index": (0.0, 1.5),
    "model.sensitivity": (0.0, 1.5),
    "model.drift_weight": (0.0, 1.0),
    "news.price_report_weight": (0.0, 1.0),
    "news.baseline_days": (20, 90),
}
# Defaults outside any taxonomy category: (category, base strength, half-life in days).
DEFAULT_COMPANY_CATEGORY = ("other", 0.5, 5.0)
PRICE_ACTION_CATEGORY = ("price_action", 0.3, 2.0)
# ---- end of fixed values --------------------------------------------------------------------------


def default_params() -> dict[str, dict[str, Any]]:
    return {
        "news": {**NEWS_PARAMS, "source_reliability": dict(SOURCE_RELIABILITY)},
        "model": dict(MODEL_PARAMS),
    }


def complete(params: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Fill keys an older parameter set lacks with behaviour-preserving values."""
    merged = {section: {**values, **params.get(section, {})} for section, values in LEGACY_VALUES.items()}
    return {**copy.deepcopy(params), **copy.deepcopy(merged)}


def load_taxonomy(path: str) -> list[dict[str, Any]]:
    """Read a taxonomy file (JSON, or YAML when PyYAML is installed) into rows for ``taxonomy_frame``.

    Expected shape: ``categories: {name: {scope, base_strength, half_life_days, keywords: [...]}}``.
    """
    with open(path, encoding="utf-8") as fh:
        if path.endswith(".json"):
            doc = json.load(fh)
        else:
            import yaml

            doc = yaml.safe_load(fh)
    return [
        {
            "category": name,
            "position": i,
            "scope": spec["scope"],
            "base_strength": float(spec["base_strength"]),
            "half_life_days": float(spec["half_life_days"]),
            "keywords": list(spec["keywords"]),
        }
        for i, (name, spec) in enumerate(doc["categories"].items())
    ]
