"""Calibration of scores against outcomes: a small logistic model, and the verdicts that may move a tier.

The fit follows a fixed recipe (standardised features, zero start, full-batch
gradient steps). Rows with equal features move the model alike, so they are counted
once, in one aggregate; the steps then run over the distinct feature vectors: on
the driver where their number is within ``VECTORS``, else as one partial aggregate
of (features + 1) sums a step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTROLS, json_value, sigmoid
from ..sources.scratch import dropped, written
from .cells import rate

#: Distinct feature vectors that the driver takes; more of them stay where they are.
VECTORS = 1 << 16


def standardizer(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; 1 where a feature is constant."""
    row = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


def linear(scales: dict, weights: dict[str, float], bias: float) -> Column:
    return reduce(Column.__add__, [(F.col(f).cast("double") - m) / s * weights[f] for f, (m, s) in scales.items()], F.lit(bias))


def fit_logistic(train: DataFrame, features: list[str], label: str, steps: int = 400, rate_: float = 0.5) -> tuple[dict, dict[str, float], float]:
    """(scales, weights, bias) after ``steps`` full gradient steps from zero. Rows that lack a feature or the label move nothing; without rows all weights are 0."""
    scales = standardizer(train, features)
    standard = [((F.col(f).cast("double") - m) / s).alias(f) for f, (m, s) in scales.items()]
    vectors = written(train.select(*standard, F.col(label).cast("double").alias("_y")).dropna().groupBy(*features).agg(F.count("*").alias("_n"), F.sum("_y").alias("_y")), "vectors")
    distinct, total = vectors.agg(F.count("*"), F.sum("_n")).first()
    weights, bias = np.zeros(len(features)), 0.0
    if distinct <= VECTORS:
        table = vectors.select(*features, "_n", "_y").toPandas().to_numpy(dtype=float)
        x, n, y = table[:, :-2], table[:, -2], table[:, -1]

        def gradient() -> tuple[float, np.ndarray]:
            error = n / (1 + np.exp(-np.clip(x @ weights + bias, -500, 500))) - y
            return error.sum() / total, error @ x / total
    else:

        def gradient() -> tuple[float, np.ndarray]:
            error = F.col("_n") * sigmoid(reduce(Column.__add__, [F.col(f) * float(w) for f, w in zip(features, weights, strict=True)], F.lit(float(bias)))) - F.col("_y")
            row = vectors.agg(F.sum(error), *[F.sum(error * F.col(f)) for f in features]).first()
            return row[0] / total, np.array(row[1:]) / total

    for _ in range(steps if total else 0):
        move, moves = gradient()
        bias, weights = bias - rate_ * move, weights - rate_ * moves
    dropped(vectors)
    return scales, {f: float(w) for f, w in zip(features, weights, strict=True)}, float(bias)


def brier(df: DataFrame, prediction: Column, label: str) -> Column:
    return F.avg(F.pow(prediction - F.col(label), 2))


def admitted(model: float | None, cells: float | None, base: float | None) -> bool:
    """A model is shown only if it is strictly better than both baselines."""
    return None not in (model, cells, base) and model < cells and model < base


def ghost(df: DataFrame, since: str, response: str, as_of: Column, days: int = 21) -> DataFrame:
    mature = df.filter(F.datediff(as_of, F.col(since)) >= days)
    out = mature.agg(F.count("*").alias("mature"), F.count_if(F.col(response).isNull()).alias("ghosts"))
    return out.withColumn("ghost_rate", rate(F.col("ghosts"), F.col("mature")))


# The closed schema of a verdict.
VERDICT_KEYS, CONFIDENCES, MOST_WHY = ["tier", "why", "confidence"], ["high", "medium", "low"], 400


def verdicts(df: DataFrame, raw: str) -> DataFrame:
    """Strictly parsed review verdicts: the verdict, or why it is refused.

    The whole text must be one JSON object of exactly the three keys, with a
    whole tier of 1 to 5, a known confidence and a text of at most MOST_WHY
    characters that is not blank; nothing is repaired.
    """
    text = F.regexp_replace(F.col(raw), r"^\s+|\s+$", "")
    doc, keys = json_value(text), F.json_object_keys(text)
    expected = F.array(*map(F.lit, VERDICT_KEYS))
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")), F.lit("VOID"))
    value = lambda name, type_: F.try_variant_get(doc, f"$.{name}", type_)
    why = value("why", "string")
    clean = F.trim(F.replace(F.regexp_replace(F.regexp_replace(why, CONTROLS, " "), r"[ \t]+", " "), F.lit("\n"), F.lit(" ")))
    refused = (
        F.when(F.col(raw).isNull(), "not_text")
        .when(text == "", "empty")
        .when(doc.isNull(), "not_json")
        .when(keys.isNull(), "not_object")
        .when(F.size(F.array_except(keys, expected)) > 0, "unknown_keys")
        .when(F.size(F.array_except(expected, keys)) > 0, "missing_keys")
        .when(kind("tier") != "BIGINT", "tier_type")
        .when(~value("tier", "long").between(1, 5), "tier_range")
        .when((kind("confidence") != "STRING") | ~value("confidence", "string").isin(CONFIDENCES), "confidence_value")
        .when(kind("why") != "STRING", "why_type")
        .when(F.length(why) > MOST_WHY, "why_length")
        .when(clean == "", "why_empty")
    )
    verdict = F.struct(value("tier", "int").alias("tier"), value("confidence", "string").alias("confidence"), clean.alias("why"))
    return df.withColumn("refused", refused).withColumn("verdict", F.when(F.col("refused").isNull(), verdict))


def applied(tier: Column, verdict: Column) -> Column:
    """A downgrade always counts; a raise only with high confidence, or from 3 to 4."""
    new = verdict["tier"]
    return F.when(new.isNull(), tier).when(new < tier, new).when((new > tier) & ((verdict["confidence"] == "high") | ((tier == 3) & (new == 4))), new).otherwise(tier)


def gated(tier: Column, picked: Column) -> Column:
    """Tier 5 is kept for picks: a pick is 5, another 5 is 4."""
    return F.when(picked, 5).when(tier == 5, 4).otherwise(tier)


def match_labels(features: Column, has_long_text: Column) -> tuple[Column, Column]:
    """(fit, competition) labels off one feature map, the most decisive feature first."""
    has = lambda *names: F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(features, n))
    fit = F.when(has("staff_principal"), "Level stretch").when(has("skills_strong", "exact_stack"), "Strong match").when(has("skills_thin"), "Weak match").when(~has_long_text, "Unscored").otherwise("Moderate match")
    competition = F.when(has("high_competition", "comp_high_bar", "degree_gated"), "High competition").when(has("staffing_w2"), "Lower bar").otherwise("Standard")
    return fit, competition
