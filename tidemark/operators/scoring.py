"""Declarative rule scoring: a profile of blockers, contributions and caps becomes one feature map, and tiers that it replays.

A profile lists, in order: ``blockers`` (code, condition): the first that holds
gives tier 0; ``rules`` (name, condition, points) with ``start`` as the first
contribution; an optional clamp between rules, recorded as the difference it
made; ``caps`` (name, condition, tier) on the total clamped to 1..5. Conditions
are Columns, so a profile folds into the plan as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Profile:
    start: Column
    blockers: list[tuple[str, Column]] = field(default_factory=list)
    rules: list[tuple[str, Column, int]] = field(default_factory=list)
    clamp: tuple[str, Column, int] | None = None
    late_rules: list[tuple[str, Column, int]] = field(default_factory=list)
    caps: list[tuple[str, Column, int]] = field(default_factory=list)

    def __post_init__(self):
        names = [n for n, *_ in [*self.rules, *self.late_rules, *self.caps, *([self.clamp] if self.clamp else [])]]
        if len(set(names)) != len(names) or {"start", "raw", "blocker"} & set(names):
            raise ValueError("feature names must be unique and not start, raw or blocker")


def _total(rules: list[tuple[str, Column, int]], onto: Column) -> Column:
    for _, when, points in rules:
        onto = onto + F.when(when, points).otherwise(0)
    return onto


def scored(df: DataFrame, profile: Profile) -> DataFrame:
    """Adds blocker, features (name to points) and tier."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules, late = ([(n, holds(c), p) for n, c, p in r] for r in (profile.rules, profile.late_rules))
    blocker = F.coalesce(*[F.when(holds(c), code) for code, c in profile.blockers], F.lit(None).cast("string"))
    out = df.withColumns({"blocker": blocker, "_early": _total(rules, profile.start)})
    parts = [("start", F.lit(True), profile.start), *((n, c, F.lit(p)) for n, c, p in rules)]
    mid = F.col("_early")
    if profile.clamp:
        name, when, most = profile.clamp
        out = out.withColumn("_delta", F.when(holds(when), F.least(F.lit(most), F.col("_early")) - F.col("_early")))
        parts.append((name, F.col("_delta").isNotNull(), F.col("_delta")))
        mid = mid + F.coalesce("_delta", F.lit(0))
    out = out.withColumn("_raw", _total(late, mid))
    parts += [*((n, c, F.lit(p)) for n, c, p in late), ("raw", F.lit(True), F.col("_raw"))]
    tier = F.greatest(F.lit(1), F.least(F.lit(5), F.col("_raw")))
    for n, when, most in profile.caps:
        fired = holds(when) & (tier > most)
        parts.append((n, fired, F.lit(most)))
        tier = F.when(fired, most).otherwise(tier)
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.when(c, v.cast("int")).alias("v")) for n, c, v in parts]), lambda e: e["v"].isNotNull())
    blocked = F.col("blocker").isNotNull()
    features = F.when(blocked, F.create_map(F.concat(F.lit("blocker:"), "blocker"), F.lit(1))).otherwise(F.map_from_entries(entries))
    return out.withColumns({"features": features, "tier": F.when(blocked, 0).otherwise(tier)}).drop("_early", "_delta", "_raw")


def replayed(features: Column, caps: list[str]) -> Column:
    """The tier from a feature map alone."""
    tier = F.greatest(F.lit(1), F.least(F.lit(5), features["raw"]))
    for n in caps:
        tier = F.least(tier, F.coalesce(features[n], F.lit(5)))
    return F.when(F.exists(F.map_keys(features), lambda k: k.startswith("blocker:")), 0).otherwise(tier)


def contributions_add_up(features: Column, caps: list[str]) -> Column:
    """Whether all contributions sum to the recorded total."""
    total = F.aggregate(F.map_values(F.map_filter(features, lambda k, _: ~k.isin("raw", *caps))), F.lit(0), lambda a, v: a + v)
    return total == features["raw"]


def first_reason(checks: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The reason of the first check that fails, in order."""
    return F.coalesce(*[F.when(c, r) for r, c in checks], F.lit(default).cast("string"))
