"""Dimension buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Locales that keep their own region, and the lowest level of each tier.
OWN_REGION_LOCALES = ("en", "es", "me")
TIER_FLOORS = ((13, "golden"), (11, "titanium"), (6, "platinum"), (1, "red"))
NO_TIER = "no"


def home_region(country_code: Column, other: str = "others") -> Column:
    """Home market against the rest of the world; an unknown country is the rest."""
    return F.when(country_code == "TW", F.lit("TW")).otherwise(F.lit(other))


def locale_region(country: Column, locale: Column) -> Column:
    """Country first, then locale; anything unknown is ``others``."""
    return (
        F.when(country == "US", F.lit("na"))
        .when(locale.isin(*OWN_REGION_LOCALES), locale)
        .otherwise(F.lit("others"))
    )


def level_tier(level: Column) -> Column:
    """Tier name of a level; no level, or level 0, is ``no``."""
    tier = F.lit(NO_TIER)
    for floor, name in reversed(TIER_FLOORS):
        tier = F.when(level >= floor, F.lit(name)).otherwise(tier)
    return tier


def payer_flag(revenue: Column) -> Column:
    """True only for a positive amount, so NULL counts as not paying."""
    return F.coalesce(revenue > 0, F.lit(False))
