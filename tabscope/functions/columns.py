"""Column helpers: quoting, shares and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and labels that decide results.
RARE_SHARE = 0.005
RETAINED_SHARE = 0.80
MISSING_LEVEL = "__MISSING__"
VIF_R_CAP = 0.9999


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def position_in(names: list[str], column: Column) -> Column:
    """1-based place of ``column``'s value in a fixed list of column names."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), column)


def share(part: Column, whole: Column) -> Column:
    """part/whole, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def vif(r: Column) -> Column:
    """Pairwise variance inflation factor for a correlation."""
    capped = F.least(F.abs(r), F.lit(VIF_R_CAP))
    return F.when(r.isNotNull(), 1 / (1 - capped * capped))


def correlation_strength(r: Column) -> Column:
    a = F.abs(F.coalesce(r, F.lit(0.0)))
    return (
        F.when(a > 0.9, "VERY STRONG")
        .when(a > 0.7, "STRONG")
        .when(a > 0.5, "MODERATE")
        .when(a > 0.3, "WEAK")
        .otherwise("NEGLIGIBLE")
    )


def effect_size_label(kind: Column, value: Column) -> Column:
    low = F.when(kind == "eta2", 0.01).otherwise(0.10)
    high = F.when(kind == "eta2", 0.06).otherwise(0.30)
    return F.when(value < low, "weak").when(value < high, "moderate").otherwise("strong")


def imbalance_band(ratio: Column) -> Column:
    return F.when(ratio <= 1.5, "balanced").when(ratio <= 3, "moderate").otherwise("significant")


def skew_label(skew: Column, mean: Column, median: Column) -> Column:
    """Shape label from skewness, or from mean/median when skewness is unknown."""
    side = F.when(skew > 0, "RIGHT").otherwise("LEFT")
    ratio = F.try_divide(mean, median)
    by_ratio = (
        F.when(ratio.isNull(), "undetermined")
        .when(ratio > 1.05, "RIGHT-SKEWED")
        .when(ratio < 0.95, "LEFT-SKEWED or BIMODAL")
        .otherwise("approximately symmetric")
    )
    return (
        F.when(skew.isNull(), by_ratio)
        .when(F.abs(skew) < 0.5, "approximately symmetric")
        .when(F.abs(skew) < 1.0, F.concat(F.lit("slightly "), side, F.lit("-SKEWED")))
        .otherwise(F.concat(side, F.lit("-SKEWED")))
    )
