"""Regular grids over item coordinates and point-colour statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.text import foreground

# Cell edge in target pixels, target resolution, fallback
# numerator for an objective power, least covered share of a cell, and the
# thresholds of the white and dark pixel rules.
CELL_PIXELS = 256
TARGET_RESOLUTION = 0.5
OBJECTIVE_BASE = 10.0
MIN_COVERAGE = 0.70
WHITE_LEVEL = 240
DARK_LEVEL = 20


def native_resolution(resolution: Column, objective: Column) -> Column:
    """Stated resolution, else 10 / objective power, else NULL."""
    r = resolution.try_cast("double")
    o = objective.try_cast("double")
    return F.coalesce(F.when(r > 0, r), F.try_divide(F.lit(OBJECTIVE_BASE), F.when(o > 0, o)))


def grid_step(resolution: Column) -> Column:
    return F.bround(F.lit(CELL_PIXELS * TARGET_RESOLUTION) / resolution).cast("bigint")


def covered_cells(points: DataFrame, bag: Sequence[str], x: str, y: str, mask: Column, step: Column, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Cells of each bag whose mean mask reaches the coverage limit."""
    cx = F.floor(F.col(x) / step).cast("bigint")
    cy = F.floor(F.col(y) / step).cast("bigint")
    g = (points.groupBy(*bag, cx.alias("cell_x"), cy.alias("cell_y"))
         .agg(F.avg(mask.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_points")))
    return g.where(F.col("coverage") >= min_coverage)


def colour_statistics(points: DataFrame, item: Sequence[str], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Share of white, dark and foreground points and mean saturation per item."""
    rr, gg, bb = F.col(r), F.col(g), F.col(b)
    gray = (rr + gg + bb) / F.lit(3.0)
    sat = F.greatest(rr, gg, bb) - F.least(rr, gg, bb)
    return points.groupBy(*item).agg(
        F.avg((F.least(rr, gg, bb) > WHITE_LEVEL).cast("double")).alias("white_fraction"),
        F.avg((gray < DARK_LEVEL).cast("double")).alias("dark_fraction"),
        F.avg(sat.cast("double")).alias("mean_saturation"),
        F.avg(foreground(rr, gg, bb).cast("double")).alias("foreground_fraction"))


def quality_rollup(items: DataFrame, group: Sequence[str], status: str, metrics: Sequence[str]) -> DataFrame:
    """Status counts and means over usable items per group, flagged when none passes."""
    usable = F.col(status) != "FAILED"
    g = items.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.count_if(F.col(status) == s).alias(f"{s.lower()}_items") for s in ("PASS", "WARN", "FAILED")],
        *[F.avg(F.when(usable, F.col(m))).alias(f"mean_{m}") for m in metrics])
    return g.withColumn("artifact_like", F.col("pass_items") == 0)
