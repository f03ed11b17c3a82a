"""All registered queries, one module per operator family."""

from cohortwise.plans.catalog import (  # noqa: F401
    a_sources,
    b_columns,
    c_joins,
    d_aggregates,
    e_windows,
    f_selection,
    g_sets_grid,
    h_scoring,
    i_stats,
    j_models,
    k_resample,
    l_checks,
)
from cohortwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
