"""ebbledger: daily inflow / outflow analytics of a game's credits economy on Spark.

Raw events, a player-day table, a player dimension and an exclusion list go
in; a long fact, a wide fact and five daily views come out.  Every function
takes and returns DataFrames and runs on the cluster; the reference date is
always an argument, so every result can be recomputed.
"""

from ebbledger.plans.facts import build_long, build_narrow, build_wide
from ebbledger.plans.views import (
    dashboard,
    view_consumption_trend,
    view_credit_components,
    view_free_share_by_source,
    view_free_vs_paid,
    view_rtp_by_source,
)
from ebbledger.sources.inputs import Inputs

__all__ = [
    "Inputs",
    "build_long",
    "build_narrow",
    "build_wide",
    "dashboard",
    "view_consumption_trend",
    "view_credit_components",
    "view_free_share_by_source",
    "view_free_vs_paid",
    "view_rtp_by_source",
]
