"""The five daily views and the whole dashboard.

Each view is one lazy plan that reads the served rows once: daily sums, filled
with zero rows where the view wants them, and columns of these. The dashboard as
one table unfolds the rows of all five from the same filled frame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions.scalars import date_pair
from ebbledger.operators import calendar
from ebbledger.operators.filters import between_dates, in_segments
from ebbledger.operators.metrics import (
    DAILY_COLUMNS,
    daily_sums,
    free_and_paid,
    free_and_paid_columns,
    free_share_by_source,
    free_sources_shown,
    kpi_columns,
    kpis,
    rtp_by_source,
    rtp_sources_shown,
    source_marks,
    view_keys,
)

WHOLE_DATA = "data"


def _fills(date_range) -> bool:
    return date_range == WHOLE_DATA or date_pair(date_range) is not None


# -- from daily sums, filled or not -------------------------------------------


def _trend(daily: DataFrame, dimension) -> DataFrame:
    return kpis(calendar.on_missing_days(daily, dimension), dimension)


def _components(daily: DataFrame, dimension) -> DataFrame:
    return _trend(daily, dimension).withColumn("total_inflow", F.col("total_free_inflow") + F.col("total_paid_inflow"))


def _by_date(rows: DataFrame, dimension, *ties: str) -> DataFrame:
    return rows.orderBy(*view_keys(dimension), *ties)


def _by_source(serving: DataFrame, dimension, date_range) -> DataFrame:
    daily = daily_sums(serving, dimension)
    return calendar.filled(daily, dimension, date_range, source_marks()) if _fills(date_range) else daily


# -- views ------------------------------------------------------------------


def view_consumption_trend(serving: DataFrame, dimension: str | None = None, date_range=None) -> DataFrame:
    """Outflow, free and paid inflow and consumption per day, every day of the range present."""
    daily = calendar.filled(daily_sums(serving, dimension, C.TOTALS), dimension, date_range)
    return _by_date(_trend(daily, dimension), dimension)


def view_credit_components(serving: DataFrame, dimension: str | None = None, date_range=None) -> DataFrame:
    """The consumption trend with total inflow, the sum of free and paid."""
    daily = calendar.filled(daily_sums(serving, dimension, C.TOTALS), dimension, date_range)
    return _by_date(_components(daily, dimension), dimension)


def view_free_vs_paid(serving: DataFrame, dimension: str | None = None, date_range=None) -> DataFrame:
    """Free and paid inflow and their shares per day; gaps are filled only with a range."""
    daily = daily_sums(serving, dimension, C.TOTALS)
    if _fills(date_range):
        daily = calendar.filled(daily, dimension, date_range)
    return _by_date(free_and_paid(daily, dimension), dimension)


def view_free_share_by_source(serving: DataFrame, dimension: str | None = None, date_range=None) -> DataFrame:
    """Free inflow per source and its share of the day; gaps are filled only with a range."""
    return _by_date(free_share_by_source(_by_source(serving, dimension, date_range), dimension), dimension, "source")


def view_rtp_by_source(serving: DataFrame, dimension: str | None = None, date_range=None) -> DataFrame:
    """Free inflow per source as a percentage of outflow; gaps are filled only with a range."""
    return _by_date(rtp_by_source(_by_source(serving, dimension, date_range), dimension), dimension, "source")


# -- dashboard ----------------------------------------------------------------


def _dashboard_days(serving: DataFrame, segments, dimension, date_range) -> DataFrame:
    """The filled daily sums of the filtered rows; without a usable range, over the days of these."""
    kept = in_segments(between_dates(serving, date_pair(date_range)), segments)
    over = date_range if date_pair(date_range) is not None else WHOLE_DATA
    return _by_source(kept, dimension, over)


def dashboard(
    serving: DataFrame,
    segments: Mapping[str, list] | None = None,
    dimension: str | None = None,
    date_range=None,
) -> dict[str, DataFrame]:
    """The five views of the filtered rows, one frame for each panel."""
    days = _dashboard_days(serving, segments, dimension, date_range)
    return {
        "consumption_trend": _by_date(_trend(days, dimension), dimension),
        "credit_components": _by_date(_components(days, dimension), dimension),
        "free_vs_paid": _by_date(free_and_paid(days, dimension), dimension),
        "free_share_by_source": _by_date(free_share_by_source(days, dimension), dimension, "source"),
        "rtp_by_source": _by_date(rtp_by_source(days, dimension), dimension, "source"),
    }


def _cells(view: str, metrics: Mapping[str, Column], source: Column | None = None) -> Column:
    source = F.lit(None).cast("string") if source is None else source
    cell = lambda name, value: F.struct(F.lit(view).alias("view"), source.alias("source"), F.lit(name).alias("metric"), value.cast("double").alias("value"))
    return F.array(*[cell(name, value) for name, value in metrics.items()])


def _cells_by_source(view: str, sources: Column, *metrics: str) -> Column:
    return F.flatten(F.transform(sources, lambda s: _cells(view, {m: s[m] for m in metrics}, s["source"])))


def dashboard_table(
    serving: DataFrame,
    segments: Mapping[str, list] | None = None,
    dimension: str | None = None,
    date_range=None,
) -> DataFrame:
    """All five views as one table - view, date, source, segment, metric, value - from one pass over the rows.

    The rows of `stacked(dashboard(..))`: a filled day is unfolded into its cells of every view.
    """
    days = _dashboard_days(serving, segments, dimension, date_range)
    days = days.withColumn("_trend", calendar.real_or_missing_day(dimension))
    trend = kpi_columns()
    components = {**trend, "total_inflow": F.col("total_free_inflow") + F.col("total_paid_inflow")}
    in_trend = F.concat(_cells("consumption_trend", trend), _cells("credit_components", components))
    cells = F.concat(
        F.filter(in_trend, lambda _: F.col("_trend")),
        _cells("free_vs_paid", free_and_paid_columns()),
        _cells_by_source("free_share_by_source", free_sources_shown(days, dimension), "Free Inflow", "Share"),
        _cells_by_source("rtp_by_source", rtp_sources_shown(days, dimension), "RTP"),
    )
    segment = F.col(dimension) if dimension else F.lit(None)
    rows = days.select("date", segment.cast("string").alias("segment"), F.inline(cells))
    return rows.select("view", "date", "source", "segment", "metric", "value")


def stacked(views: Mapping[str, DataFrame], dimension: str | None = None) -> DataFrame:
    """Several views as one table: view, date, source, dimension value, metric, value."""
    out = None
    for name, view in views.items():
        keys = [k for k in ("date", "source", dimension) if k in view.columns]
        metrics = [c for c in view.columns if c not in keys]
        rows = view.select(*keys, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics]).unpivot(
            keys, metrics, "metric", "value"
        )
        source = F.col("source") if "source" in keys else F.lit(None).cast("string")
        split = F.col(dimension).cast("string") if dimension else F.lit(None).cast("string")
        rows = rows.select(
            F.lit(name).alias("view"), "date", source.alias("source"), split.alias("segment"), "metric", "value"
        )
        out = rows if out is None else out.unionByName(rows)
    return out
