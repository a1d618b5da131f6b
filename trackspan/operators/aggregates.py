"""Ticket statistics.

Every count, mean and rate is a sum over additive measures, so the same functions run over ticket rows
(``measures``) and over the pre-aggregated summary of ``plans.report``. Sums combine on the map side;
a key that holds a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metrics as M
from ..functions import text as X

MEASURES = ("n", "sum_days", "n_days", "sum_score", "n_resolved")


def measure_columns() -> list[Column]:
    """The measures of one ticket row."""
    return [
        F.lit(1).cast("long").alias("n"),
        F.col("resolution_time_days").alias("sum_days"),
        F.col("resolution_time_days").isNotNull().cast("long").alias("n_days"),
        F.col("priority_score").cast("long").alias("sum_score"),
        (F.col("status_category") == "Resolved").cast("long").alias("n_resolved"),
    ]


def measures(enriched: DataFrame, *keys: str) -> DataFrame:
    return enriched.select(*keys, *measure_columns())


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _mean(part: str, n: str) -> Column:
    return F.try_divide(F.sum(part).cast("double"), F.sum(n))


# -- overview and group statistics ---------------------------------------------


def overview_of(m: DataFrame) -> DataFrame:
    """From measures keyed by ``status_category``. No row when there are no tickets."""
    def n_in(category: str) -> Column:
        return _total(F.when(F.col("status_category") == category, F.col("n")))

    totals = m.agg(
        _total("n").alias("total_tickets"),
        n_in("Active").alias("active_tickets"),
        n_in("Resolved").alias("resolved_tickets"),
        n_in("Pending").alias("pending_tickets"),
        F.coalesce(_mean("sum_days", "n_days"), F.lit(0.0)).alias("avg_resolution_time"))
    return totals.withColumn("resolution_rate", M.safe_pct("resolved_tickets", "total_tickets")).where("total_tickets > 0")


def overview_metrics(enriched: DataFrame) -> DataFrame:
    return overview_of(measures(enriched, "status_category"))


def group_stats_of(m: DataFrame, key: str, rate: str) -> DataFrame:
    stats = m.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("n").alias("total_tickets"),
        _mean("sum_days", "n_days").alias("avg_resolution_time"),
        _mean("sum_score", "n").alias("avg_priority"),
        F.sum("n_resolved").alias("resolved_tickets"))
    return stats.withColumn(rate, M.round1(M.safe_pct("resolved_tickets", "total_tickets")))


def assignee_stats(enriched: DataFrame) -> DataFrame:
    return group_stats_of(measures(enriched, "assignee"), "assignee", "resolution_rate")


def project_stats(enriched: DataFrame) -> DataFrame:
    return group_stats_of(measures(enriched, "project"), "project", "completion_rate")


# -- distributions ---------------------------------------------------------------


def distribution_of(m: DataFrame, key: str) -> DataFrame:
    return m.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n"))


def distribution(enriched: DataFrame, key: str) -> DataFrame:
    """Tickets per value, missing values left out."""
    return distribution_of(measures(enriched, key), key)


def status_distribution(enriched: DataFrame) -> DataFrame:
    return distribution(enriched, "status")


def status_category_distribution(enriched: DataFrame) -> DataFrame:
    return distribution(enriched, "status_category")


def priority_distribution(enriched: DataFrame) -> DataFrame:
    return distribution(enriched, "priority")


def crosstab_of(m: DataFrame, row: str, col: str) -> DataFrame:
    """Counts for every (row value, column value), zero where there is no ticket.

    The counts of one row value are gathered in a map with an entry per column value; the column values
    are the header of the table and must be few.
    """
    counts = (m.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.sum("n").alias("n")))
    header = counts.agg(F.sort_array(F.collect_set(col))).scalar()
    return (counts.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, "n"))).alias("_cells"))
            .withColumn("_header", header)
            .select(row, "_cells", F.explode("_header").alias(col))
            .select(row, col, F.coalesce(F.try_element_at("_cells", F.col(col)), F.lit(0)).alias("n")))


def crosstab(enriched: DataFrame, row: str, col: str) -> DataFrame:
    return crosstab_of(measures(enriched, row, col), row, col)


def crosstab_wide(long: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """One column per listed value."""
    return long.groupBy(row).pivot(col, values).agg(F.sum("n")).na.fill(0)


def status_flow(enriched: DataFrame) -> DataFrame:
    return crosstab(enriched, "project", "status_category")


def priority_by_project(enriched: DataFrame) -> DataFrame:
    return crosstab(enriched, "project", "priority")


def resolution_times_of(m: DataFrame) -> DataFrame:
    """Mean, exact median and count of days per priority, from counts per (priority, days)."""
    counts = m.where("priority IS NOT NULL").groupBy("priority", "resolution_time_days").agg(F.sum("n").alias("n"))
    days, known = F.col("resolution_time_days"), F.col("resolution_time_days").isNotNull()
    n = F.when(known, F.col("n")).otherwise(0)
    return counts.groupBy("priority").agg(
        F.try_divide(F.sum(days * n).cast("double"), F.sum(n)).alias("mean_days"),
        F.percentile(days, 0.5, n).alias("median_days"),
        F.sum(n).alias("n_days"))


def priority_resolution_times(enriched: DataFrame) -> DataFrame:
    return resolution_times_of(measures(enriched, "priority", "resolution_time_days"))


def cardinalities_of(m: DataFrame) -> DataFrame:
    """From measures keyed by project and status."""
    return m.groupBy("project", "status").agg(F.sum("n").alias("n")).agg(
        F.countDistinct("project").alias("project_count"),
        F.countDistinct("status").alias("status_count"),
        _total("n").alias("total_records"))


def cardinalities(enriched: DataFrame) -> DataFrame:
    return cardinalities_of(measures(enriched, "project", "status"))


def drilldown_counts(matching: DataFrame) -> DataFrame:
    """Counts by status, project and status category and the number of rows, in one pass."""
    dims = ["status", "project", "status_category"]
    sets = matching.select(*dims).groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    # The bit of a dimension is 0 in the set that groups by it.
    return sets.select(
        F.when(F.col("_g") == 3, "status").when(F.col("_g") == 5, "project").when(F.col("_g") == 6, "status_category")
        .otherwise("rows").alias("dimension"), F.coalesce(*dims).alias("value"), "n",
    ).where("dimension = 'rows' OR value IS NOT NULL")


# -- time series -------------------------------------------------------------------


def series_of(m: DataFrame, period: str, out: str) -> DataFrame:
    return m.where(F.col(period).isNotNull()).groupBy(period).agg(F.sum("n").alias(out))


def daily_creation(enriched: DataFrame) -> DataFrame:
    return series_of(measures(enriched, "created_date"), "created_date", "tickets_created")


def _by_period(m: DataFrame, period: Column, name: str) -> DataFrame:
    return series_of(m.select(period.alias(name), "n"), name, "tickets_created")


def weekly_of(m: DataFrame) -> DataFrame:
    return _by_period(m, M.week_start("created_date"), "week_start")


def monthly_of(m: DataFrame) -> DataFrame:
    return _by_period(m, M.calendar_month("created_date"), "created_month")


def weekly_creation(enriched: DataFrame) -> DataFrame:
    return weekly_of(measures(enriched, "created_date"))


def monthly_creation(enriched: DataFrame) -> DataFrame:
    return monthly_of(measures(enriched, "created_date"))


def resolution_series(enriched: DataFrame, grain: str = "timestamp") -> DataFrame:
    """Resolved tickets per full ``updated`` time (``grain="timestamp"``) or per day."""
    if grain not in ("timestamp", "day"):
        raise ValueError("grain must be one of: day, timestamp")
    at = F.col("updated") if grain == "timestamp" else F.to_date("updated")
    return series_of(measures(enriched.where("is_resolved").withColumn("updated", at), "updated"), "updated", "tickets_resolved")


def date_index(series: DataFrame, period: str) -> DataFrame:
    """Position 0..n-1 of a series of dates. The rows are calendar days, so one window holds them."""
    return series.withColumn("idx", F.row_number().over(Window.orderBy(period)) - 1)


def time_index(series: DataFrame, period: str) -> DataFrame:
    """Position 0..n-1 of a series of distinct timestamps without sorting them all in one task.

    position = points on earlier days + points in earlier seconds of the day + points earlier in the
    second. Each window is bounded by the calendar: 10^6 microseconds, 86,400 seconds, the days.
    """
    keyed = series.withColumns({"_day": F.to_date(period), "_sec": F.date_trunc("second", period)})
    seconds = keyed.groupBy("_day", "_sec").agg(F.count(F.lit(1)).alias("_n"))
    days = seconds.groupBy("_day").agg(F.sum("_n").alias("_n"))

    def before(w) -> Column:
        return F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    days = days.select("_day", before(Window.orderBy("_day")).alias("_days_before"))
    seconds = seconds.select("_day", "_sec", before(Window.partitionBy("_day").orderBy("_sec")).alias("_secs_before"))
    starts = seconds.join(days, "_day").select("_day", "_sec", (F.col("_days_before") + F.col("_secs_before")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_day", "_sec").orderBy(period)) - 1
    return (keyed.withColumn("_within", within).join(starts, ["_day", "_sec"])
            .withColumn("idx", F.col("_start") + F.col("_within"))
            .drop("_day", "_sec", "_within", "_start"))


def trend(indexed: DataFrame, count: str, name: str) -> DataFrame:
    """Least-squares slope of the counts over their positions, held within [-1, 1]. One row."""
    slope = F.regr_slope(F.col(count).cast("double"), F.col("idx").cast("double"))
    return indexed.agg(M.clamp_trend(F.round(slope, 9)).alias(name))


def creation_trend_of(daily: DataFrame) -> DataFrame:
    return trend(date_index(daily, "created_date"), "tickets_created", "creation_trend")


def creation_trend(enriched: DataFrame) -> DataFrame:
    return creation_trend_of(daily_creation(enriched))


def resolution_trend_of(series: DataFrame) -> DataFrame:
    return trend(time_index(series, "updated"), "tickets_resolved", "resolution_trend")


def resolution_trend(enriched: DataFrame) -> DataFrame:
    return resolution_trend_of(resolution_series(enriched))


def data_freshness(spark, loaded_at) -> DataFrame:
    return spark.range(1).select(F.lit(loaded_at).cast("timestamp").alias("data_freshness"))


def performance_columns(stats: DataFrame) -> DataFrame:
    """The five report columns and their text line."""
    five = ["assignee", "total_tickets", "resolved_tickets", "avg_resolution_time", "resolution_rate"]
    return stats.select(*five, X.report_line(*five).alias("line"))
