"""The comprehensive report over one pass of the tickets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as A
from ..operators import rankings as R
from ..operators.epics import epic_rollup_of
from ..staging import stage

NO_DATA = "No data available"

# What the sections group by. Every section is a further sum over one of these sets.
_SETS = {
    "cube": ["project", "assignee", "status", "status_category", "priority"],
    "created": ["created_date"],
    "resolved": ["resolved_at"],
    "durations": ["priority", "resolution_time_days"],
    "epics": ["epic_link"],
}
_DIMS = ["project", "assignee", "status", "status_category", "priority", "created_date", "resolved_at",
         "resolution_time_days", "epic_link"]


def report_rows(enriched: DataFrame, *keep: str) -> DataFrame:
    """What the report needs of each ticket: its dimensions and measures, after the columns in ``keep``."""
    if "epic_link" not in enriched.columns:
        enriched = enriched.withColumn("epic_link", F.lit(None).cast("string"))
    return enriched.withColumn("resolved_at", F.when(F.col("is_resolved"), F.col("updated"))).select(*keep, *_DIMS, *A.measure_columns())


def summarize_rows(base: DataFrame) -> DataFrame:
    """All measures by all grouping sets. Rows with negative measures take back what they once added."""
    grouped = base.groupingSets(list(_SETS.values()), *_DIMS).agg(
        F.grouping_id().alias("_g"), *[F.sum(m).alias(m) for m in A.MEASURES])
    bit = {d: 1 << (len(_DIMS) - 1 - i) for i, d in enumerate(_DIMS)}
    name = reduce(lambda acc, s: acc.when(
        F.col("_g") == sum(bit[d] for d in _DIMS if d not in _SETS[s]), s), _SETS, F.when(F.lit(False), ""))
    return grouped.withColumn("part", name).drop("_g")


def summarize(enriched: DataFrame) -> DataFrame:
    """All measures by all grouping sets: one scan, one shuffle of partial sums.

    Additive, so it is also the thing to keep when the tickets themselves are too large to hold.
    """
    return summarize_rows(report_rows(enriched))


def merged(summaries: DataFrame) -> DataFrame:
    """One summary from the rows of several; groups that no ticket is left in vanish."""
    return summaries.groupBy("part", *_DIMS).agg(*[F.sum(m).alias(m) for m in A.MEASURES]).where("n <> 0")


def _sections(s: DataFrame, epics: DataFrame | None, loaded_at) -> dict[str, DataFrame]:
    def part(name: str) -> DataFrame:
        return s.where(F.col("part") == name).select(*_SETS[name], *A.MEASURES)

    cube = part("cube")
    assignees = A.group_stats_of(cube, "assignee", "resolution_rate")
    projects = A.group_stats_of(cube, "project", "completion_rate")
    created = part("created")
    daily = A.series_of(created, "created_date", "tickets_created")
    resolved = A.series_of(part("resolved").withColumnRenamed("resolved_at", "updated"), "updated", "tickets_resolved")
    sizes = A.cardinalities_of(cube).where("total_records > 0")
    some = F.coalesce(A.cardinalities_of(cube).select("total_records").scalar(), F.lit(0)) > 0
    sections = {
        "overview": A.overview_of(cube),
        "assignees.assignee_stats": assignees,
        "assignees.top_assignees": R.top_assignees(assignees),
        "assignees.most_efficient": R.most_efficient(assignees),
        "assignees.slowest_resolvers": R.slowest_resolvers(assignees),
        "projects.project_stats": projects,
        "projects.most_active_projects": R.most_active_projects(projects),
        "projects.most_completed_projects": R.most_completed_projects(projects),
        "projects.project_count": sizes.select("project_count"),
        "trends.daily_creation": daily,
        "trends.weekly_creation": A.weekly_of(created),
        "trends.monthly_creation": A.monthly_of(created),
        "trends.daily_resolution": resolved,
        "trends.creation_trend": A.creation_trend_of(daily).where(some),
        "trends.resolution_trend": A.resolution_trend_of(resolved).where(some),
        "status.status_distribution": A.distribution_of(cube, "status"),
        "status.status_category_distribution": A.distribution_of(cube, "status_category"),
        "status.status_flow": A.crosstab_of(cube, "project", "status_category"),
        "status.status_count": sizes.select("status_count"),
        "priority.priority_distribution": A.distribution_of(cube, "priority"),
        "priority.priority_by_project": A.crosstab_of(cube, "project", "priority"),
        "priority.priority_resolution_times": A.resolution_times_of(part("durations")),
        "total_records": sizes.select("total_records"),
        "error": A.cardinalities_of(cube).where("total_records = 0").select(F.lit(NO_DATA).alias("error")),
    }
    if epics is not None:
        rollup = epic_rollup_of(epics, part("epics"))
        sections["epics.epic_progress"] = rollup
        sections["epics.epic_count"] = rollup.agg(F.count(F.lit(1)).alias("epic_count")).where(some)
    if loaded_at is not None:
        sections["data_freshness"] = A.data_freshness(s.sparkSession, loaded_at).where(some)
    return sections


def comprehensive_report(enriched: DataFrame, epics: DataFrame | None = None, loaded_at=None) -> dict[str, DataFrame]:
    """Section name to DataFrame. The tickets are read once, by the first section that runs."""
    return _sections(stage(summarize(enriched), "summary"), epics, loaded_at)


_KEYS = {
    "assignees": ["assignee"], "projects": ["project"],
    "trends.daily_creation": ["created_date"], "trends.weekly_creation": ["week_start"],
    "trends.monthly_creation": ["created_month"], "trends.daily_resolution": ["updated"],
    "status.status_distribution": ["status"], "status.status_category_distribution": ["status_category"],
    "status.status_flow": ["project", "status_category"],
    "priority.priority_distribution": ["priority"], "priority.priority_by_project": ["project", "priority"],
    "priority.priority_resolution_times": ["priority"],
    "epics.epic_progress": ["epic_key", "project"],
}


def tall(report: dict[str, DataFrame]) -> DataFrame:
    """All sections as (section, metric, dim1, dim2, value); times count as seconds, an error as its text."""
    rows = []
    for section, df in report.items():
        wanted = _KEYS.get(section) or _KEYS.get(section.split(".")[0], [])
        keys = [k for k in wanted if k in df.columns]
        dims = [F.col(k).cast("string").alias(f"dim{i + 1}") for i, k in enumerate(keys)]
        dims += [F.lit(None).cast("string").alias(f"dim{i + 1}") for i in range(len(keys), 2)]
        if section == "error":
            rows.append(df.select(F.lit(section).alias("section"), F.col("error").alias("metric"), *dims,
                                  F.lit(None).cast("double").alias("value")))
            continue
        metrics = [c for c in df.columns if c not in keys]
        flat = df.select(*dims, *[F.col(c).cast("double").alias(c) for c in metrics])
        rows.append(flat.unpivot(["dim1", "dim2"], metrics, "metric", "value").select(
            F.lit(section).alias("section"), "metric", "dim1", "dim2", "value"))
    return reduce(DataFrame.unionByName, rows)


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """The tall form as Parquet, one folder per section."""
    tall(report).write.mode("overwrite").partitionBy("section").parquet(path)
