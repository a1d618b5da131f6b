"""Ticket metrics: status groups, scores, durations, calendar columns, rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import values as V

MICROS_PER_DAY = 86_400_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_category(c) -> Column:
    c = _col(c)
    return (F.when(c.isin(*V.RESOLVED_STATUSES), "Resolved")
            .when(c.isin(*V.ACTIVE_STATUSES), "Active")
            .when(c.isin(*V.PENDING_STATUSES), "Pending")
            .otherwise("Other"))


def priority_score(c, scores: dict[str, int] | None = None) -> Column:
    c, out = _col(c), None
    for name, score in (scores or V.PRIORITY_SCORES).items():
        out = F.when(c == name, score) if out is None else out.when(c == name, score)
    return out.otherwise(0)


def is_resolved(c) -> Column:
    return F.coalesce(_col(c).isin(*V.RESOLVED_STATUSES), F.lit(False))


def parse_ts(c) -> Column:
    """Instant of an ISO text, with or without an offset; null when it is not one."""
    return _col(c).try_cast("timestamp")


def local_ts(c) -> Column:
    """Wall clock of an ISO text: the same text without its offset."""
    return F.regexp_replace(_col(c), r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def resolution_days(status, created, updated) -> Column:
    """Whole days elapsed, floored (also below zero), for resolved tickets only."""
    micros = F.timestamp_diff("MICROSECOND", _col(created), _col(updated))
    return F.when(is_resolved(status), F.floor(micros / F.lit(float(MICROS_PER_DAY))))


def calendar_month(c) -> Column:
    return F.trunc(F.to_date(_col(c)), "month")


def week_start(c) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(F.to_date(_col(c)), "week")


def round1(c) -> Column:
    """One decimal, ties to even."""
    return F.bround(_col(c), 1)


def safe_pct(part, whole) -> Column:
    """part / whole × 100, zero when the whole is zero."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole)), F.lit(0.0)) * 100


def clamp_trend(slope) -> Column:
    """slope / max(|slope|, 1), which is the slope held within [-1, 1]; zero when there is none."""
    slope = _col(slope)
    return F.when(slope.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope)))


def newest_first(c) -> Column:
    """A number that is smaller for later times, so that ``min`` picks the newest; null times come last."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", _col(c), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")),
                      F.lit(2 ** 63 - 1))
