"""Calendar expressions. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatrend.functions.numeric import text_number
from taxatrend.params import Window

LOCAL_ZONE = "Australia/Sydney"
#: Mean month length used for "months since the last record".
DAYS_PER_MONTH = 30.44


def local_day(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar day of an instant in the reporting zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def in_window(day: Column, w: Window) -> Column:
    return day.between(F.lit(w.start).cast("date"), F.lit(w.end).cast("date"))


def in_any_window(df: DataFrame, *windows: Window, day: str = "event_day", year: str = "event_year") -> DataFrame:
    """Rows whose day lies in one of the windows. Where the table is partitioned by the day's year, only those years are read."""
    c = in_window(F.col(day), windows[0])
    y = F.col(year).between(int(windows[0].start[:4]), int(windows[0].end[:4])) if year in df.columns else F.lit(True)
    for w in windows[1:]:
        c = c | in_window(F.col(day), w)
        y = y | F.col(year).between(int(w.start[:4]), int(w.end[:4])) if year in df.columns else y
    return df.filter(y & c)


def window_label(day: Column, baseline: Window, recent: Window) -> Column:
    """'baseline', 'recent' or null."""
    return F.when(in_window(day, baseline), "baseline").when(in_window(day, recent), "recent")


def text_instant(s: Column) -> Column:
    """Epoch milliseconds or an ISO date-time, as an instant; null when neither. A time without a date is none."""
    ms = text_number(s)
    return F.when(ms.isNotNull(), F.timestamp_millis(F.when(F.abs(ms) <= 8.64e15, ms).cast("bigint"))).otherwise(
        dated_instant(s)
    )


def dated_instant(s: Column) -> Column:
    """Text that begins with a year and holds a date, as an instant; otherwise null."""
    return F.when(F.trim(s).rlike(r"^[+-]?\d{4,}(-|$)"), F.try_to_timestamp(F.trim(s)))


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def months_since(last: Column, end: str) -> Column:
    """Whole mean months between a day and the end of the period."""
    return F.floor(F.datediff(F.lit(end).cast("date"), last) / F.lit(DAYS_PER_MONTH))


def month_series(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per calendar month from ``first`` to ``last`` (both ``YYYY-MM``)."""
    return (
        spark.range(1)
        .select(
            F.explode(
                F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))
            ).alias("period_start")
        )
        .select(
            F.date_format("period_start", "yyyy-MM").alias("month"),
            "period_start",
            F.last_day("period_start").alias("period_end"),
        )
    )
