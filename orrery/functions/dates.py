"""Date and time functions: parts, period starts and ends, boundary counts, business time.

Weeks start on Monday. A `fiscal_start` month other than 1 shifts the calendar so
that the fiscal year is named by the calendar year in which it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.search import blocks, place

today = F.current_date
now = F.current_timestamp
date = F.to_date
minute = F.minute
second = F.second
hour_of_day = F.hour
make_date = F.make_date
last_day = F.last_day

BUCKETS = ("HOURLY", "DAILY", "WEEKLY", "MONTHLY", "QUARTERLY", "YEARLY")
_UNIT = {
    "HOURLY": "hour", "DAILY": "day", "WEEKLY": "week",
    "MONTHLY": "month", "QUARTERLY": "quarter", "YEARLY": "year",
}


def bucket_unit(bucket: str) -> str:
    """The truncation unit of a bucket name: MONTHLY -> month."""
    if bucket not in _UNIT:
        raise ValueError(f"unknown bucket {bucket}; one of {BUCKETS}")
    return _UNIT[bucket]


def date_bucket(d: Column, bucket: str) -> Column:
    """Start of the bucket: a date, or a timestamp for HOURLY."""
    unit = bucket_unit(bucket)
    cut = F.date_trunc(unit, d)
    return cut if unit == "hour" else F.to_date(cut)


def _fiscal(d: Column, fiscal_start: int) -> Column:
    """Shift so that the fiscal start month becomes January; day of month is kept by the caller."""
    return d if fiscal_start == 1 else F.add_months(F.trunc(d, "month"), 13 - fiscal_start)


def time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def year(d: Column, fiscal_start: int = 1) -> Column:
    return F.year(_fiscal(d, fiscal_start))


def year_name(d: Column, fiscal_start: int = 1) -> Column:
    """`2014`, or `FY_2014` for a fiscal calendar."""
    text = year(d, fiscal_start).cast("string")
    return text if fiscal_start == 1 else F.concat(F.lit("FY_"), text)


def quarter_number(d: Column, fiscal_start: int = 1) -> Column:
    return F.quarter(_fiscal(d, fiscal_start))


def month_number(d: Column, fiscal_start: int = 1) -> Column:
    return F.month(_fiscal(d, fiscal_start))


def day(d: Column) -> Column:
    return F.dayofmonth(d)


def month(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def day_of_week(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def month_number_of_quarter(d: Column, fiscal_start: int = 1) -> Column:
    return (month_number(d, fiscal_start) - 1) % 3 + 1


def day_number_of_week(d: Column) -> Column:
    """1 is Monday, 7 is Sunday."""
    return F.weekday(d) + 1


def day_number_of_quarter(d: Column) -> Column:
    return F.date_diff(d, F.trunc(d, "quarter")) + 1


def day_number_of_year(d: Column) -> Column:
    return F.dayofyear(d)


def week_number_of_year(d: Column) -> Column:
    """ISO week."""
    return F.weekofyear(d)


def week_number_of_quarter(d: Column) -> Column:
    return period_index(d, "week") - period_index(F.trunc(d, "quarter"), "week") + 1


def week_number_of_month(d: Column) -> Column:
    return period_index(d, "week") - period_index(F.trunc(d, "month"), "week") + 1


def week_year(d: Column) -> Column:
    """The year that the ISO week belongs to."""
    return F.extract(F.lit("YEAROFWEEK"), d)


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def _seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of an instant or a zoneless timestamp, in UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def period_index(d: Column, unit: str) -> Column:
    """A whole number that grows by one at every boundary of the unit."""
    if unit == "second":
        return _seconds(d)
    if unit == "minute":
        return F.floor(_seconds(d) / 60)
    if unit == "hour":
        return F.floor(_seconds(d) / 3600)
    day_no = F.unix_date(F.to_date(d))
    if unit == "day":
        return day_no
    if unit == "week":
        return F.floor((day_no + 3) / 7).cast("int")  # 1970-01-01 was a Thursday
    if unit == "month":
        return F.year(d) * 12 + F.month(d) - 1
    if unit == "quarter":
        return F.year(d) * 4 + F.quarter(d) - 1
    if unit == "year":
        return F.year(d)
    raise ValueError(f"unknown unit {unit}")


def diff(unit: str, end: Column, start: Column) -> Column:
    """Boundaries of the unit crossed from start to end."""
    return period_index(end, unit) - period_index(start, unit)


def diff_days(end: Column, start: Column) -> Column:
    return diff("day", end, start)


def diff_weeks(end: Column, start: Column) -> Column:
    return diff("week", end, start)


def diff_months(end: Column, start: Column) -> Column:
    return diff("month", end, start)


def diff_quarters(end: Column, start: Column) -> Column:
    return diff("quarter", end, start)


def diff_years(end: Column, start: Column) -> Column:
    return diff("year", end, start)


def diff_time(end: Column, start: Column) -> Column:
    """Seconds from start to end."""
    return diff("second", end, start)


def diff_hours(end: Column, start: Column) -> Column:
    return diff("hour", end, start)


def diff_minutes(end: Column, start: Column) -> Column:
    return diff("minute", end, start)


def start_of(unit: str, d: Column, offset: int = 0) -> Column:
    """First day (or instant, for hour and minute) of the period `offset` periods away."""
    if unit in ("hour", "minute"):
        cut = F.date_trunc(unit, d)
        return cut if offset == 0 else cut + F.expr(f"INTERVAL '{offset}' {unit.upper()}")
    cut = F.to_date(d) if unit == "day" else F.trunc(d, unit)
    if offset == 0:
        return cut
    if unit == "day":
        return F.date_add(cut, offset)
    if unit == "week":
        return F.date_add(cut, 7 * offset)
    return F.add_months(cut, {"month": 1, "quarter": 3, "year": 12}[unit] * offset)


def end_of(unit: str, d: Column, offset: int = 0) -> Column:
    """Last day of the period."""
    return F.date_sub(start_of(unit, d, offset + 1), 1)


def start_of_year(d: Column, fiscal_start: int = 1) -> Column:
    if fiscal_start == 1:
        return start_of("year", d)
    return F.add_months(F.trunc(_fiscal(d, fiscal_start), "year"), fiscal_start - 13)


def start_of_quarter(d: Column) -> Column:
    return start_of("quarter", d)


def start_of_month(d: Column) -> Column:
    return start_of("month", d)


def start_of_week(d: Column) -> Column:
    return start_of("week", d)


def start_of_hour(ts: Column) -> Column:
    return start_of("hour", ts)


def start_of_min(ts: Column) -> Column:
    return start_of("minute", ts)


def month_end(d: Column) -> Column:
    return end_of("month", d)


def quarter_end(d: Column) -> Column:
    return end_of("quarter", d)


def year_end(d: Column) -> Column:
    return end_of("year", d)


def week_end(d: Column) -> Column:
    return end_of("week", d)


def add_days(d: Column, n: int) -> Column:
    return F.date_add(F.to_date(d), n)


def add_weeks(d: Column, n: int) -> Column:
    return F.date_add(F.to_date(d), 7 * n)


def add_months(d: Column, n: int) -> Column:
    return F.add_months(d, n)


def add_quarters(d: Column, n: int) -> Column:
    return F.add_months(d, 3 * n)


def add_years(d: Column, n: int) -> Column:
    return F.add_months(d, 12 * n)


def add_hours(ts: Column, n: int) -> Column:
    return ts + F.make_interval(hours=F.lit(n))


def add_minutes(ts: Column, n: int) -> Column:
    return ts + F.make_interval(mins=F.lit(n))


def add_seconds(ts: Column, n: int) -> Column:
    return ts + F.make_interval(secs=F.lit(n))


def to_date(s: Column, pattern: str) -> Column:
    """Text to date by pattern; NULL if the text does not fit."""
    return F.try_to_timestamp(s, F.lit(pattern)).cast("date")


def to_timestamp(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern))


def to_char_date(d: Column, pattern: str) -> Column:
    return F.date_format(d, pattern)


def is_date(s: Column, pattern: str) -> Column:
    """Does the text parse as a date by this pattern?"""
    return F.try_to_timestamp(s, F.lit(pattern)).isNotNull()


def make_time(h: Column, m: Column, s: Column) -> Column:
    """Time of day as `HH:mm:ss` text."""
    return F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in (h, m, s)])


def make_datetime(d: Column, time_text: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), time_text), F.lit("yyyy-MM-dd HH:mm:ss"))


def age_years(birth: Column, ref: Column) -> Column:
    """Completed years from birth to the reference date."""
    had = F.month(ref) * 100 + F.dayofmonth(ref) >= F.month(birth) * 100 + F.dayofmonth(birth)
    return F.year(ref) - F.year(birth) - F.when(had, 0).otherwise(1)


def parse_fiscal_label(label: Column) -> Column:
    """`FY2016`, `_2016_17`, `2016` -> 2016-01-01; `2016-03` -> 2016-03-01; else NULL."""
    y = F.regexp_extract(label, r"^(?:FY|_)?(\d{4})(?:_\d{2}|-\d{2})?$", 1)
    m = F.regexp_extract(label, r"^\d{4}-(0[1-9]|1[0-2])$", 1)
    bad_month = label.rlike(r"^\d{4}-\d{2}$") & (m == "")
    return F.when(
        (y != "") & ~bad_month,
        F.make_date(y.try_cast("int"), F.when(m != "", m.try_cast("int")).otherwise(F.lit(1)), F.lit(1)),
    )


def convert_user_timezone(ts: Column, zone: str | Column) -> Column:
    """UTC wall time to the wall time of a zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


# --- business time: weekdays only, weekend ends moved to the nearest weekday ---------------


def _from_monday(start: Column) -> Column:
    """A start on Saturday or Sunday moves to Monday midnight."""
    ahead = 7 - F.weekday(start)
    monday = F.date_add(F.to_date(start), ahead).cast("timestamp_ntz")
    return F.when(is_weekend(start), monday).otherwise(start.cast("timestamp_ntz"))


def _to_friday(end: Column, last_instant: bool) -> Column:
    """An end on Saturday or Sunday moves back to Friday: its last second, or its date."""
    back = F.weekday(end) - 4
    friday = F.date_sub(F.to_date(end), back).cast("timestamp_ntz")
    if last_instant:
        friday = friday + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return F.when(is_weekend(end), friday).otherwise(end.cast("timestamp_ntz"))


def business_minutes(start: Column, end: Column) -> Column:
    """Minutes on weekdays between two instants, counted in minute boundaries."""
    a, b = _from_monday(start), _to_friday(end, last_instant=True)
    return diff("minute", b, a) - diff("week", b, a) * 2 * 1440


def business_days(start: Column, end: Column, inclusive: bool = False) -> Column:
    """Weekdays from start to end; `inclusive` counts both ends."""
    a, b = _from_monday(start), _to_friday(end, last_instant=False)
    return diff("day", b, a) + int(inclusive) - diff("week", b, a) * 2


def business_duration_str(start: Column, end: Column) -> Column:
    """Business minutes as `H:MM`."""
    m = business_minutes(start, end)
    return F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def network_days(df: DataFrame, start: str, end: str, holidays: DataFrame, holiday: str) -> DataFrame:
    """`df` with its weekdays from start to end, both counted, less the holidays that fall on them.

    The distinct holidays on weekdays, at most as many as there are days, travel to the rows as one sorted list;
    each row finds how many lie up to its end and before its start, so that `df` is neither joined nor shuffled.
    """
    days = holidays.select(F.to_date(holiday).alias("_h")).where(F.col("_h").isNotNull() & ~is_weekend(F.col("_h")))
    listed = days.agg(blocks(F.array_sort(F.collect_set("_h"))).alias("_b")).scalar()
    found = df.withColumn("_holidays", listed)
    a, b = F.to_date(start), F.to_date(end)
    lost = F.when(a <= b, place(b, F.col("_holidays"), upto=True) - place(a, F.col("_holidays"))).otherwise(0)
    return found.withColumn("network_days", business_days(F.col(start), F.col(end), inclusive=True) - lost).drop("_holidays")


# --- durations -----------------------------------------------------------------------------


def _two(x: Column) -> Column:
    """At least two digits; longer numbers keep all of theirs."""
    text = x.cast("string")
    return F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0"))


def _whole(x: Column, n: int) -> Column:
    return F.floor(x / n)


def seconds_to_hms(s: Column) -> Column:
    return F.concat_ws(":", _two(_whole(s, 3600)), _two(_whole(s % 3600, 60)), _two(s % 60))


def seconds_to_dhms(s: Column) -> Column:
    return F.concat_ws(
        ":", _two(_whole(s, 86400)), _two(_whole(s % 86400, 3600)), _two(_whole(s % 3600, 60)), _two(s % 60)
    )


def minutes_to_hm(m: Column) -> Column:
    return F.concat_ws(":", _two(_whole(m, 60)), _two(m % 60))


def minutes_to_dhm(m: Column) -> Column:
    return F.concat_ws(":", _two(_whole(m, 1440)), _two(_whole(m % 1440, 60)), _two(m % 60))


# --- calendars -----------------------------------------------------------------------------


def retail_calendar(spark, start: str, end: str, pattern: tuple[int, int, int] = (4, 4, 5)) -> DataFrame:
    """One row per date with 52-week retail periods: quarters of 4, 4 and 5 weeks.

    `start` is the Monday on which retail year 1 begins; each year has 364 days.
    """
    first, second, _ = pattern
    d = F.col("date_value")
    n = F.date_diff(d, F.lit(start).cast("date"))
    of_year = n % 364
    week_of_quarter = F.floor((of_year % 91) / 7)
    month_of_quarter = (
        F.when(week_of_quarter < first, 1).when(week_of_quarter < first + second, 2).otherwise(3)
    )
    quarter = F.floor(of_year / 91) + 1
    return spark.sql(
        "SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE))) AS date_value",
        args={"a": start, "b": end},
    ).select(
        d,
        (F.floor(n / 364) + 1).cast("int").alias("retail_year"),
        quarter.cast("int").alias("retail_quarter"),
        ((quarter - 1) * 3 + month_of_quarter).cast("int").alias("retail_month"),
        (F.floor(of_year / 7) + 1).cast("int").alias("retail_week"),
    )


def custom_calendar(df: DataFrame, d: str, calendar: DataFrame, calendar_date: str = "date_value") -> DataFrame:
    """Attach the periods of a calendar table to each row by its date."""
    cal = calendar.withColumnRenamed(calendar_date, "_cal_date")
    return df.join(cal, F.to_date(df[d]) == cal["_cal_date"], "left").drop("_cal_date")
