"""The next run of a schedule, as expressions: each row may have a schedule and a zone of its own.

A schedule has six fields: second, minute, hour, day of month, month, day of week, each with lists, ranges and steps,
names of months and days, `?`, and for days L, L-n, LW, nW (day of month), nL and n#k (day of week). A day must suit both its
fields. Fields become sorted sets of numbers; the next time is found by carrying from the second to the hour, and then to
the next day that suits. A run is an instant whose local time suits: what falls into the gap of a clock that
is put forward does not happen, and what lies in an hour that a clock goes through twice happens twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: macros, and the names of months and days
MACROS = {"@yearly": "0 0 0 1 1 *", "@annually": "0 0 0 1 1 *", "@monthly": "0 0 0 1 * *", "@weekly": "0 0 0 * * 0", "@daily": "0 0 0 * * *", "@midnight": "0 0 0 * * *", "@hourly": "0 0 * * * *"}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")

_FIELDS = {"second": (0, 59), "minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
#: Days that are looked through, first the next ones: 29 February on a given day of the week comes once in 40 years at most.
_REACH = (62, 3_000, 14_700)


def _numbers(parts: Column, low: int, high: int) -> Column:
    """The numbers that a field's plain parts name; null if a part is none."""
    def one(p: Column) -> Column:
        span, step = F.split_part(p, F.lit("/"), F.lit(1)), F.split_part(p, F.lit("/"), F.lit(2))
        every = span.isin("*", "?")
        first = F.when(every, low).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        last = F.when(every | (~span.contains("-") & p.contains("/")), high).when(span.contains("-"), F.split_part(span, F.lit("-"), F.lit(2)).try_cast("int")).otherwise(first)
        by = F.when(p.contains("/"), step.try_cast("int")).otherwise(1)
        fine = p.rlike(r"^(\*|\?|\d+(-\d+)?)(/\d+)?$") & (first >= low) & (last <= high) & (first <= last) & (by > 0)
        return F.when(fine, F.sequence(first, last, by))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def _parsed(df: DataFrame, cron: str) -> DataFrame:
    """_second, _minute, _hour, _day, _month, _weekday: sets; _days, _weekdays: special parts; _fine: whether the schedule is one."""
    text = F.upper(F.trim(F.regexp_replace(F.col(cron), r"\s+", " ")))
    for macro, meant in MACROS.items():
        text = F.when(text == macro.upper(), meant).otherwise(text)
    df = df.withColumn("_text", text).withColumn("_parts", F.split("_text", " "))
    special = {"day": r"^(L(-\d+)?|LW|\d+W)$", "weekday": r"^\d+(L|#\d)$"}
    for i, (name, (low, high)) in enumerate(_FIELDS.items()):
        field = F.get("_parts", F.lit(i))
        for names, base, of in ((MONTHS, 1, "month"), (DAYS, 0, "weekday")):
            if name == of:
                for k, word in enumerate(names):
                    field = F.replace(field, F.lit(word), F.lit(str(k + base)))
        parts = F.split(field, ",")
        if name in special:
            odd = special[name]
            df = df.withColumn(f"_{name}s", F.filter(parts, lambda p: p.rlike(odd)))  # noqa: B023
            parts = F.filter(parts, lambda p: ~p.rlike(odd))  # noqa: B023
        df = df.withColumn(f"_{name}", _numbers(parts, low, high))
    df = df.withColumn("_weekday", F.array_distinct(F.transform("_weekday", lambda x: x % 7)))
    whole = F.size("_parts") == 6
    for name in _FIELDS:
        whole &= F.col(f"_{name}").isNotNull() & ~F.exists(f"_{name}", lambda x: x.isNull())
    return df.withColumn("_fine", F.coalesce(whole, F.lit(False)))


def _suits(d: Column) -> Column:
    """Whether a day suits the fields of its row."""
    end, number = F.last_day(d), F.dayofmonth(d)
    weekday = F.dayofweek(d) - 1

    def working(day: Column) -> Column:
        """The working day next to a day of its month."""
        at = F.dayofweek(day)
        saturday = F.when(F.dayofmonth(day) > 1, F.date_add(day, -1)).otherwise(F.date_add(day, 2))
        sunday = F.when(F.dayofmonth(day) < F.dayofmonth(end), F.date_add(day, 1)).otherwise(F.date_add(day, -2))
        return F.when(at == 7, saturday).when(at == 1, sunday).otherwise(day)

    def day_special(p: Column) -> Column:
        n = F.regexp_extract(p, r"\d+", 0).try_cast("int")
        return F.when(p == "L", number == F.dayofmonth(end)).when(p == "LW", d == working(end)).when(p.startswith("L-"), d == F.date_sub(end, n)).otherwise((n <= F.dayofmonth(end)) & (d == working(F.date_add(F.trunc(d, "month"), n - 1))))

    def weekday_special(p: Column) -> Column:
        n = F.substring(p, 1, 1).try_cast("int") % 7
        return (weekday == n) & F.when(p.endswith("L"), number + 7 > F.dayofmonth(end)).otherwise(F.floor((number + 6) / 7) == F.split_part(p, F.lit("#"), F.lit(2)).try_cast("int"))

    by_day = F.array_contains("_day", number) | F.exists("_days", day_special)
    return F.array_contains("_month", F.month(d)) & by_day & (F.array_contains("_weekday", weekday) | F.exists("_weekdays", weekday_special))


def _later(date: Column) -> Column:
    """The first day behind a given one that suits; null if there is none."""
    parts, at = [], 1
    for days in _REACH:
        # each stretch is looked through only if those before it have no day
        parts.append(F.get(F.filter(F.sequence(F.date_add(date, at), F.date_add(date, at + days - 1)), _suits), F.lit(0)))
        at += days
    return F.coalesce(*parts)


def _from(local: Column, suits: Column | None = None, later: Column | None = None) -> Column:
    """The first local time from a given one on that suits; null if there is none. suits, later: of the time's day, where they are known."""
    h, m, s = F.hour(local), F.minute(local), F.second(local)
    least = lambda name, low: F.array_min(F.filter(f"_{name}", lambda x: x >= low))
    low = {name: F.array_min(f"_{name}") for name in ("second", "minute", "hour")}
    clock = lambda h, m, s: h * 3600 + m * 60 + s
    has_h, has_m = F.array_contains("_hour", h), F.array_contains("_minute", m)
    here = F.when(has_h & has_m, clock(h, m, least("second", s)))
    today = F.coalesce(here, F.when(has_h, clock(h, least("minute", m + 1), low["second"])), clock(least("hour", h + 1), low["minute"], low["second"]))
    date = F.to_date(local)
    moved = lambda day, seconds: day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    first = clock(low["hour"], low["minute"], low["second"])
    suits, later = _suits(date) if suits is None else suits, _later(date) if later is None else later
    return F.when(suits & today.isNotNull(), moved(date, today)).otherwise(moved(later, first))


def with_next_run(df: DataFrame, at: str, cron: str, zone: str, out: str) -> DataFrame:
    """Adds out: the first run after a moment (at: UTC, without zone) of a schedule in a zone, in UTC; null if the schedule is none or has no run."""
    ntz = lambda c: c.cast("timestamp_ntz")
    utc = lambda c: ntz(F.convert_timezone(F.col(zone), F.lit("UTC"), c))
    here = lambda c: ntz(F.convert_timezone(F.lit("UTC"), F.col(zone), c))
    seconds = lambda a, b: F.timestamp_diff("SECOND", b, a)
    plus = lambda c, s: c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s)
    offset = lambda c: seconds(here(c), c)

    kept = df.columns
    x = df.withColumn("_at", F.date_trunc("second", ntz(F.col(at)))).withColumn("_at", ntz(F.col("_at")))
    minute = lambda name, n: plus(ntz(F.date_trunc("minute", F.col(name))), n * 60)
    x = x.withColumns({"_here": here(F.col("_at")), "_offset": offset(F.col("_at"))})
    # a clock that will be put back within three hours: when, and what it shows then
    back = F.get(F.filter(F.sequence(F.lit(1), F.lit(180)), lambda n: offset(minute("_at", n)) < F.col("_offset")), F.lit(0))
    x = x.withColumn("_back", F.when(offset(plus(F.col("_at"), F.lit(10_800))) < F.col("_offset"), minute("_at", back)))
    start = plus(F.col("_here"), F.lit(1))
    x = x.withColumn("_date", F.to_date(start))
    # a schedule is read, and its next day looked for, once for each day on which it is asked for
    days = _parsed(x.select(cron, "_date").distinct(), cron)
    days = days.withColumns({"_suit": F.when(F.col("_fine"), _suits(F.col("_date"))), "_later": F.when(F.col("_fine"), _later(F.col("_date")))})
    x = x.join(days, [cron, "_date"], "left").withColumn("_fine", F.coalesce("_fine", F.lit(False)))
    x = x.withColumn("_first", F.when(F.col("_fine"), _from(start, F.col("_suit"), F.col("_later"))))
    # in a gap: on from its end, the first minute that a clock shows
    shown = lambda c: here(utc(c)) == c
    gap_end = F.get(F.filter(F.sequence(F.lit(1), F.lit(1_500)), lambda n: shown(minute("_first", n))), F.lit(0))
    x = x.withColumn("_gap", F.when(~shown(F.col("_first")), minute("_first", gap_end)))
    x = x.withColumn("_first", F.when(F.col("_gap").isNotNull(), _from(F.col("_gap"))).otherwise(F.col("_first")))
    x = x.withColumn("_early", utc(F.col("_first"))).withColumn("_late", plus(F.col("_early"), seconds(F.col("_first"), F.col("_early")) - offset(plus(F.col("_early"), F.lit(10_800)))))
    run = F.when(F.col("_early") > F.col("_at"), F.col("_early")).when((F.col("_late") > F.col("_at")) & (here(F.col("_late")) == F.col("_first")), F.col("_late"))
    # what the clock shows once more
    again = F.when(F.col("_fine") & F.col("_back").isNotNull(), _from(here(F.col("_back"))))
    x = x.withColumns({"_run": run, "_again": again}).withColumn("_again", plus(F.col("_back"), seconds(F.col("_again"), here(F.col("_back")))))
    x = x.withColumn(out, F.least("_run", F.when(here(F.col("_again")) == plus(here(F.col("_back")), seconds(F.col("_again"), F.col("_back"))), F.col("_again"))))
    return x.select(*[c for c in kept if c != out], out)
