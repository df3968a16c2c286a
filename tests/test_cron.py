"""Next runs of schedules against instants that are tried one after the other."""

import calendar
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from tessera.functions.cron import with_next_run

# golden: schedule, zone, after (UTC), next (UTC)
GOLDEN = [
    ("0 30 8 * * *", "Asia/Shanghai", "2026-08-20 00:00:00", "2026-08-20 00:30:00"),
    ("0 30 8 * * *", "Asia/Shanghai", "2026-08-20 00:30:00", "2026-08-21 00:30:00"),
    ("0 0 * * * *", "UTC", "2026-12-31 23:00:01", "2027-01-01 00:00:00"),
    ("*/10 * * * * *", "UTC", "2026-01-01 00:00:51", "2026-01-01 00:01:00"),
    ("0 0/15 9-17 * * MON-FRI", "UTC", "2026-08-21 17:45:00", "2026-08-24 09:00:00"),
    ("0 0 9-17 * * MON-FRI", "Asia/Shanghai", "2026-08-21 09:00:00", "2026-08-24 01:00:00"),
    ("0 0 6,19 * * *", "UTC", "2026-08-21 06:00:00", "2026-08-21 19:00:00"),
    ("0 0 0 25 DEC ?", "UTC", "2026-12-25 00:00:00", "2027-12-25 00:00:00"),
    ("0 0 0 L * *", "UTC", "2028-02-10 00:00:00", "2028-02-29 00:00:00"),
    ("0 0 0 L-3 * *", "UTC", "2026-02-26 00:00:00", "2026-03-28 00:00:00"),
    ("0 0 0 1W * *", "UTC", "2026-07-15 00:00:00", "2026-08-03 00:00:00"),
    ("0 0 0 15W * *", "UTC", "2026-08-10 00:00:00", "2026-08-14 00:00:00"),
    ("0 0 0 LW * *", "UTC", "2026-05-01 00:00:00", "2026-05-29 00:00:00"),
    ("0 0 0 * * 5L", "UTC", "2026-08-01 00:00:00", "2026-08-28 00:00:00"),
    ("0 0 0 * * THUL", "UTC", "2026-08-01 00:00:00", "2026-08-27 00:00:00"),
    ("0 0 0 ? * 5#2", "UTC", "2026-08-01 00:00:00", "2026-08-14 00:00:00"),
    ("0 0 0 ? * MON#1", "UTC", "2026-08-04 00:00:00", "2026-09-07 00:00:00"),
    ("0 0 0 13 * FRI", "UTC", "2026-08-01 00:00:00", "2026-11-13 00:00:00"),
    ("0 0 0 29 2 *", "UTC", "2026-01-01 00:00:00", "2028-02-29 00:00:00"),
    ("0 0 0 29 FEB SUN", "UTC", "2026-01-01 00:00:00", "2032-02-29 00:00:00"),
    ("0 0 0 * * 7", "UTC", "2026-08-20 00:00:00", "2026-08-23 00:00:00"),
    ("0 0 0 * * FRI-7", "UTC", "2026-08-20 00:00:00", "2026-08-21 00:00:00"),
    ("@hourly", "Asia/Kolkata", "2026-08-20 00:00:00", "2026-08-20 00:30:00"),
    ("@monthly", "Asia/Shanghai", "2026-08-20 00:00:00", "2026-08-31 16:00:00"),
    ("@yearly", "UTC", "2026-08-20 00:00:00", "2027-01-01 00:00:00"),
    ("0 30 2 * * *", "Europe/Berlin", "2026-03-28 12:00:00", "2026-03-30 00:30:00"),  # the clock never shows 2:30 on March 29
    ("0 */20 2 * * *", "Europe/Berlin", "2026-03-28 12:00:00", "2026-03-30 00:00:00"),
    ("0 30 2 * * *", "Europe/Berlin", "2026-10-25 00:30:00", "2026-10-25 01:30:00"),  # and twice on October 25
    ("0 30 2 * * *", "Europe/Berlin", "2026-10-25 01:30:00", "2026-10-26 01:30:00"),
    ("0 30 2 25 10 *", "Europe/Berlin", "2026-10-25 00:45:00", "2026-10-25 01:30:00"),
    ("0 0 0 31 2 *", "UTC", "2026-01-01 00:00:00", None),
    ("0 0 0 * *", "UTC", "2026-01-01 00:00:00", None),
    ("0 0 24 * * *", "UTC", "2026-01-01 00:00:00", None),
    ("a b c d e f", "UTC", "2026-01-01 00:00:00", None),
]
SCHEDULES = ["0 */7 * * * *", "30 15 1-3 * * *", "0 0 2 * * *", "0 59 1,2 * * *", "0 0 0 1,15 * *", "0 10 0 ? * 1-5/2", "0 0 */5 L,1W * *", "15,45 30 2 * 3,10 *"]
ZONES = ["UTC", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu"]


def numbers(field, low, high):
    out = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first = low if a in "*?" else int(a)
        last = high if a in "*?" or (step and not b) else int(b or a)
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def tried(schedule, zone, after):
    """The first minute (and second) after a moment whose local time suits."""
    second, minute, hour, day, month, weekday = schedule.split()
    sets = numbers(second, 0, 59), numbers(minute, 0, 59), numbers(hour, 0, 23)
    days, at = [p for p in day.split(",") if p in ("L", "1W")], after.replace(second=0)
    plain = numbers(",".join(p for p in day.split(",") if p not in ("L", "1W")), 1, 31) if len(days) < len(day.split(",")) else set()
    for _ in range(60 * 24 * 40):
        local = at.astimezone(ZoneInfo(zone))
        end = calendar.monthrange(local.year, local.month)[1]
        first = next(d for d in range(1, 4) if datetime(local.year, local.month, d).weekday() < 5)
        fits = local.day in plain or ("L" in days and local.day == end) or ("1W" in days and local.day == first)
        if fits and local.minute in sets[1] and local.hour in sets[2] and local.month in numbers(month, 1, 12) and local.isoweekday() % 7 in {x % 7 for x in numbers(weekday, 0, 7)}:
            for s in sorted(sets[0]):
                if at + timedelta(seconds=s) > after:
                    return at + timedelta(seconds=s)
        at += timedelta(minutes=1)
    return None


def test_golden(spark):
    moment = lambda x: x and datetime.fromisoformat(x)
    df = spark.createDataFrame([(i, s, z, moment(a)) for i, (s, z, a, _) in enumerate(GOLDEN)], "i int, schedule string, zone string, after timestamp_ntz")
    got = {r.i: r.due for r in with_next_run(df, "after", "schedule", "zone", "due").collect()}
    assert {GOLDEN[i][:3]: d for i, d in got.items()} == {g[:3]: moment(g[3]) for g in GOLDEN}


def test_around_changes_of_the_clock(spark):
    starts = [datetime(2026, 3, 7, 20), datetime(2026, 3, 28, 20), datetime(2026, 10, 24, 21), datetime(2026, 11, 1, 2), datetime(2026, 4, 4, 12), datetime(2026, 10, 3, 12)]
    rows = []
    for i in range(240):
        rows.append((SCHEDULES[i % 8], ZONES[i // 8 % 5], starts[i % 6] + timedelta(minutes=(i * 37) % 900, seconds=i % 60)))
    df = spark.createDataFrame(rows, "schedule string, zone string, after timestamp_ntz")
    for r in with_next_run(df, "after", "schedule", "zone", "due").collect():
        want = tried(r.schedule, r.zone, r.after.replace(tzinfo=UTC))
        if want is None:  # farther than the trial goes
            assert r.due is None or r.due > r.after + timedelta(days=39)
        else:
            assert r.due == want.replace(tzinfo=None), (r, want)
