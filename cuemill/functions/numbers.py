"""Numbers, labels and times on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BUCKETS = (24, 48, 96, 160, 256)


def clamp(value: Column, low, high) -> Column:
    """``value`` moved into [low, high]; a null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def clamped_int(value: Column, low: int, high: int, default: int) -> Column:
    """An integer from any column: unreadable and missing values are the default, others are clamped."""
    return clamp(F.coalesce(value.try_cast("int"), F.lit(default)), low, high)


def percent_to_db(percent: Column) -> Column:
    p = clamp(percent.cast("double"), 0.0, 100.0)
    return F.when(p == 0, F.lit(-100.0)).otherwise(20 * F.log10(p / 100))


def loop_count(total: Column, one: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.nullif(one, F.lit(0)))).cast("int")


def eta_seconds(elapsed: Column, progress: Column) -> Column:
    """Seconds left at this pace; null below 5 %."""
    p = clamp(progress, 0, 99)
    return F.when(p >= 5, F.greatest(F.lit(0), F.bround(elapsed * (100 - p) / p).cast("long")))


def duration_label(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0)).cast("long"))
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def _tenths(n: Column, unit: int) -> Column:
    """n / unit in whole tenths, rounded as its binary value: on what looks like a tie (30,150 thousandths of a unit) the
    double lies a little over or under it, and only where it is exact the even digit wins."""
    tenth, half = unit // 10, unit // 20
    rest = n % tenth
    near = F.call_function("div", n, F.lit(tenth))
    ratio = n / F.lit(float(unit))
    part = ((ratio - F.floor(ratio)) * F.lit(2.0**52)).cast("long")  # exact: a ratio of 1 or more has at most 52 binary places
    over = F.lit(20) * part - (2 * (near % 10) + 1) * F.lit(2**52)
    up = (rest > half) | ((rest == half) & ((over > 0) | ((over == 0) & (near % 2 == 1))))
    return near + F.when(up, 1).otherwise(0)


def count_label(count: Column) -> Column:
    """1.2K, 3M, 4.5B; "-" for null."""
    n = F.greatest(F.lit(0), count.cast("long"))

    def part(unit: int, sign: str) -> Column:
        t = _tenths(n, unit)
        return F.concat(F.floor(t / 10).cast("string"), F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), (t % 10).cast("string"))), F.lit(sign))

    return F.when(count.isNull(), "-").when(n >= 10**9, part(10**9, "B")).when(n >= 10**6, part(10**6, "M")).when(n >= 1000, part(1000, "K")).otherwise(n.cast("string"))


def memory_label(size: Column) -> Column:
    """Gigabytes with one decimal, rounded as their binary value, a tie to the even digit: a format of the JVM rounds ties up."""
    n = F.abs(size)
    part = 10 * (n - F.floor(n))  # of a byte, in tenths
    tenths = 10 * F.floor(n) + F.floor(part)
    up = F.shiftright(tenths, 30).bitwiseAND(F.lit(1)).bitwiseOR((part > F.floor(part)).cast("long"))
    t = F.shiftright(tenths + (2**29 - 1) + up, 30)
    return F.when(F.coalesce(size, F.lit(0)) == 0, "--").otherwise(F.format_string("%.1f GB", F.signum(size) * t / 10))


def date_label(day: Column) -> Column:
    """YYYYMMDD with dashes; anything else as it is."""
    return F.when(day.rlike("^[0-9]{8}$"), F.regexp_replace(day, "^(....)(..)(..)$", "$1-$2-$3")).otherwise(day)


def published_day(upload_date: Column, epoch: Column) -> Column:
    """The given day, else that of the epoch seconds in UTC, else ""."""
    return F.coalesce(F.nullif(F.trim(upload_date), F.lit("")), F.date_format(F.timestamp_seconds(epoch.try_cast("double")), "yyyyMMdd"), F.lit(""))


def ass_time(seconds: Column) -> Column:
    """h:mm:ss.cc"""
    c = F.bround(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c % 360000 / 6000), F.floor(c % 6000 / 100), c % 100)


def srt_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm"""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def retry_delay(attempt: Column, base: float, stagger: Column) -> Column:
    return F.least(F.lit(12.0), F.lit(base) * F.pow(F.lit(2.0), attempt - 1) + stagger)


def failure_backoff(failures: Column, base: float) -> Column:
    return F.least(F.lit(300.0), F.lit(base) * F.pow(F.lit(2.0), failures - 1))


def token_budget(tokens: Column) -> Column:
    """The smallest bucket that holds three times the tokens and 8, at least 16; the largest bucket beyond."""
    want = F.greatest(F.lit(16), tokens * 3 + 8)
    out = F.when(want <= TOKEN_BUCKETS[0], TOKEN_BUCKETS[0])
    for bucket in TOKEN_BUCKETS[1:-1]:
        out = out.when(want <= bucket, bucket)
    return out.otherwise(TOKEN_BUCKETS[-1])


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(100), F.bround(100 * part / whole).cast("int"))).otherwise(0)


def tempo_chain(factor: Column) -> Column:
    """Speed factors of at most 2 each whose product is the wanted one (at least 1)."""
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(factor, F.lit(1.0)))) - 1).cast("int")
    rest = F.greatest(factor / F.pow(F.lit(2.0), doublings), F.lit(1.0))
    return F.concat(F.array_repeat(F.lit(2.0), doublings), F.array(rest))


def fits_slot(length_ms: Column, slot_ms: Column) -> Column:
    """Whether what is over the slot is a rounding tail only: 5 % of it, or 20 ms."""
    return length_ms - slot_ms <= F.greatest(F.lit(20), (slot_ms * 0.05).cast("int"))
