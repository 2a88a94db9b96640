"""Date columns: parsing feed dates, periods, and differences in seconds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offsets and the zone names that feeds use for them.
ZONE_NAMES = {
    "+0000": "Z|GMT|UTC|UT|WET", "-0400": "EDT", "-0500": "EST|CDT", "-0600": "CST|MDT", "-0700": "MST|PDT", "-0800": "PST",
    "+0100": "CET|BST|WEST|MEZ", "+0200": "CEST|EET|MESZ", "+0300": "EEST|MSK", "+0530": "IST", "+0800": "HKT|SGT", "+0900": "JST|KST",
}
_DAYS = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*"

# The shapes that every readable text is brought to.
_LAYOUTS = tuple(f"{day} {time} xx" for day in ("yyyy-M-d", "d MMM yyyy") for time in ("H:m:s[.SSSSSS]", "h:m:s[.SSSSSS] a"))

# Rewrites in order, each a single pass so that the expression grows by one node only.
_REWRITES = (
    (r"\s+", " "),
    (r"^ | $", ""),
    (r" ?\([A-Za-z ]+\)$", ""),                                    # zone once more, as a remark
    (rf"^(?:[A-Za-z]{{3,9}}, ?|{_DAYS} )", ""),                     # weekday
    (r"^(\d{4})(\d\d)(\d\d)(?:[Tt ]?(\d\d)(\d\d)(\d\d)?)?(?=Z|[+-]|$)", "$1-$2-$3 $4:$5:$6"),
    (r" ::$|(?<= \d\d:\d\d):(?=Z|[+-]|$)", ""),                     # parts that basic form left out
    (r"^(1[3-9]|2\d|3[01])/(\d{1,2})/(\d{4})", "$3-$2-$1"),        # day first where it can't be a month
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1"),
    (r"^([A-Za-z]{3,9}) (\d{1,2}) (\d{1,2}:[\d:.]+)((?: [A-Za-z]+)?) (\d{4})$", "$2 $1 $5 $3$4"),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[Tt](?=\d))?", "$1-$2-$3 "),
    (r",", ""),
    (r"^([A-Za-z]{3,9})\.? (\d{1,2}) (\d{4})", "$2 $1 $3"),       # month first
    (r"^(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*-?", "$1 $2 "),             # month by three letters
    (r"^(\d{1,2} [A-Za-z]{3}) +([0-6]\d)(?= |$)", "$1 20$2"),     # years of two digits
    (r"^(\d{1,2} [A-Za-z]{3}) +(\d\d)(?= |$)", "$1 19$2"),
    (r"(?<=\d) ?([AaPp])\.?[Mm]\.?(?= |$)", " $1M"),
    *((rf"(?i)(?<=\d|[ap]m) ?(?:{names})$", f" {offset}") for offset, names in ZONE_NAMES.items()),
    (r"(:\d{2}(?:\.\d+)?(?: [AaPp]M)?) ?([+-]\d{2}):?(\d{2})$", "$1 $2$3"),
    (r"(\.\d{6})\d+", "$1"),
    (r"^(?!.*\d:\d{2})(.+)$", "$1 00:00:00"),                     # no time of day
    (r"^(?!.* [+-]\d{4}$)(.+)$", "$1 +0000"),                     # no zone: UTC
    (r" (\d{1,2}:\d{2}) (?=(?:[AaPp]M )?[+-]\d{4}$)", " $1:00 "),   # no seconds
    (r" +", " "),
)


def as_of_literal(as_of: datetime | str) -> Column:
    """A zone-free UTC timestamp literal."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed seconds from ``earlier`` to ``later`` (both zone-free), as double."""
    return (later - earlier).cast("interval second").cast("decimal(20,6)").cast("double")


def parse_date(c: Column) -> Column:
    """Read the date styles found in feeds; convert to UTC; null when unreadable.

    A text without zone is taken as UTC.
    """
    s = c
    for pattern, shape in _REWRITES:
        s = F.regexp_replace(s, pattern, shape)
    instant = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in _LAYOUTS])
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def week_of(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(F.to_date(ts), "week")


def period_of(ts: Column, kind: str) -> Column:
    return {"daily": day_of, "weekly": week_of}[kind](ts)


def period_days(kind: str) -> int:
    return {"daily": 1, "weekly": 7}[kind]
