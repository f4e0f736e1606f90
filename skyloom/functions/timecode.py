"""Time codes: MJD, bin labels, packed epochs and file-name time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import _c

MJD_UNIX_EPOCH = 40587
MICROS_PER_DAY = 86_400_000_000

# Days per unit of a time-bin label.
UNIT_DAYS = {"sec": 1 / 86400, "min": 1 / 1440, "hr": 1 / 24, "day": 1.0}

# Default time bins up to (excluding) a sector number.
DEFAULT_BINS = [
    (27, ["30min", "1hr", "2hr", "6hr", "24hr"]),
    (56, ["10min", "30min", "1hr", "3hr", "12hr", "24hr"]),
    (None, ["200sec", "30min", "1hr", "6hr", "24hr"]),
]


def mjd(ts) -> Column:
    """Timestamp to modified Julian date (session time zone UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6) / F.lit(86400.0) + MJD_UNIX_EPOCH


def mjd_to_timestamp(value) -> Column:
    """Modified Julian date to timestamp, to the microsecond."""
    return F.timestamp_micros(F.rint((_c(value) - MJD_UNIX_EPOCH) * MICROS_PER_DAY).cast("long"))


def timestamp_to_iso(ts) -> Column:
    """ISO text of a timestamp with milliseconds, halves away from zero."""
    seconds = F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)
    return F.date_format(F.timestamp_millis(F.round(seconds * 1000.0).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def mjd_to_iso(value) -> Column:
    """ISO text with milliseconds; a date of our time resolves 0.6 microseconds, so text of a known timestamp comes from ``timestamp_to_iso``."""
    return timestamp_to_iso(mjd_to_timestamp(value))


def iso_to_mjd(text) -> Column:
    return mjd(F.to_timestamp(_c(text)))


def bin_frames(label, cadence_days, search: bool = False) -> Column:
    """Frames in a bin label such as ``30min``.

    The search rounds half up; detection limits round half even and use at least one frame.
    """
    text = F.trim(_c(label))
    number = F.regexp_extract(text, r"^([\d.]+)", 1).cast("double")
    unit = F.regexp_extract(text, r"^[\d.]+(\w+)", 1)
    days = F.element_at(F.create_map(*[x for u, d in UNIT_DAYS.items() for x in (F.lit(u), F.lit(d))]), unit)
    ratio = number * days / _c(cadence_days)
    return F.floor(ratio + 0.5).cast("long") if search else F.greatest(F.lit(1), F.rint(ratio)).cast("long")


def default_bins(sector) -> Column:
    """Array of default bin labels for a sector."""
    s = _c(sector)
    out = None
    for bound, labels in DEFAULT_BINS:
        arr = F.array(*[F.lit(x) for x in labels])
        if out is None:
            out = F.when(s < bound, arr)
        else:
            out = out.otherwise(arr) if bound is None else out.when(s < bound, arr)
    return out


def packed_epoch_mjd(code) -> Column:
    """Five-character packed epoch (century letter, yy, month, day) to MJD, else NULL."""
    c = _c(code)
    char = lambda i: F.substring(c, i, 1)
    number = lambda x: F.when(x.rlike("^[0-9]$"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    year = 100 * number(char(1)) + F.substring(c, 2, 2).try_cast("int")
    month, day = number(char(4)), number(char(5))
    # Day overflow rolls into the next month, as in a Julian-day formula.
    first = F.when((month >= 1) & (month <= 12) & (year >= 1), F.make_date(year, month, F.lit(1)))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + (day - 1)
    return F.when(c.rlike("^[A-Za-z0-9][0-9]{2}[A-Za-z0-9]{2}$"), (days + MJD_UNIX_EPOCH).cast("double"))


def filename_mjd(name) -> Column:
    """MJD of the first 13-digit ``yyyydddhhmmss`` stamp in a file name."""
    stamp = F.regexp_extract(_c(name), r"(\d{13})", 1)
    piece = lambda a, n: F.substring(stamp, a, n).try_cast("int")
    start = F.make_date(piece(1, 4), F.lit(1), F.lit(1))
    days = F.datediff(start, F.lit("1970-01-01").cast("date")) + piece(5, 3) - 1
    return days + MJD_UNIX_EPOCH + (piece(8, 2) * 3600 + piece(10, 2) * 60 + piece(12, 2)) / F.lit(86400.0)
