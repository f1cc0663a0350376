"""First-schedule text + frequency -> Quartz cron text, as Column expressions.

The schedule text is ``H:M:S`` with an optional prefix (day of month or weekday),
split off by a comma or by a blank. The time is parsed before the frequency is
looked at, so a bad time yields NULL whatever the frequency.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import _c, delimiter_kind, py_strip

# H 0-23, M 0-59, S 0-59; one or two digits each (a 60th second does not parse).
TIME_PATTERN = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9]):([0-5]?[0-9])$"

# The exact cron layouts per frequency ({s} {m} {h} are integers).
#   daily    "{s} {m} {h} * * ? "
#   monthly  "{s} {m} {h} {prefix} * ? "
#   weekly   "{s} {m} {h}  ? * {first three letters of prefix}"
#   hourly   "{s} {m} * * *  ? "
#   other    "not yet supported"
NOT_SUPPORTED = "not yet supported"


def split_schedule(text: Column | str) -> tuple[Column, Column]:
    """(prefix, clock) of a schedule text; prefix is NULL when there is no delimiter."""
    t = _c(text)
    kind = delimiter_kind(t)
    squeezed = F.regexp_replace(t, r"(?U)\s{2,}", " ")
    prefix = F.when(kind == "comma", py_strip(F.split_part(t, F.lit(","), F.lit(1)))).when(
        kind == "space", py_strip(F.split_part(squeezed, F.lit(" "), F.lit(1)))
    )
    clock = (
        F.when(kind == "comma", py_strip(F.split_part(t, F.lit(","), F.lit(2))))
        .when(kind == "space", py_strip(F.split_part(squeezed, F.lit(" "), F.lit(2))))
        .otherwise(t)
    )
    return prefix, clock


def schedule_to_cron(time_text: Column | str, frequency: Column | str, canonical: bool = False) -> Column:
    """Quartz cron text, ``not yet supported`` for other frequencies, NULL when the time
    does not parse or a weekly/monthly schedule has no prefix.

    ``canonical=True`` collapses the double blanks and trims the result.
    """
    prefix, clock = split_schedule(time_text)
    parses = clock.rlike(TIME_PATTERN)
    # once the pattern matched, the three fields are exactly the ':'-separated parts
    h, m, s = (F.split_part(clock, F.lit(":"), F.lit(i)).cast("int") for i in (1, 2, 3))
    freq = F.lower(_c(frequency))
    cron = (
        F.when(freq == "daily", F.format_string("%d %d %d * * ? ", s, m, h))
        .when(freq == "monthly", F.concat(F.format_string("%d %d %d ", s, m, h), prefix, F.lit(" * ? ")))
        .when(freq == "weekly", F.concat(F.format_string("%d %d %d  ? * ", s, m, h), F.substring(prefix, 1, 3)))
        .when(freq == "hourly", F.format_string("%d %d * * *  ? ", s, m))
        .otherwise(F.lit(NOT_SUPPORTED))
    )
    out = F.when(parses, cron)
    if canonical:
        out = F.when(out == NOT_SUPPORTED, out).otherwise(F.trim(F.regexp_replace(out, " +", " ")))
    return out


def is_missing(value: Column | str) -> Column:
    """NULL, blank, or the text ``nan`` (any case): what S6 reads as missing."""
    v = _c(value)
    return v.isNull() | (F.trim(v) == "") | (F.lower(F.trim(v)) == "nan")


def schedule_mode(frequency: Column | str, time_text: Column | str) -> Column:
    """``schedule`` when both a frequency and a first time are given, else ``create``
    (the job is made without a schedule)."""
    return F.when(is_missing(frequency) | is_missing(time_text), F.lit("create")).otherwise(F.lit("schedule"))
