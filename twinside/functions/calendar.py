"""Dates, seasons, dayparts and zone conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEASON_FIRST_MONTH = 7
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def season_start_of(date: Column) -> Column:
    """Calendar year in which the season holding ``date`` began."""
    return F.when(F.month(date) >= SEASON_FIRST_MONTH, F.year(date)).otherwise(F.year(date) - 1)


def season_label(start: Column) -> Column:
    return F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100)))


def season_label_of(date: Column) -> Column:
    return season_label(season_start_of(date))


def season_from_text(text: Column) -> Column:
    """First ``yy[-_]yy`` group of a file name as a ``20yy-yy`` label; null when absent."""
    pattern = r"(20)?(\d{2})[-_]?(\d{2})"
    return F.when(
        text.rlike(pattern),
        F.concat(F.lit("20"), F.regexp_extract(text, pattern, 2), F.lit("-"), F.regexp_extract(text, pattern, 3)),
    )


def _season_parts(label: Column) -> tuple[Column, Column, Column]:
    pattern = r"^(\d{4})[-/](\d{4}|\d{2})$"
    start = F.regexp_extract(label, pattern, 1).try_cast("int")
    tail = F.regexp_extract(label, pattern, 2)
    expected = F.when(F.length(tail) == 2, F.pmod(start + 1, F.lit(100))).otherwise(start + 1)
    return start, tail, expected


def season_start_or_null(label: Column) -> Column:
    """Start year of ``YYYY-YY`` / ``YYYY/YYYY`` with a consistent end, else null."""
    start, tail, expected = _season_parts(label)
    return F.when(tail.try_cast("int") == expected, start)


def season_start(label: Column) -> Column:
    """As above, but a malformed label fails the job."""
    start = season_start_or_null(label)
    message = F.concat(F.lit("malformed season label: "), F.coalesce(label, F.lit("null")))
    return F.when(start.isNull(), F.raise_error(message).cast("int")).otherwise(start)


def season_key(label: Column) -> Column:
    """Leading integer of a label, -1 when there is none."""
    return F.coalesce(F.split(label, "-").getItem(0).try_cast("int"), F.lit(-1))


def last_seasons(label: Column, n: int = 3) -> Column:
    """The label's season and the ``n - 1`` before it, newest first."""
    start = season_key(label)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: season_label(start - i.cast("int")))


def iso_date(text: Column) -> Column:
    """Strict ``YYYY-MM-DD`` to date; anything else is null."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def day_first_date(text: Column) -> Column:
    """``dd/MM/yyyy`` or ``dd/MM/yy``; null when neither parses."""
    t = F.trim(text)
    four = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy")))
    two = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(t, F.lit("d/M/yy")))
    # Two-digit years 69..99 belong to the last century, as in POSIX.
    two = F.when(F.year(two) > 2068, F.add_months(two, -1200)).otherwise(two.cast("date"))
    return F.coalesce(four.cast("date"), two)


def weekday(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def clock_minutes(clock: Column) -> Column:
    """Minutes after midnight of a strict ``HH:MM``; null when malformed."""
    parts = F.split(clock, ":")
    return F.when(
        clock.rlike(CLOCK), parts.getItem(0).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")
    )


def daypart(clock: Column) -> Column:
    m = clock_minutes(clock)
    return F.when(m < 900, "early").when(m < 1050, "afternoon").when(m.isNotNull(), "late")


def local_to_utc(local: Column, zone: str) -> Column:
    """Wall time to UTC, both without a zone, so the session zone plays no part."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def utc_to_local(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def wall_time_problem(local: Column, zone: str) -> Column:
    """``'nonexistent'`` in a spring gap, ``'ambiguous'`` in an autumn fold, else null."""
    utc = local_to_utc(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    other = (utc_to_local(utc + hour, zone) == local) | (utc_to_local(utc - hour, zone) == local)
    return F.when(utc_to_local(utc, zone) != local, "nonexistent").when(other, "ambiguous")
