"""Times, white space, file stems and lines as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped, fixed values: U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680, U+2000-200A, U+2028,
#: U+2029, U+202F, U+205F, U+3000.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
UNKNOWN = "UNKNOWN"


def strip(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def whole_seconds(seconds: Column) -> Column:
    """Seconds cut towards zero."""
    return seconds.cast("bigint")


def time_text(seconds: Column) -> Column:
    """``MM:SS``, or ``H:MM:SS`` from one hour on, hours unbounded; negative times wrap within the hour."""
    n = whole_seconds(seconds)
    by = lambda divisor: F.lit(divisor).cast("bigint")
    minutes, rest = F.call_function("div", F.pmod(n, by(3600)), by(60)), F.pmod(n, by(60))
    hours = F.call_function("div", n, by(3600))
    return F.when(n >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def speaker_or_unknown(speaker: Column) -> Column:
    return F.coalesce(speaker, F.lit(UNKNOWN))


def plain_line(start: Column, text: Column) -> Column:
    return F.concat(time_text(start), F.lit(" "), text)


def labelled_line(speaker: Column, start: Column, text: Column) -> Column:
    return F.concat(F.lit("["), speaker, F.lit("] "), plain_line(start, text))


def stem(name: Column) -> Column:
    """A file name without its last extension; leading dots do not begin an extension."""
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def decoded_name(name: Column) -> Column:
    """The true name behind a percent-encoded ``_metadata.file_name``."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
