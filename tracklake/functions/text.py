"""Names, ids and timestamps in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the form of a date and time in a file name.
FILENAME_TIME = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[ _T-]?(\d{2})[-_:]?(\d{2})[-_:]?(\d{2})"


def normalised(name: Column) -> Column:
    """Upper case, letters A-Z and digits alone."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if either is empty or null."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    ratio = 1 - F.levenshtein(a, b) / longer
    return F.when((F.coalesce(F.char_length(a), F.lit(0)) > 0) & (F.coalesce(F.char_length(b), F.lit(0)) > 0), F.greatest(F.lit(0.0), ratio)).otherwise(0.0)


def filename_timestamp(name: Column) -> Column:
    """First date and time found in a file name (UTC); null if there is none or it is no valid time."""
    part = lambda i: F.nullif(F.regexp_extract(name, FILENAME_TIME, i), F.lit("")).cast("int")
    return F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"))


def exif_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def plausible(time: Column, now: Column) -> Column:
    """From 2005 on and not more than a day ahead."""
    return F.coalesce((F.year(time) >= 2005) & (time <= now + F.expr("INTERVAL 1 DAY")), F.lit(False))


def short_id(*parts: Column, prefix: str = "") -> Column:
    """Prefix and the first 16 hex digits of the SHA-256 of the parts joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16))


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row's business columns in the order of their names, nulls included: our own canonical form."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string")), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def json_list(text: Column) -> Column:
    """A JSON list of strings; malformed text or null is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
