"""Column expressions over ids, names, URIs, versions and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewatch.values import (
    IDENTIFIER,
    RERUNNABLE_JOB_STATUSES,
    RESUMABLE_JOB_STATUSES,
    STOPPABLE_JOB_STATUSES,
    TICKET,
    TIME_UNITS,
    URI,
    VERSION,
)


def quoted(name: str) -> str:
    """A column name as it must be written in an expression."""
    return "`" + name.replace("`", "``") + "`"


def resumable(status: Column) -> Column:
    return status.isin(RESUMABLE_JOB_STATUSES)


def rerunnable(status: Column) -> Column:
    return status.isin(RERUNNABLE_JOB_STATUSES)


def stoppable(status: Column) -> Column:
    return status.isin(STOPPABLE_JOB_STATUSES)


def deterministic_id(tenant: Column, key: Column) -> Column:
    """The same job id for the same tenant and trigger key, every time."""
    digest = F.sha2(F.concat(tenant, F.lit(":"), key), 256)
    return F.concat(F.lit("job-"), F.substring(digest, 1, 12))


def parse_vcpu(text: Column) -> Column:
    """First number in a text such as "400 vCPU", else NULL."""
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("int")


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(slug, F.lit("-")), F.lit("")), F.lit("tenant"))


def safe_filename(name: Column) -> Column:
    """Last path element with unsafe characters replaced."""
    base = F.substring_index(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), "/", -1)
    clean = F.btrim(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("artifact"))


def valid_identifier(text: Column) -> Column:
    return text.rlike(IDENTIFIER)


def valid_uri(text: Column) -> Column:
    return text.rlike(URI)


def valid_version(text: Column) -> Column:
    return F.btrim(text).rlike(VERSION)


def valid_ticket(text: Column) -> Column:
    return text.rlike(TICKET)


def split_uri(uri: Column) -> Column:
    """struct<bucket, prefix>, NULL when the scheme is wrong or there is no bucket."""
    pattern = r"(?s)^s3://([^/]+)/?(.*)$"
    return F.when(
        uri.rlike(pattern),
        F.struct(
            F.regexp_extract(uri, pattern, 1).alias("bucket"),
            F.regexp_extract(uri, pattern, 2).alias("prefix"),
        ),
    )


def relative_time(ts: Column, as_of: Column) -> Column:
    """struct<amount, unit>: the distance from ``as_of`` in the largest unit that fits.

    Halves round towards the future, as the display does.
    """
    def nearest(x: Column) -> Column:
        return F.floor(x + 0.5).cast("long")

    seconds = nearest((F.unix_micros(ts) - F.unix_micros(as_of)) / 1e6)
    unit, size = F.lit("second"), F.lit(1)
    for name, width in reversed(TIME_UNITS):
        unit = F.when(F.abs(seconds) >= width, name).otherwise(unit)
        size = F.when(F.abs(seconds) >= width, width).otherwise(size)
    return F.struct(nearest(seconds / size).alias("amount"), unit.alias("unit"))


def version_key(version: Column) -> Column:
    """Sort key under which 2 comes before 10: digit runs compare as numbers.

    Each digit run is stripped of leading zeros and prefixed with its length.
    """
    parts = F.regexp_extract_all(F.lower(version), F.lit(r"(\d+|[a-z]+|[^a-z\d]+)"), F.lit(1))

    def sortable(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, sortable), " ")


def run_prefix(base: Column, run_date: Column, run_id: Column) -> Column:
    """``<base>/<YYYY-MM-DD>/<run id>/`` as a column."""
    return F.concat(
        F.regexp_replace(base, "/+$", ""), F.lit("/"), F.date_format(run_date, "yyyy-MM-dd"), F.lit("/"), run_id, F.lit("/")
    )


def number_text(x: Column) -> Column:
    """A double as plain text where the JVM would write an exponent for 0.0001 to 0.001: 0.0005, not 5.0E-4."""
    text, small = x.cast("string"), r"^(-?)(\d)\.(\d+)E-4$"
    digits = F.regexp_replace(F.concat(F.regexp_extract(text, small, 2), F.regexp_extract(text, small, 3)), "0+$", "")
    return F.when(text.rlike(small), F.concat(F.regexp_extract(text, small, 1), F.lit("0.000"), digits)).otherwise(text)


def stripped(x: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
