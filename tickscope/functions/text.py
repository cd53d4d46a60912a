"""Column expressions for checking raw bytes and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar date, optionally followed by a clock time and an offset. Spark's own
# cast would also take '2024' or '15:30:00', which are not ISO timestamps.
ISO_TIMESTAMP = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)

# The rarer forms: compact and week dates, any separator, compact times, long fractions
# and offsets up to a day. Groups: 1 year, 2-5 month and day, 6-9 week and weekday,
# 10-16 clock time, 17 offset.
WIDE_TIMESTAMP = (
    r"^(?!0000)(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
    r"(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
    r"(Z|[+-]\d{2}(?::\d{2}(?::\d{2})?|\d{2}(?:\d{2})?)?)?)?$"
)


def is_single_json(text: Column) -> Column:
    """True iff ``text`` is exactly one JSON value with nothing after it.

    Spark's JSON functions ignore what follows the first value, so the text is
    parsed inside two different wrappers; trailing text breaks one of them.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))
    return in_array.isNotNull() & in_object.isNotNull()


def json_kind(text: Column) -> Column:
    """Name of the JSON value's type as error messages spell it."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "NoneType")
        .when(kind == "BIGINT", "int")
        .otherwise(F.when(text.rlike(r"[.eE]"), "float").otherwise("int"))
    )


def quoted(value: Column) -> Column:
    """A string in single quotes, ``None`` for null."""
    return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))


def quoted_list(values: Column) -> Column:
    """``['a', 'b']`` for a non-empty array of strings."""
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def missing_keys(required: tuple[str, ...], present: Column) -> Column:
    """Required keys that are not present, in the (alphabetical) order of ``required``."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), present)


def iso_timestamp(text: Column) -> Column:
    """Timestamp of ISO-8601 text, null where it is not one; no offset means UTC.

    The usual form is cast; only text that gives nothing is taken apart.
    """
    usual = F.when(
        text.rlike(ISO_TIMESTAMP), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp")
    )
    return F.coalesce(usual, F.when(text.rlike(WIDE_TIMESTAMP), _wide_timestamp(text)))


def _wide_timestamp(text: Column) -> Column:
    """The instant of text in :data:`WIDE_TIMESTAMP`; null if a field is out of range."""

    def part(*groups: int) -> Column:
        found = [F.regexp_extract(text, WIDE_TIMESTAMP, g) for g in groups]
        return F.coalesce(*[F.when(f != "", f) for f in found])

    def number(*groups: int) -> Column:
        return F.coalesce(part(*groups).cast("int"), F.lit(0))

    year, week = part(1), part(6, 8).cast("int")
    weekday = F.coalesce(part(7, 9).cast("int"), F.lit(1))
    fourth = F.concat(year, F.lit("-01-04")).cast("date")  # always in the first week
    monday = F.date_add(fourth, 7 * (week - 1) - F.weekday(fourth))
    in_year = F.year(F.date_add(monday, 3)) == year.cast("int")
    of_week = F.when((weekday >= 1) & (weekday <= 7) & (week >= 1) & in_year, F.date_add(monday, weekday - 1))
    of_month = F.concat_ws("-", year, part(2, 4), part(3, 5)).try_cast("date")
    day = F.when(week.isNotNull(), of_week).otherwise(F.when(part(2, 4).isNotNull(), of_month))

    hour, minute, second = number(10), number(11, 14), number(12, 15)
    micros = F.rpad(F.substring(F.coalesce(part(13, 16), F.lit("0")), 1, 6), 6, "0").cast("bigint")
    offset = F.regexp_replace(F.coalesce(part(17), F.lit("Z")), "[:Z]", "")
    away = F.rpad(F.substring(offset, 2, 6), 6, "0")
    pieces = [F.substring(away, at, 2).cast("int") for at in (1, 3, 5)]
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)

    def within(h: Column, m: Column, s: Column) -> Column:
        return (h <= 23) & (m <= 59) & (s <= 59)

    def seconds(h: Column, m: Column, s: Column) -> Column:
        return h * 3600 + m * 60 + s

    at = F.unix_date(day).cast("bigint") * 86400 + seconds(hour, minute, second) - sign * seconds(*pieces)
    valid = within(hour, minute, second) & within(*pieces)
    return F.when(valid, F.timestamp_micros(at * 1_000_000 + micros))


def json_field(text: Column, name: str) -> tuple[Column, Column]:
    """Whether a field of a JSON object is a string, and how error messages spell its value."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")
    kind, body = F.schema_of_variant(value), F.to_json(value)
    spaced = F.regexp_replace(F.regexp_replace(body, '([,:])(?=[\\["{0-9tfn-])', "$1 "), '"', "'")
    spelled = F.regexp_replace(spaced, r"\bnull\b", "None")
    spelled = F.regexp_replace(F.regexp_replace(spelled, r"\btrue\b", "True"), r"\bfalse\b", "False")
    shown = F.when(kind == "STRING", quoted(F.try_variant_get(value, "$", "string"))).otherwise(spelled)
    return kind == "STRING", F.coalesce(F.when(kind != "VOID", shown), F.lit("None"))


def iso_text(ts: Column) -> Column:
    """``2024-01-02T15:30:00+00:00``, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )
