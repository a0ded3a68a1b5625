"""Column expressions shared by the operators.

All of these are built-in Catalyst expressions (no Python UDFs), so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentlake.config import NULL_MARKER

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- null handling -----------------------------------------------------------

def null_marker(col: ColumnOrName, marker: str = NULL_MARKER) -> Column:
    """Exact ``"(null)"`` → NULL (raw-load variant)."""
    return F.nullif(_c(col), F.lit(marker))


def null_marker_lenient(col: ColumnOrName, marker: str = NULL_MARKER) -> Column:
    """Trimmed, case-insensitive ``"(null)"`` → NULL (seed variant)."""
    c = _c(col)
    return F.when(F.lower(F.trim(c.cast("string"))) == F.lit(marker), F.lit(None)).otherwise(c)


def first_present(*cols: ColumnOrName) -> Column:
    """First value that is neither NULL nor the NULL marker."""
    return F.coalesce(*[null_marker_lenient(c) for c in cols])


def first_truthy(*cols: ColumnOrName) -> Column:
    """First value that is neither NULL nor empty (``a or b or c``)."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


# -- casts ---------------------------------------------------------------------

def safe_long(col: ColumnOrName) -> Column:
    """Bad text → NULL. ``'123.0'`` and ``'10000-1'`` are bad text."""
    return _c(col).try_cast("bigint")


def safe_double(col: ColumnOrName) -> Column:
    return _c(col).try_cast("double")


def safe_timestamp(col: ColumnOrName) -> Column:
    return _c(col).try_cast("timestamp")


def to_raw_string(col: ColumnOrName) -> Column:
    """Raw-layer contract: scalars as text, nested values as JSON text."""
    return _c(col).cast("string")


# -- time ----------------------------------------------------------------------

def whole_units_between(unit: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole elapsed units (truncated), ``DAY`` meaning 24 hours, in the session time zone."""
    return F.timestamp_diff(unit, _c(start), _c(end))


def fractional_hours_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Elapsed hours as a double (micro-second precision)."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(3.6e9)


def add_units(unit: str, amount: ColumnOrName, ts: ColumnOrName) -> Column:
    return F.timestamp_add(unit, _c(amount), _c(ts))


# -- ratios ----------------------------------------------------------------------

def safe_divide(num: ColumnOrName, den: ColumnOrName) -> Column:
    """x / 0 → NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def safe_rate(num: ColumnOrName, den: ColumnOrName) -> Column:
    """x / 0 → 0."""
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(_c(num).cast("double") / _c(den).cast("double"))


# -- lookups ---------------------------------------------------------------------

def lookup(col: ColumnOrName, mapping: Mapping[str, object], default: object = None) -> Column:
    """CASE col WHEN k THEN v ... ELSE default (constant-folded by Catalyst)."""
    c = _c(col)
    expr = None
    for key, value in mapping.items():
        expr = F.when(c == F.lit(key), F.lit(value)) if expr is None else expr.when(c == F.lit(key), F.lit(value))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def stage_rank(col: ColumnOrName, order: Iterable[str], unknown: int | None = None) -> Column:
    """Position of a stage in the configured order (1-based); ``unknown`` otherwise."""
    return lookup(col, {name: i + 1 for i, name in enumerate(order)}, unknown)


def in_set(col: ColumnOrName, values: Iterable[str]) -> Column:
    """Three-valued ``col IN (...)``: NULL for a NULL input."""
    return _c(col).isin(list(values))


# -- text ------------------------------------------------------------------------

def sql_concat(*cols: ColumnOrName) -> Column:
    """SQL ``concat``: NULL if any part is NULL."""
    return F.concat(*[_c(c) for c in cols])


def full_name(first: ColumnOrName, last: ColumnOrName, trim: bool = False) -> Column:
    """``concat(coalesce(first,''), ' ', coalesce(last,''))``; pandas mode also trims."""
    name = F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))
    return F.trim(name) if trim else name


def display_fallback(name: ColumnOrName, prefix: str, ident: ColumnOrName) -> Column:
    """Blank or NULL name → ``"<prefix> <id>"``."""
    return F.coalesce(
        F.nullif(F.trim(_c(name).cast("string")), F.lit("")),
        F.concat(F.lit(prefix + " "), _c(ident).cast("string")),
    )


def search_text(*cols: ColumnOrName) -> Column:
    """Lower-cased, space-joined display fields for substring search."""
    return F.lower(F.concat_ws(" ", *[_c(c).cast("string") for c in cols]))


# -- identifiers ---------------------------------------------------------------------

NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: ColumnOrName, namespace_hex: str = NAMESPACE_URL_HEX) -> Column:
    """RFC 4122 version-5 UUID of a text, built from ``sha1`` (no UDF)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(_c(name), "UTF-8")))
    variant_nibble = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant_nibble, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def surrogate_key(*parts: ColumnOrName) -> Column:
    """64-bit surrogate key over ``a|b|c`` (xxhash64; the values differ from FarmHash)."""
    text = F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    return F.xxhash64(text)


def event_id(application_id: ColumnOrName, action: ColumnOrName, last_activity_at: ColumnOrName) -> Column:
    """``application_action_time``; a missing part reads ``None``."""
    return F.concat_ws("_", *[F.coalesce(_c(p).cast("string"), F.lit("None"))
                              for p in (application_id, action, last_activity_at)])


# -- display texts (X20) ------------------------------------------------------------

def format_count(value: ColumnOrName) -> Column:
    """Whole number with blanks between thousands; NULL reads ``0``."""
    return F.coalesce(F.replace(F.format_number(_c(value).cast("bigint"), 0), F.lit(","), F.lit(" ")), F.lit("0"))


def format_decimal(value: ColumnOrName, digits: int = 1) -> Column:
    """Fixed number of decimals, half-even; NULL reads ``0``."""
    c = _c(value).cast("double")
    return F.when(c.isNull(), F.lit("0")).otherwise(F.format_string(f"%.{digits}f", F.bround(c, digits)))


def format_days(value: ColumnOrName) -> Column:
    """``3.5 days``; NULL reads ``N/A``."""
    c = _c(value)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.concat(format_decimal(c), F.lit(" days")))


def format_percentage(value: ColumnOrName) -> Column:
    """A share as ``12.5%``; NULL reads ``N/A``."""
    c = _c(value)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.concat(format_decimal(c * F.lit(100.0)), F.lit("%")))


# -- JSON objects (X19) ---------------------------------------------------------------

def merge_json(base: ColumnOrName, added: ColumnOrName) -> Column:
    """Shallow merge of two JSON objects held as text: the keys of ``added`` win, values keep their types.

    NULL counts as the empty object, as does text that is no object. Keys come out sorted.
    """
    def members(col: ColumnOrName) -> Column:
        value = F.try_parse_json(F.coalesce(_c(col), F.lit("{}")))
        return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"),
                          F.variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))

    old, new = members(base), members(added)
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(old), F.map_keys(new))))
    merged = F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.when(F.map_contains_key(new, k), F.element_at(new, k)).otherwise(F.element_at(old, k))))
    return F.to_json(merged)


def json_field(col: ColumnOrName, name: str) -> Column:
    """Text of a top-level member; NULL where it is missing or the text is no object."""
    return F.get_json_object(_c(col), f"$.{name}")


def clamp(value: int | None, default: int | None, low: int, high: int | None) -> int | None:
    """``least(greatest(coalesce(value, default), low), high)`` on the driver.

    Without a ceiling (``high`` None), a value that is not given and has no default is no limit at all (None).
    """
    given = default if value is None else int(value)
    if given is None:
        return high
    return max(given, low) if high is None else min(max(given, low), high)


def clean_stage_list(col: ColumnOrName) -> Column:
    """Trimmed, non-blank, first-occurrence-ordered distinct stages of an array."""
    trimmed = F.transform(_c(col), lambda x: F.trim(x))
    kept = F.filter(trimmed, lambda x: x.isNotNull() & (x != F.lit("")))
    return F.array_distinct(kept)
