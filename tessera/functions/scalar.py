"""Column expressions shared by every operator; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: mean Earth radius in kilometres used by every distance in the evidence tables.
EARTH_RADIUS_KM = 6371.0088
# Fixed value: identifier rule shared by all records.
IDENTIFIER_PATTERN = "^[a-z0-9]+(?:[._-][a-z0-9]+)*$"
# Fixed value: digest rule shared by all records.
DIGEST_PATTERN = "^sha256:[0-9a-f]{64}$"
# Fixed value: label that stands for an absent dimension.
MISSING = "(missing)"


def portable(value: Column, digits: int = 12) -> Column:
    """Round to significant digits so that sums taken in any order rank and hash alike."""
    if not 10 <= digits <= 17:
        raise ValueError("digits must lie in 10..17")
    # try_cast, because null formats as text; adding 0.0 turns a negative zero into zero
    return F.format_string(f"%.{digits - 1}e", value.cast("double")).try_cast("double") + F.lit(0.0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where an expression names it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Powers of ten that a double holds exactly.
_EXACT_POWER = 22
_TENS = [10.0 ** n for n in range(_EXACT_POWER + 1)]
# Veltkamp's constant: cuts a double into two halves whose products are exact.
_SPLIT = float(2 ** 27 + 1)


def _ten(power: Column) -> Column:
    return F.get(F.lit(_TENS), power.cast("int"))


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """What rounding took from ``a * b``, exactly (Dekker)."""
    def halves(v: Column) -> tuple[Column, Column]:
        high = v * _SPLIT - (v * _SPLIT - v)
        return high, v - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return al * bl - (((product - ah * bh) - al * bh) - ah * bl)


def _rounded(x: Column, shift: Column) -> Column:
    """``x`` rounded to ``shift`` decimal places (tens and more if negative), -22 to 22, by its exact binary value."""
    up = shift >= 0

    def at(ten: Column) -> Column:
        def near(scaled: Column) -> Column:
            def settled(whole: Column) -> Column:
                rest = scaled - whole
                # a half may be owed to the rounding of the scaling itself, whose sign says on which side the number lies
                owed = F.when(up, _product_error(x, ten, scaled)).otherwise(
                    (x - scaled * ten) - _product_error(scaled, ten, scaled * ten)
                )
                beyond = F.when(F.abs(rest) == 0.5, F.when(F.signum(owed) == F.signum(rest), F.signum(rest))).otherwise(F.lit(0.0))
                units = whole + F.coalesce(beyond, F.lit(0.0))
                return F.when(up, units / ten).otherwise(units * ten)
            return let(F.rint(scaled), settled)
        return let(F.when(up, x * ten).otherwise(x / ten), near)
    return let(_ten(F.abs(shift)), at)


def significant(value: Column, digits: int = 12) -> Column:
    """Round the exact binary value to significant digits as C and Python do, exact ties to the even digit.

    :func:`portable` rounds the shortest decimal text instead, ties up, and so takes another digit where that text ends
    in a five that the number does not reach. Outside ``1e-7 .. 1e22`` the two are one.
    """
    if not 10 <= digits <= 15:
        raise ValueError("digits must lie in 10..15")

    def rounded(x: Column) -> Column:
        size = F.abs(x)

        def shift(power: Column) -> Column:
            below = F.coalesce(size < F.when(power >= 0, _ten(power)), F.lit(False))
            return F.lit(digits - 1) - power + below.cast("int")

        plain = (size >= 1e-7) & (size < 1e22)
        places = let(F.floor(F.log10(size)).cast("int"), shift)
        near = let(places, lambda n: _rounded(x, n) + F.lit(0.0))
        return F.when(x == 0, F.lit(0.0)).when(plain, near).otherwise(portable(x, digits))

    return let(value.cast("double"), rounded)


def round_away(value: Column, places: int) -> Column:
    """Round to decimal places as C does on the scaled number, halves away from zero; a negative zero keeps its sign.

    The built-in ``round`` works on the shortest decimal text, where 1.005 is a half, and has no negative zero.
    """
    unit = 10.0 ** places

    def rounded(scaled: Column) -> Column:
        size = F.abs(scaled)
        whole = (F.rint(size) + (size - F.rint(size) == 0.5).cast("double")) / unit
        return F.when(scaled.cast("string").startswith("-"), -whole).otherwise(whole)

    return let(value.cast("double") * unit, rounded)


def norm_dim(value: Column) -> Column:
    """Trim a label; absent or blank labels become the missing marker."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(MISSING))


def norm_code(value: Column, pattern: str | None = None, allowed: list[str] | None = None) -> Column:
    """Upper-case a code; codes outside the pattern or the closed list become null."""
    code = F.upper(F.trim(value))
    if pattern is not None:
        code = F.when(code.rlike(pattern), code)
    if allowed is not None:
        code = F.when(code.isin(allowed), code)
    return code


def search_key(value: Column) -> Column:
    """Lower-case text whose non-alphanumeric runs are one space."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def collapse_space(value: Column) -> Column:
    """Lower-case text with whitespace runs collapsed, the key of exact duplicates."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def between_half_open(value: Column, start, end) -> Column:
    """``start <= value < end``; kept on the raw column so that it reaches the scan."""
    return (value >= F.lit(start)) & (value < F.lit(end))


def window_error(start: Column, end: Column, maximum_days: int) -> Column:
    """Reason why a request window is invalid, or null."""
    days = F.datediff(end, start)
    return (
        F.when(start >= end, "window start must precede end")
        .when(days > maximum_days, F.lit(f"window exceeds {maximum_days} days"))
    )


def bbox(latitude: Column, longitude: Column, padding: float = 0.05) -> Column:
    """Point buffered to a box and clamped to the globe."""
    return F.struct(
        F.greatest(F.lit(-180.0), longitude - padding).alias("west"),
        F.greatest(F.lit(-90.0), latitude - padding).alias("south"),
        F.least(F.lit(180.0), longitude + padding).alias("east"),
        F.least(F.lit(90.0), latitude + padding).alias("north"),
    )


def centroid(box: Column) -> Column:
    return F.struct(
        ((box["south"] + box["north"]) / 2).alias("latitude"),
        ((box["west"] + box["east"]) / 2).alias("longitude"),
    )


def bbox_error(box: Column, latitude: Column | None = None, longitude: Column | None = None) -> Column:
    """Reason why a box is invalid, or null; a centre, when given, must lie inside."""
    reason = F.when(box["west"] >= box["east"], "west must be below east").when(
        box["south"] >= box["north"], "south must be below north"
    )
    if latitude is not None and longitude is not None:
        inside = latitude.between(box["south"], box["north"]) & longitude.between(
            box["west"], box["east"]
        )
        reason = reason.when(~inside, "centre lies outside the box")
    return reason


def clamp(value: Column, floor: Column, ceiling: Column) -> Column:
    """Clamp between optional bounds; non-finite input becomes null (a failed row)."""
    bounded = F.when(floor.isNotNull(), F.greatest(value, floor)).otherwise(value)
    bounded = F.when(ceiling.isNotNull(), F.least(bounded, ceiling)).otherwise(bounded)
    return F.when(is_finite(value), bounded)


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return (
        number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    )


def fmt_metric(value: Column) -> Column:
    """Six decimals without trailing zeros; null reads ``missing``."""
    text = F.format_string("%.6f", value.cast("double"))
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("missing"))


def local_midnight(day: Column, zone: Column) -> Column:
    """Instant of local midnight in an IANA zone (session zone UTC)."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def local_day_end(day: Column, zone: Column) -> Column:
    """Last microsecond of a local day, the data cut-off of a city."""
    end = F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    return F.to_utc_timestamp(end, zone)


def aware_timestamp(text: Column) -> Column:
    """Parse ISO text with an explicit offset; naive text becomes null."""
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, F.try_to_timestamp(text))


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(half_lon), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def demand_columns(population: Column, rate: Column) -> Column:
    """Estimated need behind a prevalence rate given in percent."""
    return F.round(population * rate / 100, 6)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; Spark has no normal CDF. Runs on result rows only."""
    from math import erf, sqrt

    # erf and not erfc, and 1 - cdf, to mirror the released definition of the p-value
    return z.map(lambda v: None if pd.isna(v) else 2 * (1 - 0.5 * (1 + erf(abs(v) / sqrt(2)))))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds (null conditions count as not holding)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))


def missing_members(required: Column, have: Column) -> Column:
    return F.array_except(required, have)


def covers(required: Column, have: Column) -> Column:
    """Whether every required member is present."""
    return F.size(F.array_except(required, have)) == 0


def ordered_distinct(values: Column) -> Column:
    """Distinct members in first-seen order."""
    return F.array_distinct(values)


def valid_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER_PATTERN), F.lit(False))


def valid_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST_PATTERN), F.lit(False))
