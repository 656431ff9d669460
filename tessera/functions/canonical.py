"""Canonical JSON of nested columns, so that equal documents have equal text and equal hashes.

The expression is built by walking a column's type, and all of it stays in the JVM. At every depth keys are sorted,
absent fields of structs are left out, and floating-point numbers are rounded to significant digits, so neither the
order of fields nor the order in which a sum was taken changes the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import digest
from tessera.functions.scalar import let, significant

DIGITS = 12
# Control characters of JSON text that have a short escape.
SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
#: A JSON text falls into strings, numbers and what is between them.
TOKENS = r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+)'


def _quoted(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escapes = F.array(*[
        F.struct(F.lit(chr(code)).alias("raw"), F.lit(SHORT_ESCAPES.get(code, f"\\u{code:04x}")).alias("escaped")) for code in range(32)
    ])
    rare = F.aggregate(escapes, plain, lambda acc, e: F.replace(acc, e["raw"], e["escaped"]))
    return F.concat(F.lit('"'), F.when(plain.rlike("[\\x00-\\x1f]"), rare).otherwise(plain), F.lit('"'))


def float_text(value: Column, digits: int = DIGITS) -> Column:
    """Shortest decimal text of a number rounded to significant digits: plain from 1e-4 to below 1e16, else with an exponent.

    A negative zero is zero; NaN and infinities, which JSON lacks, are null. Below 2.3e-308 numbers carry fewer digits, and
    the text is the rounded one, which need not be the shortest.
    """
    if not 10 <= digits <= 15:
        raise ValueError("digits must lie in 10..15")
    return let(significant(value, digits), lambda rounded: _decimal_text(rounded, digits))


def _decimal_text(rounded: Column, digits: int) -> Column:
    """Text of a rounded number. Each part is bound once: within an array, an expression is evaluated wherever it is named."""
    def spelled(parts: Column) -> Column:
        figures = F.rtrim(F.replace(parts[0], F.lit("."), F.lit("")), F.lit("0"))
        return let(F.struct(figures.alias("figures"), parts[1].try_cast("int").alias("power")), laid_out)

    def laid_out(number: Column) -> Column:
        figures, power = number["figures"], number["power"]
        known = F.length(figures)
        whole = F.concat(F.substring(F.rpad(figures, F.greatest(known, power + 1), F.lit("0")), F.lit(1), power + 1), F.lit("."))
        large = F.concat(whole, F.when(known > power + 1, F.substring(figures, power + 2, known)).otherwise(F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
        mantissa = F.when(known > 1, F.concat(F.substring(figures, 1, 1), F.lit("."), F.substring(figures, F.lit(2), known))).otherwise(figures)
        sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
        pad = F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit(""))
        scientific = F.concat(mantissa, F.lit("e"), sign, pad, F.abs(power).cast("string"))
        return F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(scientific)

    unsigned = let(F.split(F.format_string(f"%.{digits - 1}e", F.abs(rounded)), "e"), spelled)
    signed = F.when(rounded == 0, F.lit("0.0")).otherwise(F.concat(F.when(rounded < 0, F.lit("-")).otherwise(F.lit("")), unsigned))
    finite = rounded.isNotNull() & ~F.isnan(rounded) & (F.abs(rounded) < F.lit(float("inf")))
    return F.when(finite, signed)


def _variant_text(value: Column, digits: int) -> Column:
    # objects of a variant are stored with sorted keys; only numbers with a fraction or an exponent need rounding
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(TOKENS), F.lit(1))
    fraction = lambda t: t.rlike(r"^-?[0-9]+[0-9eE+-]*[.eE]")
    return F.array_join(F.transform(tokens, lambda t: F.when(fraction(t), float_text(t.try_cast("double"), digits)).otherwise(t)), "")


def _instant_text(value: Column) -> Column:
    parts = F.split(value.cast("string"), r"\.")
    fraction = F.try_element_at(parts, F.lit(2))
    seconds = F.replace(parts[0], F.lit(" "), F.lit("T"))
    return F.when(fraction.isNull(), seconds).otherwise(F.concat(seconds, F.lit("."), F.rpad(fraction, 6, "0")))


def _text(value: Column, kind: T.DataType, digits: int) -> Column:
    """JSON text of ``value``, null where the value is null."""
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        if len(set(names)) != len(names):
            raise ValueError("field names repeat")
        fields = [
            F.concat(F.lit(f"{_key(f.name)}:"), _text(value.getField(f.name), f.dataType, digits))
            for f in sorted(kind.fields, key=lambda f: f.name)
        ]
        inner = F.concat_ws(",", *fields) if fields else F.lit("")
        return F.when(value.isNotNull(), F.concat(F.lit("{"), inner, F.lit("}")))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(_text(x, kind.elementType, digits), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError("only maps with text as keys are JSON objects")
        items = F.transform(
            F.array_sort(F.map_keys(value)),
            lambda k: F.concat(_quoted(k), F.lit(":"), F.coalesce(_text(F.element_at(value, k), kind.valueType, digits), F.lit("null"))),
        )
        return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))
    if isinstance(kind, T.VariantType):
        return _variant_text(value, digits)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(value.cast("double"), digits)
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return value.cast("string")
    if isinstance(kind, T.DecimalType):
        text = value.cast("string")
        return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text) if kind.scale else text
    if isinstance(kind, T.TimestampNTZType):
        return _quoted(_instant_text(value))
    if isinstance(kind, T.TimestampType):
        return _quoted(F.concat(_instant_text(value), F.lit("Z")))
    if isinstance(kind, T.BinaryType):
        return _quoted(F.base64(value))
    if isinstance(kind, (T.StringType, T.DateType)):
        return _quoted(value.cast("string"))
    raise ValueError(f"no canonical JSON for {kind.simpleString()}")


def _key(name: str) -> str:
    out = name.replace("\\", "\\\\").replace('"', '\\"')
    return '"' + "".join(SHORT_ESCAPES.get(ord(c), f"\\u{ord(c):04x}") if ord(c) < 32 else c for c in out) + '"'


def canonical_json(df: DataFrame, names: Sequence[str] | None = None, digits: int = DIGITS) -> Column:
    """JSON object of the named columns of ``df`` (all without names), for use in a select over ``df``.

    Null columns and null fields of structs are left out at every depth; nulls in arrays and maps are written. Dates and
    instants are ISO text, instants in the session's time zone, which must be UTC. Binary is base64. A NaN counts as absent.
    Numbers of a variant that have neither fraction nor exponent are integers.
    """
    chosen = list(df.columns) if names is None else list(names)
    if len(set(chosen)) != len(chosen):
        raise ValueError("column names repeat")
    fields = [F.concat(F.lit(f"{_key(c)}:"), _text(df[f"`{c}`"], df.schema[c].dataType, digits)) for c in sorted(chosen)]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields) if fields else F.lit(""), F.lit("}"))


def document_hash(df: DataFrame, names: Sequence[str] | None = None, digits: int = DIGITS) -> Column:
    """Hash of the canonical JSON: equal under any order of fields at any depth and under resummation."""
    return digest(canonical_json(df, names, digits))
