"""Canonical texts of nested columns, as columns: JSON with sorted keys and numbers in their shortest form, and %g.

The texts equal what Python's json.dumps(value, sort_keys=True) writes, so identities made elsewhere can be compared. Four forms
differ in their separators and in whether characters beyond ASCII are escaped; a digest of one form never equals that of another.

Defined results: a null is null (in JSON text); a null column gives the text null; a missing and a null field differ, as a struct always has its
fields; maps need string keys; NaN and infinities are written NaN, Infinity and -Infinity; dates and timestamps are their ISO text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType, TimestampNTZType, TimestampType

#: Control characters that JSON writes by a letter.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _decimal(value: Column, precision: int) -> Column:
    """A finite number as digits without trailing zeros and the exponent of the first one."""
    text = F.format_string(f"%.{precision - 1}e", F.abs(value))
    digits = F.regexp_replace(F.translate(F.substring_index(text, "e", 1), ".", ""), "(?<=.)0+$", "")
    return F.struct(digits.alias("d"), F.substring_index(text, "e", -1).cast("int").alias("e"))


def _written(value: Column, number: Column, fixed_below: int, fraction: str) -> Column:
    """Digits in fixed notation for exponents from -4 to below a bound, else with an exponent of two digits at least."""
    d, e = number["d"], number["e"]
    size = F.length(d)
    plain = (
        F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
        .when(e >= size - 1, F.concat(d, F.repeat(F.lit("0"), e - size + 1), F.lit(fraction)))
        .otherwise(F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, size)))
    )
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substring(d, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), size))).otherwise(""), power)
    sign = F.when((value < 0) | (F.lit(1.0) / F.nullif(value, F.lit(0.0)) < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return F.concat(sign, F.when((e >= -4) & (e < fixed_below), plain).otherwise(scientific))


def shortest(value: Column) -> Column:
    """A double in the fewest digits that read back as the same number (15 to 17 are tried), as Python writes it."""
    value = value.cast("double")
    reads = lambda n: F.format_string(f"%.{n - 1}e", value).cast("double") == value
    number = F.when(reads(15), _decimal(value, 15)).when(reads(16), _decimal(value, 16)).otherwise(_decimal(value, 17))
    odd = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity")
    return F.when(value.isNull(), None).otherwise(F.coalesce(odd, _bound(number, lambda x: _written(value, x, 16, ".0"))))


def general(value: Column, precision: int = 12) -> Column:
    """A finite double as C's %.<precision>g writes it."""
    value = value.cast("double")
    return F.when(value.isNotNull(), _bound(_decimal(value, precision), lambda x: _written(value, x, precision, "")))


def quoted(text: Column, ascii_only: bool = False) -> Column:
    """A JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(short))
    odd = "[\\x00-\\x1f]" + ("|[^\\x00-\\x7e]" if ascii_only else "")
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    spelled = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(odd), units(c)).otherwise(c)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(odd), spelled).otherwise(out), F.lit('"'))


def json_text(value: Column, kind: DataType, compact: bool = False, ascii_only: bool = False) -> Column:
    """The canonical JSON of a column of a type: keys sorted by code point, with or without blanks behind separators."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    inner = lambda v, t: json_text(v, t, compact, ascii_only)
    key = lambda k: quoted(k, ascii_only)
    if isinstance(kind, StructType):
        parts = [F.concat(key(F.lit(f.name)), F.lit(colon), inner(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: inner(x, kind.elementType)), comma), F.lit("]"))
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(key(k), F.lit(colon), inner(value[k], kind.valueType))), comma), F.lit("}"))
    elif isinstance(kind, (DoubleType, FloatType)):
        text = shortest(value)
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        text = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'))
    elif isinstance(kind, (StringType, DateType)):
        text = quoted(value.cast("string"), ascii_only)
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def identity(value: Column, kind: DataType, form: str) -> Column:
    """The digest of a form: spaced or compact or escaped (SHA-256), expression (SHA-1)."""
    compact, ascii_only = {"spaced": (False, False), "compact": (True, False), "escaped": (True, True), "expression": (False, True)}[form]
    text = json_text(value, kind, compact, ascii_only)
    return F.sha1(text) if form == "expression" else F.sha2(text, 256)
