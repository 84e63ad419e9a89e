"""Scalar text functions as column expressions; pandas functions only where Spark has none."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Combining marks that continue a token instead of separating two.
TOKEN_MARKS = r"\x{0300}-\x{0304}\x{0306}-\x{030C}\x{030F}\x{0311}\x{031B}\x{0323}-\x{0328}\x{032D}\x{032E}\x{0330}\x{0331}"
TOKEN = rf"[\p{{L}}\p{{N}}\p{{Co}}{TOKEN_MARKS}]+"
#: White space in the wide sense: Unicode spaces and the separators U+001C to U+001F.
WIDE_SPACE = r"[\x09-\x0D\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Simple case folding where lower-casing differs.
FOLD_FROM, FOLD_TO = "ςſµϐϑϕϖϰϱϵ", "σsμβθφπκρε"


def folded(text: Column) -> Column:
    """Simple case folding: lower case, then the letters that folding treats otherwise."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Search tokens: folded runs of letters, digits, private-use characters and some marks."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; ASCII is returned as it is."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def collapsed(text: Column) -> Column:
    """Runs of wide white space become one space, and none is left at the ends."""
    return F.trim(F.regexp_replace(text, WIDE_SPACE, " "))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def clean_title(text: Column) -> Column:
    """Collapsed white space, without a colon at the end."""
    return F.regexp_replace(collapsed(text), r"\s*:$", "")


def entity_names(text: Column) -> Column:
    """Names of the general entities that a text refers to, in order."""
    return F.regexp_extract_all(text, F.lit(r"&([A-Za-z][A-Za-z0-9._:-]*);"), 1)


def identifier_sort_key(identifier: Column) -> Column:
    """Parts between dots: numbers by value and before words."""
    part = lambda p: F.struct(
        F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("number"), p.alias("word")
    )
    return F.transform(F.split(identifier, r"\."), part)


def first_value(values: Column, default: Column) -> Column:
    """The first non-blank element, else a default."""
    return F.coalesce(F.get(F.filter(values, lambda v: F.length(F.trim(v)) > 0), F.lit(0)), default)


def mapped(table: Column, key: Column) -> Column:
    """A map's value for the key, else the key itself."""
    return F.coalesce(F.try_element_at(table, key), key)


def breadcrumb(parts: Column) -> Column:
    return F.array_join(parts, " › ")


# Units of byte sizes.
UNITS = {"": 1, "k": 1024, "m": 1024**2, "g": 1024**3}


def byte_size(literal: Column) -> Column:
    """500K, 100m, 2G or a positive number of bytes; null for anything else."""
    pattern = r"^([1-9][0-9]{0,17})([KkMmGg]?)$"
    number, unit = F.regexp_extract(literal, pattern, 1), F.lower(F.regexp_extract(literal, pattern, 2))
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in UNITS.items()])
    return F.when(number != "", F.try_multiply(number.try_cast("long"), factor))


def byte_text(size: Column) -> Column:
    """B to TiB with one decimal, in the first unit that leaves less than 1,024."""
    out, scaled = None, size.cast("double")
    names = ["B", "KiB", "MiB", "GiB", "TiB"]
    for k, name in enumerate(names):
        value = scaled / F.lit(float(1024**k))
        shown = F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(" " + name))
        fits = (scaled < F.lit(float(1024 ** (k + 1)))) | F.lit(k == len(names) - 1)
        out = F.when(fits, shown) if out is None else out.when(fits, shown)
    return F.when(size.isNotNull(), out)


def unsafe_to_token(value: Column) -> Column:
    """Route token: bytes other than letters, digits and - . _ ' as ~hh."""
    data = F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.lower(F.hex(F.substr(F.encode(value, "UTF-8"), i, F.lit(1)))))
    char = lambda h: F.decode(F.unhex(h), "UTF-8")
    one = lambda h: F.when((F.conv(h, 16, 10).cast("int") < 128) & char(F.when(F.conv(h, 16, 10).cast("int") < 128, h).otherwise("7e")).rlike("^[A-Za-z0-9._'-]$"), char(h)).otherwise(F.concat(F.lit("~"), h))
    return F.when(F.octet_length(value) == 0, F.lit("")).otherwise(F.array_join(F.transform(data, one), ""))


def percent_encoded(value: Column, safe: str = "-._~") -> Column:
    """Percent-encoding of all bytes but letters, digits and ``safe``."""
    allowed = "[A-Za-z0-9" + "".join("\\" + c for c in safe) + "]"
    data = F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.hex(F.substr(F.encode(value, "UTF-8"), i, F.lit(1))))
    low = lambda h: F.conv(h, 16, 10).cast("int") < 128
    char = lambda h: F.decode(F.unhex(F.when(low(h), h).otherwise("25")), "UTF-8")
    one = lambda h: F.when(low(h) & char(h).rlike(f"^{allowed}$"), char(h)).otherwise(F.concat(F.lit("%"), h))
    return F.when(F.octet_length(value) == 0, F.lit("")).otherwise(F.array_join(F.transform(data, one), ""))


def access_id(collection: Column, kind: Column, value: Column | None = None) -> Column:
    """tp:collection/kind, and a third part if there is a value; null for an unusable kind."""
    tail = F.lit("") if value is None else F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit("/"), percent_encoded(value)))
    return F.when(kind.rlike("^[a-z][a-z0-9_-]*$"), F.concat(F.lit("tp:"), percent_encoded(collection), F.lit("/"), kind, tail))
