"""Column functions: parsing, text keys, dates, guarded arithmetic, arrays. All native, none a UDF.

Nulls stay null unless a function says otherwise; NaN is never produced.
"""

from __future__ import annotations

import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of missing numbers, the plain number grammar, machine-state words.
MISSING = ("", "-", "nan", "None")
PLAIN_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
STATE_WORDS = (("operation", ("oper", "trabalh")), ("maneuver", ("manobra",)), ("transit", ("desloc", "transit")), ("supply", ("abastec",)), ("stop", ("parad",)))


def _unaccented() -> tuple[str, str]:
    """Small letters of the Latin, Greek and Cyrillic blocks that decompose into one letter and marks, and those letters."""
    pairs = []
    for i in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        low = chr(i).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        if len(low) == len(base) == 1 and base != low:
            pairs.append((low, base))
    return "".join(a for a, _ in dict(pairs).items()), "".join(b for _, b in dict(pairs).items())


ACCENTED, UNACCENTED = _unaccented()


def parse_number(c: Column | str) -> Column:
    """A double of a plain number, or of one with a decimal comma and dots between thousands; else null."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    swapped = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(text.isin(*MISSING), None)
        .when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
        .when(F.contains(text, F.lit(",")) & swapped.rlike(PLAIN_NUMBER), swapped.try_cast("double"))
    )


def text_key(c: Column | str) -> Column:
    """Lower case, no accents (of letters, or as marks of their own), single spaces; null becomes the empty string."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.trim(text)), ACCENTED, UNACCENTED), r"\p{M}+", ""), r"\s+", " ")


def machine_state(c: Column | str) -> Column:
    """The first state in order of which a word is part of the text; other for null or unknown texts."""
    text, out = text_key(c), None
    for state, found in STATE_WORDS:
        hit = F.lit(False)
        for word in found:
            hit = hit | F.contains(text, F.lit(word))
        out = F.when(hit, state) if out is None else out.when(hit, state)
    return out.otherwise("other")


def filename_date(c: Column | str) -> Column:
    # a cast: no match is an empty text, which a format would turn down by an exception
    return F.regexp_extract(c, r"_(\d{4}-\d{2}-\d{2})\.(tiff|jpg)$", 1).try_cast("date")


def image_name(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(".tiff"), F.lit(".jpg"))


def strip_zone(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\s*/ GMT.*$", "")


def week_start(c: Column | str) -> Column:
    """Midnight of the Monday of the week."""
    return F.date_trunc("week", c)


def fixed(c: Column | str, digits: int, signed: bool = False) -> Column:
    """A number as printf and Python write it with so many digits, halves to even by its exact value; signed ones have a plus too.

    format_string rounds halves up; format_number rounds rightly what is not below one unit of the last digit.
    """
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    unit, half = float(f"1e-{digits}"), float(f"5e-{digits + 1}")
    up = F.abs(value) >= half if Decimal(half) > Decimal(f"5e-{digits + 1}") else F.abs(value) > half
    value = F.when(F.abs(value) < unit, F.signum(value) * F.when(up, unit).otherwise(0.0)).otherwise(value)
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(f"+{pattern};-{pattern}" if signed else pattern))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clip01(c: Column) -> Column:
    """Within 0 and 1; a missing value counts as 1."""
    return F.when(c.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def flag(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def truthy(c: Column | str) -> Column:
    return flag(F.lower((F.col(c) if isinstance(c, str) else c).cast("string")).isin("true", "1", "sim"))


def distinct_joined(c: Column | str) -> Column:
    """Aggregate: the distinct non-blank values, sorted, joined by a comma."""
    text = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(text) != "", text))), ", ")


def exact_mean(c: Column | str) -> Column:
    """Aggregate: the mean of doubles that are decimals of up to 10 digits before and 18 after the point, by an exact sum, whatever the order of rows; of others the plain mean."""
    value = F.col(c) if isinstance(c, str) else c
    decimal = value.try_cast("decimal(28,18)")
    exact = F.bool_and(value.isNull() | F.coalesce(decimal.cast("double") == value, F.lit(False)))
    return F.when(exact, F.avg(decimal).cast("double")).otherwise(F.avg(value))


def short_id(*parts: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, length)


def column_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_-]", ""))


def redact_paths(c: Column | str) -> Column:
    """Home folders and drive letters of paths hidden."""
    return F.regexp_replace(F.regexp_replace(c, r"(/home/|/Users/)[^/\s]+", "$1<user>"), r"[A-Za-z]:\\\\[^\s]*", "<path>")


def pipe_list(c: Column | str) -> Column:
    """The distinct items of a pipe-separated text in their first order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def token_list(c: Column | str) -> Column:
    """The items of a text divided by plus, comma, semicolon or slash, without blanks."""
    return F.filter(F.transform(F.split(c, "[+,;/]"), lambda x: F.trim(x)), lambda x: x != "")


def detections(c: Column | str) -> Column:
    """Names in a detection payload: a JSON array of records, or of JSON texts that hold such arrays; bad JSON gives none.

    Records win over nested texts; of nested texts the first with a record counts.
    """
    text = F.col(c) if isinstance(c, str) else c
    record = "array<struct<name:string,confidence:double>>"
    direct = F.filter(F.coalesce(F.from_json(text, record), F.array().cast(record)), lambda r: r.isNotNull() & (r["name"].isNotNull() | r["confidence"].isNotNull()))
    nested = F.transform(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")), lambda s: F.filter(F.coalesce(F.from_json(s, record), F.array().cast(record)), lambda r: r.isNotNull()))
    first = F.get(F.filter(nested, lambda x: F.size(x) > 0), F.lit(0))
    return F.when(F.size(direct) > 0, direct).otherwise(F.coalesce(first, F.array().cast(record)))


def top_labels(candidates: list[tuple[Column, float, str]], k: int = 3) -> Column:
    """Labels of the k heaviest candidates (condition, weight, label) that hold, ties by label."""
    held = [F.when(flag(c), F.struct(F.lit(-w).alias("w"), F.lit(label).alias("label"))) for c, w, label in candidates]
    return F.transform(F.slice(F.array_sort(F.filter(F.array(*held), lambda e: e.isNotNull())), 1, k), lambda e: e["label"])
