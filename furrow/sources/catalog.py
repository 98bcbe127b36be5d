"""The inventory of a data folder: files, opaque ids, row counts, time spans, separators and previews."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import short_id
from furrow.sources.csv import is_utf8, raw_lines, read_text_columns
from furrow.sources.scratch import staged

# Categories by what a path holds, in order; separators by source.
CATEGORIES = ((r"(?i)\.(jpg|jpeg|png|tiff)$", "image"), (r"(?i)pest", "pest"), (r"(?i)layer", "layer"), (r"(?i)ndvi", "ndvi"), (r"(?i)metos|weather", "weather"), (r"(?i)soil", "soil"))
SEMICOLON_SOURCES = ("EKOS", "Cropman", "Metos")
DATE_NAMES = ("date", "data", "timestamp", "createdat", "week_start")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy - HH:mm", "dd/MM/yyyy")
YEARS = (2000, 2035)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, path, name, size_bytes, modified, category) of all files below root, read by Spark itself without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    category = F.lit("other")
    for pattern, name in reversed(CATEGORIES):
        category = F.when(F.col("path").rlike(pattern), name).otherwise(category)
    return files.select(short_id("path").alias("file_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "modified", category.alias("category"))


def separator(path: str, sample: str | None = None) -> str:
    """By the sample's first line if there is one (the most frequent of comma, semicolon, tab, pipe), else by the source."""
    if sample:
        line = sample.splitlines()[0]
        return max(",;\t|", key=lambda s: (line.count(s), -",;\t|".index(s)))
    return ";" if any(s in path for s in SEMICOLON_SOURCES) else ","


def estimated_rows(size: Column, sample_lines: Column, sample: int) -> Column:
    """Rows of a file by the mean line of its first sample bytes, less the header."""
    mean = F.greatest(F.lit(float(sample)) / F.greatest(sample_lines, F.lit(1)), F.lit(1.0))
    return F.greatest(F.floor(size / mean) - 1, F.lit(0))


def image_dates(files: DataFrame) -> DataFrame:
    """(season_id, date, path) of images named ndvi_raw_<season>_<date>."""
    named = files.where(F.col("name").rlike(r"(?i)^ndvi_raw_.*_\d{4}-\d{2}-\d{2}\.jpe?g$"))
    return named.select(F.regexp_extract("name", r"(?i)^ndvi_raw_(.*)_\d{4}", 1).alias("season_id"), F.try_to_date(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})\.", 1), "yyyy-MM-dd").alias("date"), "path")


def _shape(pattern: str) -> str:
    """A regular expression that every text of a date format matches: its separators with digits between. A failed parse costs an exception, a failed match little."""
    field = lambda m: {"'": "[Tt]", "X": r"\S*", "y": r"[+-]?\d+", ".": r"\."}.get(m[0][0], r"\d+")
    return f"^{re.sub(r"'T'|([A-Za-z])\1*|[.]", field, pattern)}$"


def moment(c: Column, day_first: Column | bool = True) -> Column:
    """A time in any known format or as epoch seconds or milliseconds, within plausible years; else null. Dates with slashes begin with the day, or else the month.

    A text has the shape of one format at most, and only that one is tried.
    """
    text = c.cast("string")
    number = F.when(text.rlike(r"^[\x00-\x20]*\+?[0-9.]"), text.try_cast("double"))
    as_format = lambda f: F.try_to_timestamp(text, F.lit(f))
    day = F.lit(day_first) if isinstance(day_first, bool) else day_first
    parsed = None
    for f in FORMATS:
        value = as_format(f) if "/" not in f else F.when(day, as_format(f)).otherwise(as_format(f.replace("dd/MM", "MM/dd")))
        parsed = (F if parsed is None else parsed).when(text.rlike(_shape(f)), value)
    parsed = parsed.otherwise(F.coalesce(F.when(number.between(9e8, 2.1e9), F.timestamp_seconds(number)), F.when(number.between(9e11, 2.1e12), F.timestamp_seconds(number / 1000))))
    return F.when(F.year(parsed).between(*YEARS), parsed)


def time_span(df: DataFrame, path: str = "") -> tuple[str | None, str | None]:
    """First and last day of a table: of the dates in the path if it has any, else of its columns named like dates."""
    dates = sorted(re.findall(r"\d{4}-\d{2}-\d{2}", path))
    if dates:
        return dates[0], dates[-1]
    columns = [c for c in df.columns if any(n in c.lower().replace(" ", "") for n in DATE_NAMES)]
    if not columns:
        return None, None
    moments = [moment(F.col(f"`{c}`")) for c in columns]
    low, high = df.agg(F.min(F.array_min(F.array(*moments))), F.max(F.array_max(F.array(*moments)))).first()
    return tuple(None if x is None else x.strftime("%Y-%m-%d") for x in (low, high))


#: Bytes of a file's begin from which its rows are estimated, where that is asked for.
SAMPLE = 4 << 20
#: Values of a column that tell whether its dates begin with the day.
DAY_SAMPLES = 20
SEPARATORS = ",;\t|"


def _fields(line: Column, sep: Column) -> Column:
    """The fields of a line; a separator within quotes divides none, and quotes around a field go."""
    quoted = F.split(line, F.concat(F.lit("\\Q"), sep, F.lit("\\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")))
    parts = F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))))
    return F.transform(parts, lambda f: F.regexp_replace(F.trim(f), '^"(.*)"$', "$1"))


def file_catalog(spark: SparkSession, root: str, estimate_above: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """A row per CSV below root: path, size_bytes, encoding, separator, column_names, columns, rows, row_count_method, temporal_min, temporal_max.

    Everything is found in tasks over the files' splits: the encoding by all
    bytes, the rows by line ends (for files above estimate_above, if it is given,
    estimated from the first sample bytes), the times by all rows of columns named like
    dates, or of file names in a column filename, which win. The separator is
    that of the source or, for others, the most frequent in the header. Quoted
    line ends count as rows. Files without a byte are left out, as Spark does.
    """
    lines = staged(raw_lines(spark, root), "lines")
    order = F.struct("block", "at")
    n, size = F.count(F.lit(1)), F.max("size")
    # the last line may lack its end; the reader takes the three bytes of a byte-order mark off
    ends = n - F.when((F.sum(F.octet_length("value") + 1) - size).isin(1, -2), 1).otherwise(0)
    facts = lines.groupBy("path").agg(size.alias("size_bytes"), is_utf8().alias("utf8"), F.greatest(ends - 1, F.lit(0)).alias("exact"), F.min_by("value", order).alias("head"))
    large = lambda size: F.lit(False) if estimate_above is None else F.col(size) > estimate_above
    begin = lines.where(large("size") & (F.col("block") < sample))
    up_to = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("path").orderBy("block", "at"))  # lines of a file's first splits
    sampled = begin.withColumn("end", up_to).where(F.col("end") <= sample).groupBy("path").agg(F.count(F.lit(1)).alias("sample_lines"))
    facts = facts.join(sampled, "path", "left")
    text = lambda c: F.when(F.col("utf8"), F.col(c)).otherwise(F.decode(F.col(c).cast("binary"), "ISO-8859-1"))
    head = F.regexp_replace(F.rtrim(text("head"), F.lit("\r")), "^\ufeff", "")
    known = F.lit(False)
    for word in SEMICOLON_SOURCES:
        known = known | F.contains("path", F.lit(word))
    counts = F.array(*[F.struct((F.length("head") - F.length(F.replace("head", F.lit(s)))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)])
    facts = facts.withColumn("head", head).withColumn("separator", F.when(known, ";").otherwise(F.array_max(counts)["s"]))
    facts = facts.withColumn("column_names", _fields(F.col("head"), F.col("separator")))
    estimated = large("size_bytes")
    facts = staged(facts.select(
        "path", "size_bytes", "utf8", "separator", "column_names", "head", F.when(estimated, estimated_rows(F.col("size_bytes"), F.coalesce("sample_lines", F.lit(0)), sample)).otherwise(F.col("exact")).cast("long").alias("rows"),
        F.when(estimated, "estimado_por_tamanho").otherwise("exato").alias("row_count_method"),
    ), "facts")

    lower = lambda c: F.lower(c)
    dated = lambda c: reduce(lambda a, b: a | b, [F.contains(lower(c), F.lit(d)) for d in DATE_NAMES]) & ~lower(c).isin("width", "height", "count") & ~F.contains(lower(c), F.lit("pixels"))
    wanted = F.filter(F.transform("column_names", lambda c, i: F.struct(c.alias("name"), i.alias("place"))), lambda c: dated(c["name"]) | (c["name"] == "filename"))
    looked = facts.select("path", "utf8", "separator", "head", wanted.alias("wanted")).where(F.size("wanted") > 0)
    values = lines.join(looked, "path").withColumn("fields", _fields(F.rtrim("value", F.lit("\r")), F.col("separator")))
    values = values.select("path", "block", "at", "fields", F.explode("wanted").alias("w")).select("path", "block", "at", F.col("w.name").alias("name"), F.nullif(F.get("fields", F.col("w.place")), F.lit("")).alias("v")).where("v is not null and v <> name")
    first = values.withColumn("n", F.row_number().over(Window.partitionBy("path", "name").orderBy("block", "at"))).where(F.col("n") <= DAY_SAMPLES)
    days = first.groupBy("path", "name").agg(F.bool_or(F.col("v").rlike(r"\d{1,2}/\d{1,2}/\d{4}")).alias("day_first"))
    seconds = F.timestamp_seconds(F.col("v").try_cast("double"))
    at = (
        F.when(F.col("name") == "filename", F.try_to_timestamp(F.regexp_extract("v", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))
        .when(lower("name") == "timestamp", F.when(F.year(seconds).between(*YEARS), seconds)).otherwise(moment(F.col("v"), F.col("day_first")))
    )
    spans = values.join(days, ["path", "name"]).withColumn("t", at).groupBy("path").agg(*[f(F.when((F.col("name") == "filename") == by_name, F.col("t"))).alias(f"{k}_{by_name}") for by_name in (True, False) for k, f in (("low", F.min), ("high", F.max))])
    named = F.col("low_True").isNotNull()
    spans = spans.select("path", *[F.when(named, F.col(f"{k}_True")).otherwise(F.col(f"{k}_False")).alias(n) for k, n in (("low", "temporal_min"), ("high", "temporal_max"))])
    return facts.join(spans, "path", "left").select(
        "path", "size_bytes", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), "separator", "column_names", F.size("column_names").alias("columns"), "rows", "row_count_method", "temporal_min", "temporal_max"
    )


def preview(spark: SparkSession, path: str, rows: int = 50) -> DataFrame:
    """The first rows of a CSV as text: a report's limit, not a filter of data."""
    return read_text_columns(spark, path, separator(path)).limit(rows)
