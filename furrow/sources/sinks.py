"""Where results go: Parquet or CSV folders by table name, a catalog of saved tables, a build-or-load cache."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.operators.lineage import MB
from furrow.sources.scratch import file_system

# The tables of each stage of a season's analysis.
BASE_TABLES = ("area_inventory", "ndvi_clean", "weather_daily", "weather_weekly", "ops_area_daily", "miip_daily", "pairwise_weekly_features", "hypothesis_matrix")
TIMELINE_TABLES = ("ndvi_phase_timeline", "ndvi_events", "ndvi_pair_diagnostics", "ndvi_outlook", "ops_support_daily", "ops_support_weekly")
MODEL_TABLES = ("data_audit", "pair_effect_tests", "event_driver_lift", "transition_model_frame", "transition_model_summary", "transition_model_coefficients", "transition_model_predictions", "final_hypothesis_register", "decision_summary")
REVIEW_TABLES = ("dataset_overview", "numeric_profiles", "ndvi_stats_by_area", "ndvi_outliers", "pair_weekly_gaps", "pair_classic_tests", "ndvi_trend_tests", "weekly_correlations")
ALL_TABLES = (*BASE_TABLES, *TIMELINE_TABLES, *MODEL_TABLES, *REVIEW_TABLES)
# The tables of a lineage manifest.
MANIFEST_TABLES = ("lineage_manifest", "lineage_coverage", "lineage_critical_targets", "lineage_acceptance_gates", "lineage_summary")
#: A version of a set of tables is published by this file, which is made last.
MARK = "PUBLISHED.json"


def flat(df: DataFrame) -> DataFrame:
    """df with arrays and structs as JSON text, and columns without a type as text, for sinks of plain columns."""
    plain = lambda c, kind: F.to_json(f"`{c}`").alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`")
    return df.select(*[plain(c, kind) for c, kind in df.dtypes])


def save_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, df in tables.items():
        out = flat(df).write.mode("overwrite")
        out.parquet(f"{folder}/{name}") if kind == "parquet" else out.csv(f"{folder}/{name}", header=True)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, kind: str = "parquet", facts: dict | None = None, keep: int = 2, beside: Callable[[str], None] | None = None) -> str:
    """All tables as one new version below folder, and its path. Readers see the version before until all of it is there.

    Each version is a folder of its own; its last file, MARK, holds the manifest
    (tables with rows and columns, the time, facts) and publishes it. A run that
    fails leaves what was published as it was, and its own unpublished folder is
    deleted. beside(path) may write more into the version. The last keep versions stay.
    """
    now = dt.datetime.now(dt.UTC)
    version = f"{folder}/{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    files, at = file_system(spark, version)
    files.mkdirs(at)
    try:
        rows = {}
        for name, df in tables.items():
            observed = flat(df)
            save_tables({name: df}, version, kind)
            rows[name] = {"rows": load_tables(spark, version, [name], kind)[name].count(), "columns": [list(c) for c in observed.dtypes]}
        if beside:
            beside(version)
        manifest = {"published_at": now.isoformat(), "format": kind, "tables": rows, **(facts or {})}
        stream = files.create(file_system(spark, f"{version}/{MARK}")[1], False)
        try:
            stream.write(bytearray(json.dumps(manifest, ensure_ascii=False, indent=1).encode()))
        finally:
            stream.close()
    except BaseException:
        files.delete(at, True)
        raise
    for old in versions(spark, folder)[:-keep]:
        files.delete(file_system(spark, old)[1], True)
    return version


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the published versions below folder, oldest first."""
    files, at = file_system(spark, folder)
    if not files.exists(at):
        return []
    there = sorted(str(s.getPath().getName()) for s in files.listStatus(at) if s.isDirectory())
    return [f"{folder}/{v}" for v in there if files.exists(file_system(spark, f"{folder}/{v}/{MARK}")[1])]


def manifest(spark: SparkSession, version: str) -> dict:
    """What a published version says of itself."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{version}/{MARK}", wholetext=True).collect()))


def published(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the last published version, with the types that they were published with; an error without one."""
    last = versions(spark, folder)
    if not last:
        raise FileNotFoundError(f"nothing published in {folder}")
    facts = manifest(spark, last[-1])
    wanted = names or list(facts["tables"])
    tables = load_tables(spark, last[-1], wanted, facts["format"])
    return {n: df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in facts["tables"][n]["columns"]]) for n, df in tables.items()}


def export_manifest(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> str:
    """The five tables of MANIFEST_TABLES as CSV and all of them as one JSON text, published at once.

    The JSON's lines are made and sorted by Spark; one task writes them, as one
    file asks, without holding them.
    """
    missing = [n for n in MANIFEST_TABLES if n not in tables]
    if missing:
        raise ValueError(f"a manifest lacks {', '.join(missing)}")

    def as_json(version: str) -> None:
        lines = spark.createDataFrame([(-1, 0, "{")], "part int, place int, line string")
        for i, name in enumerate(MANIFEST_TABLES):
            ends = spark.createDataFrame([(i, 0, f"{json.dumps(name)}: ["), (i, 2, "]" if i + 1 == len(MANIFEST_TABLES) else "],")], lines.schema)
            rows = flat(tables[name])
            texts = rows.select(F.lit(i).alias("part"), F.lit(1).alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("line"))
            lines = lines.union(ends).union(texts)
        lines = lines.union(spark.createDataFrame([(len(MANIFEST_TABLES), 0, "}")], lines.schema))
        after = F.lead("place").over(Window.partitionBy("part").orderBy("place", "line"))  # metadata: a row per column of the season's tables
        comma = F.when((F.col("place") == 1) & (after == 1), F.concat("line", F.lit(","))).otherwise(F.col("line"))
        lines.withColumn("line", comma).coalesce(1).sortWithinPartitions("part", "place", "line").select("line").write.text(f"{version}/lineage_manifest_json")

    return publish(spark, {n: tables[n] for n in MANIFEST_TABLES}, folder, "csv", beside=as_json)


def load_tables(spark: SparkSession, folder: str, names: list[str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") if kind == "parquet" else spark.read.csv(f"{folder}/{n}", header=True) for n in names}


def table_status(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, files, size_mb (of 2^20 bytes), refreshed_at) of saved tables; one that is not there is left out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"))]
    schema = "name string, files long, size_mb double, refreshed_at timestamp"
    if not there:
        return spark.createDataFrame([], schema)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/{n}" for n in there]).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -2)
    return rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / MB).alias("size_mb"), F.max("modificationTime").alias("refreshed_at"))


def ensure_table(spark: SparkSession, name: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The saved table, built and saved first if it is not there or is to be refreshed."""
    if refresh or not spark.catalog.tableExists(name):
        build().write.mode("overwrite").saveAsTable(name)
    return spark.table(name)
