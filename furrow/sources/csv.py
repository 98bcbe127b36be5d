"""CSV drops: headers normalised, every field read as text, then parsed by name. Nothing is inferred from data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.exprs import filename_date, image_name, parse_number, strip_zone
from furrow.functions.wkt import with_centroid
from furrow.operators.windows import first_rows

# Where each source lies, its separator and whether it must be there.
SOURCES = {
    "soil_analysis": ("Cropman*/CSV/soil_analysis.csv", ";", True),
    "ndvi_metadata": ("OneSoil*/CSV/ndvi_metadata.csv", ",", True),
    "traps_list": ("EKOS*/CSV/Pest/traps_list.csv", ";", True),
    "traps_data": ("EKOS*/CSV/Pest/traps_data.csv", ";", True),
    "weather_hourly": ("Metos*/CSV/*.csv", ";", True),
    "pest_list": ("EKOS*/CSV/Pest/pest_list.csv", ";", False),
    "pest_details": ("EKOS*/CSV/Pest/pest_details.csv", ";", False),
    "traps_events": ("EKOS*/CSV/Pest/traps_events.csv", ";", False),
}
_LAYER = "EKOS*/CSV/Layers/LAYER_MAP_{}.csv"
# The file of each telemetry layer, its number columns, and whether the drop must have it. Every layer also has the common ones.
LAYER_NUMBERS = ("Timestamp", "Service Order", "Operator Number")
LAYERS = {
    "planting": ("PLANTING", ("Area - ha", "Population - ha"), True),
    "harvest": ("GRAIN_HARVESTING", ("Area - ha", "Yield - kg/ha", "Weight - kg", "Humidity - %"), True),
    "fertilization": ("FERTILIZATION", ("Area - ha", "AppliedDos - kg/ha", "Configured - kg/ha", "Weight - kg"), False),
    "spray": ("SPRAY_PRESSURE", ("Pressure - psi",), False),
    "overlap": ("OVERLAP", ("OverlapArea - ha",), False),
    "speed": ("SPEED", ("Speed - km/h",), False),
    "state": ("STATE", (), False),
    "stop": ("STOP_REASON", ("Duration - h",), False),
    "alarm": ("ALARM", (), False),
    "param_alert": ("PARAMETERIZED_ALERT", ("Duration", "Valor"), False),
    "telemetry": ("TELEMETRY_COMMUNICATION", (), False),
    "engine_rotation": ("ENGINE_ROTATION", ("EngineRotation - rpm",), False),
    "engine_temperature": ("ENGINE_TEMPERATURE", ("EngineTemperature - ºC",), False),
    "fuel": ("FUEL_CONSUMPTION", ("FuelConsumption - L/h",), False),
    "schedule": ("SCHEDULE", (), False),
}
SOURCES |= {f"{name}_layer": (_LAYER.format(file), ";", mandatory) for name, (file, _, mandatory) in LAYERS.items()}
SOURCES["ndvi_images"] = ("OneSoil*/JPG", "", False)
#: Operations of the daily operations table, and of the support table.
OPS_LAYERS = ("planting", "harvest", "fertilization", "spray", "overlap", "speed", "state", "stop")
SUPPORT_LAYERS = ("alarm", "param_alert", "telemetry", "engine_rotation", "engine_temperature", "fuel")
# Names of thresholds in the pest list and in the details.
PEST_LIST_NAMES = {"MIIP_PEST_NAME_POPULAR": "name", "MIIP_PEST_NAME_SCIENTIFIC": "scientific_name", "MIIP_PEST_ALERT": "alert_threshold", "MIIP_PEST_CONTROL": "control_threshold", "MIIP_PEST_DAMAGE": "damage_threshold"}
PEST_DETAIL_NAMES = {"namePopular": "name", "nameScientific": "scientific_name", "alert": "alert_threshold", "control": "control_threshold", "damage": "damage_threshold", "actionRay": "action_ray_m"}
# Weather headers and the columns they become.
WEATHER_HEADERS = {
    "Data": "data_raw",
    "Estação": "station",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Radiação Solar (W/m2)": "solar_radiation_w_m2",
    "Precipitação (mm)": "precipitation_mm",
    "Vel do Vento Média (km/h)": "wind_avg_kmh",
    "Temp. Mínima (°C)": "temp_min_c",
    "Temp. Média (°C)": "temp_avg_c",
    "Temp. Máxima (°C)": "temp_max_c",
    "Umidade Rel. Mín. (%)": "humidity_min_pct",
    "Umidade Rel. Média (%)": "humidity_avg_pct",
    "Umidade Rel. Máxima (%)": "humidity_max_pct",
    "Rajada de Vento (km/h)": "wind_gust_kmh",
    "Evapotranspiração (mm)": "evapotranspiration_mm",
}
SCENE_TEXTS = ("filename", "season_id", "driver", "dtype", "nodata", "crs")


def mojibake(text: str) -> str:
    """How a UTF-8 header looks that was read as Latin-1 or Windows-1252."""
    try:
        return text.encode().decode("cp1252")
    except UnicodeDecodeError:
        return text.encode().decode("latin-1")


def find_source(spark: SparkSession, root: str, name: str) -> str | None:
    """The first path in order that the source's pattern matches; a missing mandatory source is an error."""
    pattern, _, mandatory = SOURCES[name]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    paths = sorted(str(f.getPath()) for f in found or [])
    if not paths and mandatory:
        raise FileNotFoundError(f"no {pattern} under {root}")
    return paths[0] if paths else None


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, path, size, block, at): the lines of files as their bytes are, ended by \\n alone; block and at give their order in a file.

    Spark splits large files, so a file is any number of tasks. Only files named .csv, where path is a folder.
    """
    reader = spark.read.options(lineSep="\n", recursiveFileLookup=True)
    text = (reader if isinstance(path, list) or path.lower().endswith(".csv") else reader.option("pathGlobFilter", "*.[cC][sS][vV]")).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def is_utf8(line: str = "value") -> Column:
    """Aggregate: whether all lines decode as UTF-8."""
    return F.coalesce(F.bool_and(F.is_valid_utf8(line)), F.lit(True))


def encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding) of files, each by all its bytes: UTF-8, or ISO-8859-1 where they do not decode as such. Files without a line are left out."""
    return raw_lines(spark, path).groupBy("path").agg(F.when(is_utf8(), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a file, or of a folder's files if they agree; of files that do not, ISO-8859-1."""
    return raw_lines(spark, path).agg(F.when(is_utf8(), "UTF-8").otherwise("ISO-8859-1")).first()[0]


def read_text_columns(spark: SparkSession, path: str, sep: str = ";", multiline: bool = False) -> DataFrame:
    """A CSV, or a folder of them, with every column as text, headers trimmed and without a byte-order mark; empty fields are null.

    Each file is read in its own encoding, columns by name. multiline is for
    files whose quoted fields hold line ends: such a file is one task.
    """

    def read(paths: str | list[str], kind: str) -> DataFrame:
        df = spark.read.options(sep=sep, header=True, encoding=kind, quote='"', escape='"', multiLine=multiline).csv(paths)
        return df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])

    by_kind: dict[str, list[str]] = {}
    for r in encodings(spark, path).orderBy("path").collect():  # a row per file of a source
        by_kind.setdefault(r["encoding"], []).append(r["path"])
    if len(by_kind) <= 1:
        return read(path, next(iter(by_kind), "UTF-8"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(paths, kind) for kind, paths in sorted(by_kind.items())])


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_number(F.col(f"`{c}`")) for c in columns if c in df.columns})


def timestamp(c: Column | str, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c if isinstance(c, Column) else F.col(c), F.lit(f)) for f in formats])


def load_soil(spark: SparkSession, path: str) -> DataFrame:
    df = read_text_columns(spark, path)
    return numbers(df, [c for c in df.columns if c != "AMOSTRA"])


def load_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene metadata with date and image_path by file name; all but the named text columns are numbers."""
    df = read_text_columns(spark, path, ",")
    df = numbers(df, [c for c in df.columns if c not in SCENE_TEXTS])
    return df.withColumns({"date": filename_date("filename"), "image_path": image_name("filename")})


def load_traps(spark: SparkSession, path: str) -> DataFrame:
    """Traps, the first row of equals by (code, type, plot, latitude, longitude); blank plots are null."""
    df = numbers(read_text_columns(spark, path), ["latitude", "longitude", "businessUnit", "farm", "radius"])
    df = df.withColumns({"plot": F.when(F.trim("plot").isin("", "nan"), None).otherwise(F.col("plot")), "installationDate": F.try_to_timestamp("installationDate"), "__order": F.monotonically_increasing_id()})
    return first_rows(df, ["code", "type", "plot", "latitude", "longitude"], ["__order"]).drop("__order")


def _moments(df: DataFrame) -> DataFrame:
    return df.withColumn("createdAt", F.try_to_timestamp("createdAt")).withColumn("event_date", F.to_date("createdAt"))


def load_trap_data(spark: SparkSession, path: str) -> DataFrame:
    return _moments(numbers(read_text_columns(spark, path), ["doneMissionCount", "idBusinessUnit", "lateMissionCount", "pendingMissionCount", "pestCount", "trapId"]))


def load_trap_events(spark: SparkSession, path: str) -> DataFrame:
    """Trap events; detection holds JSON, which may go over lines."""
    return _moments(numbers(read_text_columns(spark, path, multiline=True), ["farm", "id", "pestCount", "trapId"]))


def load_pest_list(spark: SparkSession, path: str) -> DataFrame:
    """Pests with their thresholds under the names that the lookup knows."""
    df = numbers(read_text_columns(spark, path), ["MIIP_PEST_ID", "MIIP_PEST_ALERT", "MIIP_PEST_CONTROL", "MIIP_PEST_DAMAGE"])
    return df.withColumnsRenamed(PEST_LIST_NAMES)


def load_pest_details(spark: SparkSession, path: str) -> DataFrame:
    df = numbers(read_text_columns(spark, path, multiline=True), ["actionRay", "alert", "control", "damage", "daysAdhesiveFloor", "daysPheromone", "id"])
    return df.withColumnsRenamed(PEST_DETAIL_NAMES)


def load_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather under its own column names, also where the headers were read in another encoding; columns that the station lacks are null."""
    df = read_text_columns(spark, path)
    names = {**WEATHER_HEADERS, **{mojibake(k): v for k, v in WEATHER_HEADERS.items()}}
    df = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    df = numbers(df, [c for c in df.columns if c not in ("data_raw", "station")])
    df = df.withColumns({c: F.lit(None).cast("double") for c in WEATHER_HEADERS.values() if c not in df.columns})
    return df.withColumn("timestamp", timestamp(strip_zone("data_raw"), "dd/MM/yyyy - HH:mm")).withColumn("date", F.to_date("timestamp"))


def load_layer(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """A telemetry layer: numbers, timestamp and day, and the centroid of its geometry."""
    df = numbers(read_text_columns(spark, path), numeric)
    df = df.withColumn("timestamp", timestamp("`Date Time`", "dd/MM/yyyy HH:mm:ss")).withColumn("date", F.to_date("timestamp"))
    return with_centroid(df) if "geometry" in df.columns else df


def load_named_layer(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A layer of LAYERS from a drop; None if the drop has it not and need not."""
    path = find_source(spark, root, f"{name}_layer")
    if path is None:
        return None
    df = load_layer(spark, path, [*LAYER_NUMBERS, *LAYERS[name][1]])
    return df.withColumnRenamed("operation", "Operation") if "Operation" not in df.columns and "operation" in df.columns else df


def file_summary(spark: SparkSession, path: str, sep: str, sample: int = 5000) -> DataFrame:
    """One row of a CSV: columns, rows, null cells of the first sample rows (a report's limit), encoding."""
    df = read_text_columns(spark, path, sep)
    head = df.limit(sample)
    empty = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    counts = head.agg(F.count(F.lit(1)).alias("sampled_rows"), empty.alias("null_cells"))
    return counts.select(F.lit(path).alias("path"), F.lit(encoding(spark, path)).alias("encoding"), F.lit(len(df.columns)).alias("columns"), "sampled_rows", "null_cells").join(df.agg(F.count(F.lit(1)).alias("rows")))
