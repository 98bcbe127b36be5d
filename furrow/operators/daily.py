"""Daily facts: telemetry layers, weather and traps summed by field and day, and their join."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import detections, distinct_joined, machine_state, safe_divide, text_key, truthy, week_start
from furrow.operators.order import quantile_row

KEYS = ("season_id", "date")


class Quantile(NamedTuple):
    """An exact quantile of a column by key: no aggregate of Spark's, as a day of a field may be any number of rows."""

    column: str
    share: float


@dataclass(frozen=True)
class Layer:
    """A layer's daily summary: rows to keep, columns derived before, aggregates by name."""

    aggregates: dict[str, Column | Quantile]
    where: Column | None = None
    derive: dict[str, Column] = field(default_factory=dict)

    def summarize(self, df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
        """One row per key; rows with a null key are left out, as are keys without a kept row."""
        for key in keys:
            df = df.where(F.col(key).isNotNull())
        df = df.withColumns(self.derive) if self.derive else df
        df = df.where(self.where) if self.where is not None else df
        sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in self.aggregates.items() if not isinstance(c, Quantile)])
        wanted = {n: (c.column, c.share) for n, c in self.aggregates.items() if isinstance(c, Quantile)}
        if not wanted:
            return sums
        found = quantile_row(df, list(keys), wanted)  # no key is null here
        return sums.join(found, list(keys), "left").select(*keys, *self.aggregates)


def total(c: str) -> Column:
    """A sum that is 0 where all values are null."""
    return F.coalesce(F.sum(F.col(f"`{c}`").cast("double")), F.lit(0.0))


def mean(c: str) -> Column:
    return F.avg(f"`{c}`")


def p90(c: str) -> Quantile:
    return Quantile(c, 0.9)


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def rows() -> Column:
    """The number of rows, null values included."""
    return F.count(F.lit(1))


def _operation(word: str, measure: str) -> Column:
    return F.contains(F.upper(F.col("Operation")), F.lit(word)) & (F.coalesce(F.col(f"`{measure}`"), F.lit(0.0)) > 0)


def _layers() -> dict[str, Layer]:
    states = ("operation", "maneuver", "transit", "supply", "stop")
    gap = F.col("`AppliedDos - kg/ha`") - F.col("`Configured - kg/ha`")
    return {
        "planting": Layer(
            {"planting_points": rows(), "planting_area_ha": total("Area - ha"), "planting_population_mean_ha": mean("Population - ha"), "planting_population_p90_ha": p90("Population - ha")},
            _operation("PLANTIO", "Population - ha"),
        ),
        "harvest": Layer(
            {
                "harvest_points": rows(), "harvest_area_ha": total("Area - ha"), "harvest_yield_mean_kg_ha": mean("Yield - kg/ha"), "harvest_yield_p90_kg_ha": p90("Yield - kg/ha"),
                "harvest_weight_kg": total("Weight - kg"), "harvest_humidity_mean_pct": mean("Humidity - %"),
            },
            _operation("COLHEITA", "Yield - kg/ha"),
        ),
        "fertilization": Layer(
            {
                "fert_points": rows(), "fert_area_ha": total("Area - ha"), "fert_applied_mean_kg_ha": mean("AppliedDos - kg/ha"), "fert_configured_mean_kg_ha": mean("Configured - kg/ha"),
                "fert_dose_gap_mean_kg_ha": mean("__gap"), "fert_dose_gap_abs_mean_kg_ha": F.avg(F.abs("__gap")), "fert_dose_ratio_mean": mean("__ratio"), "fert_weight_kg": total("Weight - kg"),
            },
            F.col("`AppliedDos - kg/ha`").isNotNull() | F.col("`Configured - kg/ha`").isNotNull(),
            {"__gap": gap, "__ratio": safe_divide(F.col("`AppliedDos - kg/ha`"), F.col("`Configured - kg/ha`"))},
        ),
        "spray": Layer({"spray_points": rows(), "spray_pressure_mean_psi": mean("Pressure - psi"), "spray_pressure_active_share": share(F.col("`Pressure - psi`") > 0)}),
        "overlap": Layer({"overlap_points": rows(), "overlap_area_ha": total("OverlapArea - ha")}),
        "speed": Layer({"speed_points": rows(), "speed_mean_kmh": mean("Speed - km/h"), "speed_p90_kmh": p90("Speed - km/h"), "speed_zero_share": share(F.coalesce(F.col("`Speed - km/h`"), F.lit(0.0)) <= 0.1)}),
        "state": Layer({"state_points": rows(), **{f"state_{s}_share": share(F.col("__state") == s) for s in states}}, derive={"__state": machine_state("MachineState")}),
        # an unnamed stop counts as one with a known reason
        "stop": Layer({"stop_events": rows(), "stop_duration_h": total("Duration - h"), "stop_known_reason_share": share(F.coalesce("event", F.lit("")) != "Sem evento")}),
        "alarm": Layer({"alarm_events": rows(), "alarm_type_count": F.count_distinct(F.nullif(F.trim("Alarm"), F.lit("")))}),
        "param_alert": Layer({"param_alert_events": rows(), "param_alert_type_count": F.count_distinct(F.nullif(F.trim("Alert"), F.lit("")))}),
        "telemetry": Layer(
            {
                "telemetry_points": rows(), "invalid_telemetry_share": share(truthy("InvalidCommunication")), "external_gps_share": share(truthy("ExternalGPS")),
                "mobile_comm_share": share(F.col("TelemetryCommunication").rlike("(?i)m[oó]vel")),
            }
        ),
        "engine_rotation": Layer({"engine_rotation_points": rows(), "engine_rotation_mean_rpm": mean("EngineRotation - rpm"), "engine_idle_share": share(F.coalesce(F.col("`EngineRotation - rpm`"), F.lit(0.0)).between(1, 900))}),
        "fuel": Layer({"fuel_points": rows(), "fuel_consumption_mean_l_h": mean("FuelConsumption - L/h"), "fuel_zero_share": share(F.coalesce(F.col("`FuelConsumption - L/h`"), F.lit(0.0)) == 0)}),
    }


LAYER_NAMES = ("planting", "harvest", "fertilization", "spray", "overlap", "speed", "state", "stop", "alarm", "param_alert", "telemetry", "engine_rotation", "fuel")


def summarize_layer(df: DataFrame, name: str) -> DataFrame:
    """The daily summary of a telemetry layer (one of LAYER_NAMES) with season_id and date."""
    return _layers()[name].summarize(df)


def hot_share(df: DataFrame, column: str = "EngineTemperature - ºC", default: float = 85.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Daily engine temperatures; hot is at or above the whole layer's 90th percentile (default: of an empty layer)."""
    limit = quantile_row(df, [], {"__limit": (column, 0.9)}).select(F.coalesce("__limit", F.lit(default)).alias("__limit"))
    named = Layer({"engine_temp_points": rows(), "engine_temp_mean_c": mean(column), "engine_temp_max_c": F.max(f"`{column}`"), "engine_temp_hot_share": share(F.col(f"`{column}`") >= F.col("__limit"))})
    return named.summarize(df.join(F.broadcast(limit)), keys)  # one row of limits


def merge_daily(parts: list[DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Full outer join of summaries on their keys, as one union and one aggregation: a single shuffle for any number of parts."""
    if not parts:
        raise ValueError("no summaries to merge")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in union.columns if c not in keys])


def weather_daily(weather: DataFrame) -> DataFrame:
    """Hourly weather by day, with the water balance and means of the last 7 and 14 rows."""
    sums = {c: total(c) for c in ("precipitation_mm", "evapotranspiration_mm")}
    means = {c: mean(c) for c in ("solar_radiation_w_m2", "temp_avg_c", "humidity_avg_pct", "wind_avg_kmh")}
    daily = weather.where("date is not null").groupBy(F.to_date("date").alias("date")).agg(
        *[c.alias(n) for n, c in {**sums, **means}.items()], F.max("temp_max_c").alias("temp_max_c"), F.min("temp_min_c").alias("temp_min_c")
    )
    daily = daily.withColumn("water_balance_mm", F.col("precipitation_mm") - F.col("evapotranspiration_mm"))
    from furrow.operators.windows import rolling_mean

    daily = rolling_mean(daily, "precipitation_mm", 7, [], "date", "precipitation_mm_ma7")
    daily = rolling_mean(daily, "water_balance_mm", 14, [], "date", "water_balance_mm_ma14")
    return daily.withColumn("week_start", week_start("date"))


def trap_daily(readings: DataFrame) -> DataFrame:
    """Trap readings by field and day; a threshold is hit where count and threshold are known and the count reaches it."""
    hits = {f"{k}_hits": total_of(F.coalesce(F.col("pestCount") >= F.col(f"{k}_threshold"), F.lit(False))) for k in ("alert", "control", "damage")}
    kinds = {f"{k.lower()}_readings": total_of(F.col("trapType") == k) for k in ("ELECTRONIC", "CONVENTIONAL")}
    return Layer(
        {
            "trap_readings": rows(), "traps_reporting": F.count_distinct("trapCode"), **kinds, "avg_pest_count": mean("pestCount"), "total_pest_count": total("pestCount"), **hits,
            "avg_action_ray_m": mean("action_ray_m"), "primary_pests": distinct_joined("primaryPest"),
        }
    ).summarize(readings)


def total_of(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def trap_event_daily(events: DataFrame) -> DataFrame:
    """Trap events by field and day with the boxes and species of their detection payloads."""
    found = events.withColumn("__found", detections("detection"))
    names = found.select(*KEYS, F.explode(F.transform("__found", lambda r: r["name"])).alias("__name")).groupBy(*KEYS).agg(distinct_joined("__name").alias("detected_species"))
    kinds = {"image_events": "IMAGE", "ping_events": "PING", "battery_events": "CLIENT_BATTERY_VOLTAGE"}
    counts = Layer({**{n: total_of(F.col("type") == k) for n, k in kinds.items()}, "image_pest_count": total("pestCount"), "detected_boxes": F.sum(F.size("__found"))}).summarize(found)
    return counts.join(names, list(KEYS), "left").withColumn("detected_species", F.coalesce("detected_species", F.lit("")))


def pest_lookup(pests: DataFrame, details: DataFrame) -> DataFrame:
    """Thresholds by text key of the pest's name: the list's value where known, else the details'; one row a key."""
    cols = ("alert_threshold", "control_threshold", "damage_threshold", "action_ray_m")
    sides = [df.select(text_key("name").alias("primary_pest_key"), *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in cols], F.lit(i).alias("side")) for i, df in enumerate((pests, details))]
    both = sides[0].union(sides[1]).where("primary_pest_key <> ''")
    return both.groupBy("primary_pest_key").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("side", c))).alias(c) for c in cols])
