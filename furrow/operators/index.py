"""The lineage index: where every column of every layer comes from, its coverage, manifest and what correlations rest on.

Registries are tables of the caller: features (feature, category, definition,
born_table, source_columns, raw_sources, transformation, thresholds,
appears_in_csvs, hypotheses), pipe-separated where they hold several, and
drivers (driver, feature, definition). A record is a row of RECORD.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import pipe_list, short_id

RECORD = ("lineage_id", "column", "layer", "table", "definition", "raw_sources", "upstream_columns", "transformation", "thresholds", "downstream_csvs", "hypotheses", "mapping_status")
LAYERS = ("bruto", "feature", "driver", "intermediario", "csv_final")
# States of a mapping that can be audited, and the strong ones.
STRONG = ("mapeado", "mapeado_por_feature", "mapeado_por_driver", "mapeado_por_driver_dinamico", "mapeado_por_driver_entidade", "mapeado_por_dependencia")
AUDITABLE = (*STRONG, "mapeado_por_tabela", "parcial_por_tabela", "parcial_por_dependencia_csv", "parcial_por_csv_exportado")
# What is replaced in a derived column's name to find its feature, in order of the attempts.
REPLACED = ((("gap_", ""), ("_4_0_minus_convencional", "")), (("_4_0", ""), ("_convencional", "")), (("_mean", ""),), (("_rate", "_flag"),))
# Columns that stand for a feature of another name.
SPECIAL = {
    "mean": "ndvi_mean", "max": "ndvi_mean", "soil_pct_mean": "soil_pct", "dense_veg_pct_mean": "dense_veg_pct", "ndvi_zscore": "ndvi_mean", "ndvi_robust_zscore": "ndvi_mean", "outlier_flag": "ndvi_mean",
    "gap_ndvi_mean_week": "ndvi_mean_week", "gap_ndvi_auc_week": "ndvi_auc_week", "gap_low_vigor_flag": "low_vigor_flag", "gap_major_drop_flag": "major_drop_flag", "gap_high_soil_flag": "high_soil_flag",
    "gap_ops_risk_flag": "ops_risk_flag", "problem_rate": "risk_flag_count", "baseline_rate": "risk_flag_count", "delta_pp": "risk_flag_count", "lift_ratio": "risk_flag_count", "trajectory_score": "risk_flag_count",
}
# The table whose columns are by driver, those columns, which of them a feature stands for and which one, and the driver that others fall to.
LIFT_TABLE = "event_driver_lift.csv"
LIFT_COLUMNS = ("driver", "problem_weeks", "problem_rate", "baseline_rate", "delta_pp", "lift_ratio", "evidence_level")
LIFT_FEATURE = "risk_flag_count"
#: Names that a registry holds at most: it travels as one row.
MAX_NAMES = 10_000


def feature_catalog(features: DataFrame) -> DataFrame:
    """The registry in the order of category and name, lists as texts."""
    return features.orderBy("category", "feature")


def usage_by_source(features: DataFrame) -> DataFrame:
    """(column, used_by): the features that read a source column, in order."""
    each = features.select(F.explode(pipe_list("source_columns")).alias("column"), "feature")
    return each.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("feature")), " | ").alias("used_by"))


def _record(df: DataFrame, layer: str, **columns: Column) -> DataFrame:
    out = df.select(*[(columns[c] if c in columns else F.lit("")).cast("string").alias(c) for c in RECORD if c not in ("lineage_id", "layer")], F.lit(layer).alias("layer"))
    return out.withColumn("lineage_id", short_id("layer", "table", "column")).select(*RECORD)


def _names(registry: DataFrame, name: str, also: Column | None = None) -> DataFrame:
    """One row __names of the registry's names in its order: by position where it has that column, else as category and name sort. Too many are an error."""
    if registry.count() > MAX_NAMES:
        raise ValueError(f"over {MAX_NAMES} names in a registry")
    order = [F.col(c) for c in ("position", "category") if c in registry.columns][:1]
    rows = registry.where(F.col(name).isNotNull()).select(F.struct(*order, F.col(name).alias("name"), *([also.alias("also")] if also is not None else [])).alias("r"))
    return rows.agg(F.sort_array(F.collect_list("r")).alias("r")).select(F.transform("r", lambda r: F.struct(r["name"].alias("name"), r["also"].alias("also")) if also is not None else r["name"]).alias("__names"))


def inferred(columns: DataFrame, features: DataFrame) -> DataFrame:
    """columns (table, column) with feature: the registered feature that a column is, or derives its name from; else null.

    In this order: the name itself; for the lift's columns their fixed feature; the name with
    parts replaced, by REPLACED; SPECIAL; the first feature, as the registry goes,
    whose name is part of the column's.
    """
    names = F.col("__names")
    attempts = []
    for pairs in REPLACED:
        c = F.col("column")
        for a, b in pairs:
            c = F.replace(c, F.lit(a), F.lit(b))
        attempts.append(c)
    special = F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv])
    attempts.append(F.try_element_at(special, F.col("column")))
    known = lambda c: F.when(F.array_contains(names, c), c)
    lift = F.when((F.col("table") == LIFT_TABLE) & F.col("column").isin(*(c for c in LIFT_COLUMNS if c != "problem_weeks")), LIFT_FEATURE)
    part = F.get(F.filter(names, lambda f: F.contains(F.col("column"), f)), F.lit(0))
    joined = columns.join(F.broadcast(_names(features, "feature")))  # one row
    return joined.withColumn("feature", F.coalesce(known(F.col("column")), lift, *map(known, attempts), part)).drop("__names")


def with_driver(columns: DataFrame, drivers: DataFrame) -> DataFrame:
    """columns with driver: itself, or the first driver in the registry's order whose name or flag is part of the column's name; else null."""
    joined = columns.join(F.broadcast(_names(drivers, "driver", F.col("feature"))))  # one row
    own = F.get(F.filter("__names", lambda d: d["name"] == F.col("column")), F.lit(0))["name"]
    part = F.get(F.filter("__names", lambda d: F.contains(F.col("column"), d["name"]) | F.contains(F.col("column"), d["also"])), F.lit(0))["name"]
    return joined.withColumn("driver", F.coalesce(own, part)).drop("__names")


def lineage_index(spark: SparkSession, raw_columns: DataFrame, features: DataFrame, drivers: DataFrame, intermediate: dict[str, list[str]], final: dict[str, list[str]], registered: tuple[str, ...] = ()) -> DataFrame:
    """Records of raw columns (table, column), features, drivers, and the columns of intermediate and final tables, each id once.

    registered names the final tables whose dependencies are registered. A final
    column is mapped by the lift's drivers, by a feature, by a driver, or in part
    by its table's dependencies or its export; an intermediate one by a feature
    or in part by its table; a raw one by the features that read it, or, without
    any, in part.
    """
    rows = [(layer, t, c) for layer, tables in (("intermediario", intermediate), ("csv_final", final)) for t, columns in tables.items() for c in columns]
    used = usage_by_source(features)
    raw = raw_columns.join(used, "column", "left")
    parts = [
        _record(raw, "bruto", column=F.col("column"), table=F.col("table"), raw_sources=F.col("table"), definition=F.lit("coluna de origem"), transformation=F.coalesce("used_by", F.lit("")), mapping_status=F.when(F.col("used_by").isNotNull(), "mapeado").otherwise("parcial_por_tabela")),
        _record(features, "feature", column=F.col("feature"), table=F.col("born_table"), definition=F.col("definition"), raw_sources=F.col("raw_sources"), upstream_columns=F.col("source_columns"), transformation=F.col("transformation"),
                thresholds=F.col("thresholds"), downstream_csvs=F.col("appears_in_csvs"), hypotheses=F.col("hypotheses"), mapping_status=F.lit("mapeado_por_feature")),
        _record(drivers, "driver", column=F.col("driver"), table=F.lit("drivers"), definition=F.col("definition"), upstream_columns=F.col("feature"), mapping_status=F.lit("mapeado_por_driver_entidade")),
    ]
    if rows:
        named = with_driver(inferred(spark.createDataFrame(rows, "layer string, table string, column string"), features), drivers)
        held = named.join(features.select("feature", "definition", "raw_sources", "source_columns", "transformation", "thresholds", "hypotheses"), "feature", "left")
        final_layer = F.col("layer") == "csv_final"
        rest = F.when(~final_layer, "parcial_por_tabela").when(F.col("table").isin(*registered), "parcial_por_dependencia_csv").otherwise("parcial_por_csv_exportado")
        status = (
            F.when(final_layer & (F.col("table") == LIFT_TABLE) & F.col("column").isin(*LIFT_COLUMNS), "mapeado_por_driver_dinamico").when(F.col("feature").isNotNull(), "mapeado_por_feature")
            .when(final_layer & F.col("driver").isNotNull(), "mapeado_por_driver").otherwise(rest)
        )
        for layer in ("intermediario", "csv_final"):
            of = held.where(F.col("layer") == layer)
            text = {c: F.coalesce(c, F.lit("")) for c in ("definition", "raw_sources", "transformation", "thresholds", "hypotheses")}
            parts.append(_record(of, layer, column=F.col("column"), table=F.col("table"), upstream_columns=F.coalesce("source_columns", F.lit("")), downstream_csvs=F.col("table") if layer == "csv_final" else F.lit(""), mapping_status=status, **text))
    both = reduce(DataFrame.unionByName, parts)
    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    return both.dropDuplicates(["lineage_id"]).orderBy(order, "table", "column")


def records_for(index: DataFrame, column: str, table: str | None = None, layer: str | None = None) -> DataFrame:
    out = index.where(F.col("column") == column)
    out = out.where(F.col("table") == table) if table else out
    return out.where(F.col("layer") == layer) if layer else out


def csv_coverage(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Per final table (csv, column_name): columns, those with lineage and with strong lineage, their share, and the missing ones."""
    final = index.where("layer = 'csv_final'").groupBy(F.col("table").alias("csv"), F.col("column").alias("column_name")).agg(F.bool_or(F.col("mapping_status").isin(*STRONG)).alias("strong"))
    both = expected.select("csv", "column_name").distinct().join(final, ["csv", "column_name"], "left")
    has = F.col("strong").isNotNull()
    out = both.groupBy("csv").agg(
        F.count(F.lit(1)).alias("columns_total"), F.count_if(has).alias("columns_with_lineage"), F.count_if(F.coalesce("strong", F.lit(False))).alias("strong_or_partial_lineage"), (F.count_if(has) / F.count(F.lit(1))).alias("coverage_pct"),
        F.array_join(F.array_sort(F.collect_list(F.when(~has, F.col("column_name")))), ", ").alias("unmapped_columns"),
    )
    return out.orderBy("coverage_pct", "csv")


# What each gate's evidence says of its metric, and what it asks for.
EVIDENCE = {
    "G1_final_csv_coverage": ("Cobertura minima por CSV final: %s.", "Toda coluna de CSV final deve aparecer no indice de lineage."),
    "G2_final_columns_auditable": ("Colunas finais auditaveis: %s.", "Mapear qualquer coluna final sem status auditavel; se nao houver prova, marcar limitacao explicita."),
    "G3_strong_or_documented_lineage": ("Mapeamento forte por feature/driver: %s.", "Elevar colunas criticas para mapeamento forte; colunas auxiliares podem ficar parciais se documentadas."),
    "G4_critical_targets": ("Alvos criticos aprovados: %s.", "Corrigir rastreabilidade dos alvos que sustentam a historia 4.0 vs convencional."),
    "G5_quality_rules_visible": ("%s regras de qualidade calculadas; %s com linhas afetadas.", "Expor regras de qualidade e exemplos antes de fechar conclusao executiva."),
    "G6_known_limitations_visible": ("%s limitacoes estruturais devem aparecer na documentacao e na UI.", "Nao vender causalidade, economia fechada ou raster pixel-a-pixel sem dados correspondentes."),
}


def acceptance_gates(index: DataFrame, coverage: DataFrame, critical: DataFrame, quality: DataFrame, limitations: int) -> DataFrame:
    """Six gates (gate_id, status, metric, evidence, required_action). critical: (target, passed, checks); quality: rules with affected_rows."""
    final = index.where("layer = 'csv_final'")
    share = lambda states: F.coalesce(F.avg(F.col("mapping_status").isin(*states).cast("double")), F.lit(0.0))
    one = coverage.agg(F.coalesce(F.min("coverage_pct"), F.lit(0.0)).alias("m")).select(F.lit("G1_final_csv_coverage").alias("gate_id"), F.when(F.col("m") >= 1, "ok").otherwise("falha").alias("status"), "m")
    two = final.agg(share(AUDITABLE).alias("m")).select(F.lit("G2_final_columns_auditable"), F.when(F.col("m") >= 1, "ok").otherwise("falha"), "m")
    three = final.agg(share(STRONG).alias("m")).select(F.lit("G3_strong_or_documented_lineage"), F.when(F.col("m") >= 0.6, "ok").otherwise("aceito_com_limitacao"), "m")
    four = critical.agg(F.coalesce(F.avg((F.col("passed") == F.col("checks")).cast("double")), F.lit(0.0)).alias("m")).select(F.lit("G4_critical_targets"), F.when(F.col("m") >= 1, "ok").otherwise("falha"), "m")
    five = quality.agg(F.count(F.lit(1)).cast("double").alias("m")).select(F.lit("G5_quality_rules_visible"), F.when(F.col("m") > 0, "ok").otherwise("falha"), "m")
    six = one.select(F.lit("G6_known_limitations_visible"), F.lit("aceito_com_limitacao"), F.lit(float(limitations)))
    hit = quality.agg(F.count_if(F.coalesce(F.col("affected_rows") > 0, F.lit(False))).alias("__hit"))
    out = reduce(DataFrame.union, (one, two, three, four, five, six)).join(F.broadcast(hit))  # one row
    number = F.when(F.col("gate_id").substr(1, 2).isin("G5", "G6"), F.col("m").cast("long").cast("string")).otherwise(F.format_string("%.0f%%", F.bround(F.col("m") * 100)))
    said = F.lit(None).cast("string")
    asked = said
    for gate, (text, action) in EVIDENCE.items():
        values = (number, F.col("__hit").cast("string")) if text.count("%s") == 2 else (number,)
        said, asked = F.when(F.col("gate_id") == gate, F.format_string(text, *values)).otherwise(said), F.when(F.col("gate_id") == gate, action).otherwise(asked)
    return out.select("gate_id", "status", F.col("m").alias("metric"), said.alias("evidence"), asked.alias("required_action"))


def manifest_summary(index: DataFrame, coverage: DataFrame, gates: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: records, final tables, least and mean coverage, gates that hold, rules with affected rows."""
    one = index.agg(F.count(F.lit(1)).alias("lineage_records"), F.count_if(F.col("layer") == "csv_final").alias("final_records"))
    parts = (
        coverage.agg(F.count(F.lit(1)).alias("final_tables"), F.min("coverage_pct").alias("least_coverage"), F.avg("coverage_pct").alias("mean_coverage")),
        gates.agg(F.count(F.lit(1)).alias("gates"), F.count_if(F.col("status") == "falha").alias("failed_gates")), quality.agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("affected_rows") > 0).alias("rules_with_rows")),
    )
    for part in parts:
        one = one.join(F.broadcast(part))  # one row each
    return one


def explained_correlations(correlations: DataFrame, index: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Correlations (target, feature, ...) with the first lineage record of either name: definitions and raw sources; aliases rename columns to looked-up names."""
    rank = F.array_position(F.array(F.lit("feature"), F.lit("csv_final"), F.lit("intermediario"), F.lit("bruto")), F.col("layer"))
    first = index.where("layer <> 'driver'").groupBy("column").agg(F.min(F.struct(rank.alias("r"), "table", "definition", "raw_sources")).alias("l"))
    name = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    out = correlations
    for side in ("feature", "target"):
        look = F.coalesce(F.try_element_at(name, F.col(side)), F.col(side)) if aliases else F.col(side)
        out = out.join(first.select(F.col("column").alias("__c"), F.col("l.definition").alias(f"{side}_definition"), F.col("l.raw_sources").alias(f"{side}_sources"), F.col("l.table").alias(f"{side}_table")), look == F.col("__c"), "left").drop("__c")
    return out


def first_rows_json(rows: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    """(keys, name): of each key the first limit rows, in the order of their JSON texts, as an array of them.

    A report's limit, 1000 at most. Spark keeps limit rows of a key in each task
    before the shuffle and after it (its window group limit), so that no key is
    sorted or held whole; a test looks for it in the plan.
    """
    text = rows.select(*keys, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("__json"))
    some = text.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__json"))).where(F.col("__n") <= min(limit, 1000))
    return some.groupBy(*keys).agg(F.sort_array(F.collect_list("__json")).alias(name))


def audit_index(timeline: DataFrame, events: DataFrame, pair_gaps: DataFrame, scenes: DataFrame, images: DataFrame, key: str = "season_id", pair: str = "comparison_pair", week: str = "week_start", most: int = 8, most_pairs: int = 4) -> DataFrame:
    """A row per timeline week with what its numbers rest on.

    audit_id, the week's columns, active_flags (columns named _flag that hold,
    and risk_flag_count if it is not 0, in the table's order), up to most event
    rows and raw scenes of the key and week, up to most_pairs gap rows of the
    pair and week, as JSON texts in order, and the image nearest to the week.
    images: (key, date, path). Rows of an unknown week have no rows beside them.
    """
    from furrow.operators.profile import nearest_row

    day = F.to_date(week).alias("__day")
    names = [c for c in timeline.columns if c.endswith("_flag") or c == "risk_flag_count"]
    kinds = dict(timeline.dtypes)
    on = lambda c: F.col(c) if kinds[c] == "boolean" else F.col(c).cast("double") != 0
    flags = F.filter(F.array(*[F.when(F.coalesce(on(c), F.lit(False)), F.lit(c)) for c in names]).cast("array<string>"), lambda x: x.isNotNull())
    out = timeline.withColumns({"audit_id": F.concat_ws(":", F.lit("audit"), F.col(key).cast("string"), F.date_format(week, "yyyy-MM-dd")), "active_flags": flags, "__day": F.to_date(week)})
    for rows, by, limit, name in ((events, key, most, "event_rows"), (scenes, key, most, "raw_rows"), (pair_gaps, pair, most_pairs, "pair_rows")):
        first = first_rows_json(rows.withColumn("__day", day), [by, "__day"], limit, name)
        out = out.join(first, [by, "__day"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return nearest_row(out, images.withColumnRenamed("date", "image_date"), key, "__day", "image_date", "path", "path").drop("__day")


def entity_index(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(entity_id, kind, label) of every table's entities; a table comes with its id and label columns."""
    parts = [df.select(F.concat_ws(":", F.lit(kind), F.col(i).cast("string")).alias("entity_id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label")).where("entity_id is not null") for kind, (df, i, label) in tables.items()]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["entity_id"])


def atlas_graph(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the index: sources feed columns, columns are of tables, features come from columns, final tables and hypotheses rest on them."""
    node = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    own = node("coluna", F.concat_ws(".", "table", "column"))
    each = lambda c, kind, relation, flip=False: index.select(F.explode(pipe_list(c)).alias("x"), own.alias("o")).select(*( (F.col("o").alias("src"), node(kind, F.col("x")).alias("dst")) if flip else (node(kind, F.col("x")).alias("src"), F.col("o").alias("dst"))), F.lit(relation).alias("relation"))  # noqa: E731,E201
    parts = [
        each("raw_sources", "fonte", "alimenta"), each("upstream_columns", "origem", "deriva"), each("downstream_csvs", "csv", "aparece_em", True), each("hypotheses", "hipotese", "sustenta", True),
        index.select(own.alias("src"), node("tabela", F.col("table")).alias("dst"), F.lit("pertence_a").alias("relation")),
    ]
    edges = reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null").distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("kind", F.substring_index("node", ":", 1))
    return nodes, edges
