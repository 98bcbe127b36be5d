"""Texts of the trial: evidence by pair, diagnostics, outlook notes, hypotheses, decisions and known gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import fixed, flag
from furrow.operators.evidence import lowered, status_of, strength
from furrow.operators.pairs import SIDES
from furrow.operators.windows import first_rows

# Column, label, unit, least difference and whether more is better, of the inventory's and of the timeline's evidence.
INVENTORY_EVIDENCE = (
    ("ndvi_mean", "NDVI medio da safra", "", 0.02, True),
    ("harvest_yield_mean_kg_ha", "Produtividade de colheita", " kg/ha", 100.0, True),
    ("avg_pest_count", "Pressao media de pragas", " insetos", 2.0, False),
    ("overlap_area_pct_bbox", "Sobreposicao operacional por area", " ha/ha", 0.01, False),
    ("stop_duration_h_per_bbox_ha", "Horas de parada por area", " h/ha", 0.05, False),
    ("fert_dose_gap_abs_mean_kg_ha", "Conformidade media de dose em adubacao", " kg/ha", 10.0, False),
)
TIMELINE_EVIDENCE = (
    ("ndvi_mean_season", "NDVI medio semanal", "", 0.02, True),
    ("ndvi_peak", "Pico de NDVI", "", 0.03, True),
    ("ndvi_norm_last", "Condicao NDVI nas semanas finais", " norm", 0.08, True),
    ("ndvi_auc_last", "Area sob a curva do NDVI", " auc", 5.0, True),
    ("major_drop_weeks", "Semanas de queda relevante", " sem", 1.0, False),
    ("low_vigor_weeks", "Semanas de baixo vigor", " sem", 1.0, False),
    ("pest_risk_weeks", "Semanas com risco de praga", " sem", 1.0, False),
    ("ops_risk_weeks", "Semanas com risco operacional", " sem", 1.0, False),
)
# Texts where there is nothing to say.
NO_SUPPORT = ("Sem evidencia clara favoravel ao 4.0.", "Sem evidencia clara favoravel ao convencional.")
NO_TIMELINE_SUPPORT = ("Sem vantagem temporal clara do 4.0 no NDVI.", "Sem vantagem temporal clara do convencional no NDVI.")
NO_GAPS, NO_GAPS_KNOWN = "Sem lacunas adicionais alem das gerais da fase 1.", "Sem gaps adicionais registrados."
NO_DRIVER, NO_RISK = "Sem driver forte observado no pacote atual.", "Sem risco dominante alem dos limites gerais do pacote."
# Known gaps of a pair.
GAP_YIELD = "Produtividade consolidada ausente em um dos lados do par."
GAP_TRAPS = "MIIP sem cobertura nos dois lados do par; comparacao de pragas fica parcial."
GAP_TRAP_DAYS = "MIIP com cobertura muito desigual entre as areas do par."
GAP_WEATHER = "Parte da serie NDVI deste par nao tem cobertura local de clima."
GAP_SOIL = "Solo disponivel apenas como contexto; sem chave espacial completa por talhao."
GAP_MAPPING = "Existe area sem mapeamento oficial consolidado."
GAP_NO_YIELD = "Nao ha produtividade consolidada suficiente para este par."
# Actions by the risks that call for them, in order.
ACTIONS = (
    (("pressao_de_praga",), "Reforcar validacao agronomica e resposta MIIP nas janelas com limiares."),
    (("risco_operacional", "quedas_relevantes_de_ndvi"), "Revisar calibracao, sobreposicao, paradas e aderencia operacional nas semanas de queda."),
    (("telemetria_instavel",), "Tratar falhas de comunicacao e alarmes para nao degradar a capacidade de monitorar."),
    (("baixo_vigor_recorrente",), "Inspecionar estande, solo exposto e manejo localizado nas faixas de menor vigor."),
    (("estresse_climatico",), "Separar o efeito do clima do efeito de manejo ao interpretar a diferenca de NDVI."),
)
NO_ACTION = "Manter monitoramento semanal e validar em campo os sinais de NDVI antes de conclusao forte."
# The columns of an event.
EVENT_COLUMNS = (
    "season_id", "week_start", "area_label", "treatment", "crop_type", "comparison_pair", "phase", "event_type", "ndvi_mean_week", "ndvi_delta_week", "ndvi_norm_week", "pair_ndvi_gap_4_0_minus_conv", "pair_position",
    "precipitation_mm_week", "water_balance_mm_week", "avg_pest_count_week", "alert_hits_week", "damage_hits_week", "fert_dose_gap_abs_mean_kg_ha_week", "overlap_area_pct_bbox_week", "stop_duration_h_per_bbox_ha_week",
    "invalid_telemetry_share_week", "alarm_events_week", "param_alert_events_week", "primary_driver", "secondary_driver", "drivers_summary", "story_sentence",
)
# Hypotheses by id.
HYPOTHESES = {
    "H1": "4.0 sustenta maior nivel temporal de NDVI no par.",
    "H2": "4.0 reduz semanas de problema no NDVI.",
    "H3": "As semanas problema do NDVI apresentam drivers identificaveis no pacote atual.",
    "H4": "O outlook pre-colheita favorece o 4.0 dentro do par.",
}


def listed(items: list[Column], none: str, separator: str = " | ") -> Column:
    """The items that are known, joined; the text none without any."""
    kept = F.filter(F.array(*items), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, separator)).otherwise(none)


def number(c: Column | str) -> Column:
    """A number with three decimals, NA if it is unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "NA").otherwise(fixed(c, 3))


def sides_of(df: DataFrame, columns: list[str], pair: str = "comparison_pair", order: str = "area_label") -> DataFrame:
    """A row per pair with the first row of each side as structs tech and conv; null for a side that it lacks."""
    some = [c for c in columns if c in df.columns]
    held = F.struct(*[F.col(c).cast("double").alias(c) for c in some])
    first = lambda s: F.min_by(F.when(F.col("treatment") == s, held), F.when(F.col("treatment") == s, F.coalesce(F.col(order).cast("string"), F.lit("￿"))))
    return df.groupBy(pair).agg(first(SIDES[0]).alias("tech"), first(SIDES[1]).alias("conv"))


def supports(wide: DataFrame, evidence: tuple, columns: list[str]) -> tuple[list[Column], list[Column], Column]:
    """Texts of what speaks for either side of wide (tech, conv), and how many there are; a metric that a side lacks says nothing."""
    for_tech, for_conv, count = [], [], F.lit(0)
    for column, label, unit, least, higher in evidence:
        if column not in columns:
            continue
        change = F.col(f"tech.{column}") - F.col(f"conv.{column}")
        speaks = flag(F.abs(change) >= least)
        tech_leads = flag((change > 0) if higher else (change <= 0))
        text = lambda side, c=change, label=label, unit=unit: F.format_string(f"{label}: {side} leva vantagem (%s{unit}).", fixed(c, 2, signed=True))
        for_tech.append(F.when(speaks & tech_leads, text("4.0")))
        for_conv.append(F.when(speaks & ~tech_leads, text("convencional")))
        count = count + speaks.cast("int")
    return for_tech, for_conv, count


def unequal(a: Column, b: Column, ratio: float = 2.0) -> Column:
    """Whether the greater of two known positive numbers is at least so many times the lesser."""
    low = F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
    return flag((low > 0) & (F.greatest(a, b) / low >= ratio))


def hypothesis_matrix_texts(inventory: DataFrame, features: DataFrame) -> DataFrame:
    """(pair, evidence_strength, supports_4_0, supports_convencional, known_gaps) of the season's inventory and weekly features.

    A pair without both sides has no evidence. Strength falls by a step for a
    yield or trap count that one side alone has, by more for both.
    """
    columns = [c for c, *_ in INVENTORY_EVIDENCE if c in inventory.columns] + [c for c in ("miip_days",) if c in inventory.columns]
    wide = sides_of(inventory, columns)
    both = F.col("tech").isNotNull() & F.col("conv").isNotNull()
    tech, conv, count = supports(wide, INVENTORY_EVIDENCE, columns)
    one_sided = lambda c: both & (F.col(f"tech.{c}").isNull() != F.col(f"conv.{c}").isNull()) if c in columns else F.lit(False)
    no_yield, no_traps = one_sided("harvest_yield_mean_kg_ha"), one_sided("avg_pest_count")
    days = both & unequal(F.col("tech.miip_days"), F.col("conv.miip_days")) if "miip_days" in columns else F.lit(False)
    whole = inventory.groupBy("comparison_pair").agg(
        (F.coalesce(F.max("soil_samples_available"), F.lit(0)) <= 8).alias("little_soil"), F.coalesce(F.bool_or(F.contains(F.col("mapping_source"), F.lit("auto_missing"))), F.lit(False)).alias("unmapped"),
        (F.count("harvest_yield_mean_kg_ha") == 0).alias("yieldless"),
    )
    weather = features.groupBy("comparison_pair").agg(F.bool_and(flag(F.col("has_weather_coverage_week").cast("boolean"))).alias("covered"))
    wide = wide.join(whole, "comparison_pair").join(weather, "comparison_pair", "left")
    gaps = [
        F.when(no_yield, GAP_YIELD), F.when(no_traps, GAP_TRAPS), F.when(days, GAP_TRAP_DAYS), F.when(flag(~F.col("covered")), GAP_WEATHER), F.when(F.col("little_soil"), GAP_SOIL), F.when(F.col("unmapped"), GAP_MAPPING),
        F.when(F.col("yieldless"), GAP_NO_YIELD),
    ]
    return wide.select(
        F.col("comparison_pair").alias("pair"), lowered(strength(count, 4, 2), no_yield.cast("int") + no_traps.cast("int")).alias("evidence_strength"), listed(tech, NO_SUPPORT[0]).alias("supports_4_0"),
        listed(conv, NO_SUPPORT[1]).alias("supports_convencional"), listed(gaps, NO_GAPS).alias("known_gaps"),
    )


def with_story(timeline: DataFrame) -> DataFrame:
    """The phase timeline with drivers_summary and a sentence for each week."""
    drivers = F.when(F.size("driver_candidates") > 0, F.array_join(F.slice("driver_candidates", 1, 3), " | ")).otherwise(NO_DRIVER)
    timeline = timeline.withColumn("drivers_summary", drivers)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    signed = F.when(F.col("ndvi_delta_week").isNull(), "NA").otherwise(fixed("ndvi_delta_week", 3, signed=True))
    sentence = F.concat(
        F.coalesce(F.date_format("week_start", "yyyy-MM-dd"), F.lit("sem_data")), F.lit(": "), known("area_label"), F.lit(" ficou em fase "), known("phase"), F.lit(", evento "), F.coalesce("event_type", F.lit("sem_evento")),
        F.lit(", NDVI "), number("ndvi_mean_week"), F.lit(" com delta "), signed, F.lit("; posicao "), known("pair_position"), F.lit("; drivers provaveis: "), F.col("drivers_summary"),
    )
    return timeline.withColumn("story_sentence", sentence)


def events(timeline: DataFrame) -> DataFrame:
    """The weeks with an event, in those of EVENT_COLUMNS that there are."""
    return timeline.where("event_type is not null").select(*[c for c in EVENT_COLUMNS if c in timeline.columns])


def pair_diagnostics(summary: DataFrame, matrix: DataFrame) -> DataFrame:
    """Per pair who leads the season's trajectory, how strong the evidence is, and in what; summary is that of each field's timeline."""
    columns = [c for c, *_ in TIMELINE_EVIDENCE if c in summary.columns]
    tech, conv, count = supports(summary, TIMELINE_EVIDENCE, columns)
    cover = summary.groupBy("comparison_pair").agg(F.avg("weather_coverage_share").alias("cover"))
    wide = sides_of(summary, columns).join(cover, "comparison_pair").join(matrix.select(F.col("pair").alias("comparison_pair"), "known_gaps"), "comparison_pair", "left")
    n_tech, n_conv = (sum((c.isNotNull().cast("int") for c in x), F.lit(0)) for x in (tech, conv))
    level = strength(count, 6, 3)
    level = F.when(flag(F.col("cover") < 0.5) & (level == "alta"), "media").when(flag(F.col("cover") < 0.5) & (level == "media"), "baixa").otherwise(level)
    leader = F.when(n_tech > n_conv, "4.0").when(n_conv > n_tech, "convencional").otherwise("sem vantagem clara")
    wide = wide.withColumns({"trajectory_evidence_strength": level, "trajectory_winner": leader, "n": n_tech + n_conv, "a": listed(tech, NO_TIMELINE_SUPPORT[0]), "b": listed(conv, NO_TIMELINE_SUPPORT[1])})
    said = lambda text: F.format_string(f"No par %s, {text}", F.col("comparison_pair"))
    reading = (
        F.when(F.col("trajectory_winner").isin("4.0", "convencional"), F.format_string("No par %s, o %s mostra vantagem temporal de NDVI com evidencia %s.", "comparison_pair", "trajectory_winner", "trajectory_evidence_strength"))
        .when(F.col("n") > 0, said("os sinais de NDVI seguem mistos e nao fecham um vencedor unico.")).otherwise(said("ainda nao ha diferenca temporal forte de NDVI."))
    )
    return wide.select(
        F.col("comparison_pair").alias("pair"), "trajectory_evidence_strength", "trajectory_winner", F.col("a").alias("supports_4_0"), F.col("b").alias("supports_convencional"), reading.alias("ndvi_interpretation"),
        F.coalesce("known_gaps", F.lit(NO_GAPS_KNOWN)).alias("known_gaps"),
    )


def outlook_texts(outlook: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The outlook with its risks as text, what to expect of the harvest, actions, and the pair's reading."""
    area = F.coalesce(F.col("area_label").cast("string"), F.lit("None"))
    note = (
        F.when(F.col("expected_vs_pair") == "tende_a_chegar_acima_do_par", F.concat(area, F.lit(" tende a chegar a colheita em condicao relativa superior no par, mantendo o perfil recente de NDVI.")))
        .when(F.col("expected_vs_pair") == "tende_a_chegar_abaixo_do_par", F.concat(area, F.lit(" tende a chegar a colheita em condicao relativa inferior no par se o padrao recente de NDVI persistir.")))
        .otherwise(F.concat(area, F.lit(" nao mostra vantagem clara no par; a leitura atual e "), F.coalesce("latest_phase", F.lit("None")), F.lit(" com evento recente "), F.coalesce("latest_event", F.lit("sem evento forte")), F.lit(".")))
    )
    wanted = F.filter(F.array(*[F.when(F.arrays_overlap("top_risks", F.array(*map(F.lit, risks))), text) for risks, text in ACTIONS]), lambda x: x.isNotNull())
    actions = F.when(F.size(wanted) > 0, F.array_join(F.slice(wanted, 1, 3), " | ")).otherwise(NO_ACTION)
    risks = F.when(F.size("top_risks") > 0, F.array_join("top_risks", " | ")).otherwise(NO_RISK)
    context = diagnostics.select(F.col("pair").alias("comparison_pair"), F.col("ndvi_interpretation").alias("pair_context"))
    out = outlook.join(context, "comparison_pair", "left").withColumns({"expected_harvest_note": note, "recommended_actions": actions, "pair_context": F.coalesce("pair_context", F.lit("Sem leitura comparativa adicional."))})
    return out.withColumn("top_risks", risks)


def _basis(metric: str) -> Column:
    m = lambda c: F.col(f"{metric}.{c}")
    text = F.concat(m("metric_label"), F.lit(": vantagem_4_0="), number(m("advantage_4_0")), F.lit(", IC95% ["), number(m("ci_low")), F.lit(", "), number(m("ci_high")), F.lit("], p="), number(m("p_value")), F.lit(", evidencia="), m("evidence_level"), F.lit("."))
    return F.when(F.col(metric).isNull(), "Sem base suficiente.").otherwise(text)


def _metrics(effects: DataFrame) -> DataFrame:
    """Per pair the effects of vigor, low vigor and drops as structs."""
    row = F.struct("metric_label", "advantage_4_0", "ci_low", "ci_high", "p_value", "winner", "evidence_level")
    names = {"vigor": "NDVI medio semanal", "low": "Semanas de baixo vigor", "drop": "Semanas de queda relevante"}
    return effects.groupBy("comparison_pair").agg(*[F.first(F.when(F.col("metric_label") == label, row), ignorenulls=True).alias(n) for n, label in names.items()])


def _joined(diagnostics: DataFrame, effects: DataFrame, lift: DataFrame, outlook: DataFrame) -> DataFrame:
    top = first_rows(lift, ["comparison_pair"], [F.desc("delta_pp"), F.asc("driver")]).select("comparison_pair", F.struct("driver", "delta_pp", "lift_ratio", "evidence_level").alias("lift"))
    treated = outlook.where(F.col("treatment") == SIDES[0]).groupBy("comparison_pair").agg(F.min_by(F.struct("trajectory_score", "outlook_band", "expected_vs_pair", "top_risks"), F.struct(-F.col("trajectory_score"))).alias("ahead"))
    base = diagnostics.withColumnRenamed("pair", "comparison_pair")
    return base.join(_metrics(effects), "comparison_pair", "left").join(top, "comparison_pair", "left").join(treated, "comparison_pair", "left")


def register(effects: DataFrame, lift: DataFrame, outlook: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Four hypotheses a pair with status, what the status rests on, and known limits."""
    wide = _joined(diagnostics, effects, lift, outlook)
    state = lambda m: F.coalesce(status_of(F.col(f"{m}.winner")), F.lit("inconclusiva"))
    yes, no = ((state("low") == s) | (state("drop") == s) for s in ("suportada", "nao_suportada"))
    problem = F.when(yes & no, "parcialmente_suportada").when(yes, "suportada").when(no, "nao_suportada").otherwise("inconclusiva")
    driver = F.when(flag(F.col("lift.evidence_level").isin("alta", "media") & (F.col("lift.delta_pp") > 0)), "suportada").otherwise("inconclusiva")
    seen = F.col("ahead.expected_vs_pair")
    ahead = F.when(seen == "tende_a_chegar_acima_do_par", "suportada").when(seen == "tende_a_chegar_abaixo_do_par", "nao_suportada").otherwise("inconclusiva")
    lift_basis = F.when(F.col("lift").isNull(), "Sem lift relevante de drivers.").otherwise(
        F.concat(F.lit("Driver dominante: "), F.col("lift.driver"), F.lit(" com delta="), number(F.col("lift.delta_pp")), F.lit(" pp, lift="), number(F.col("lift.lift_ratio")), F.lit(", evidencia="), F.col("lift.evidence_level"), F.lit("."))
    )
    ahead_basis = F.when(F.col("ahead").isNull(), "Sem outlook 4.0 disponivel.").otherwise(
        F.concat(F.lit("Outlook 4.0: score="), number(F.col("ahead.trajectory_score")), F.lit(", faixa="), F.col("ahead.outlook_band"), F.lit(", esperado="), seen, F.lit(", riscos="), F.col("ahead.top_risks").cast("string"), F.lit("."))
    )
    found = {"H1": (state("vigor"), _basis("vigor")), "H2": (problem, F.concat_ws(" | ", _basis("low"), _basis("drop"))), "H3": (driver, lift_basis), "H4": (ahead, ahead_basis)}
    rows = F.array(*[F.struct(F.lit(h).alias("hypothesis_id"), F.lit(HYPOTHESES[h]).alias("hypothesis"), s.alias("status"), b.alias("proof_basis")) for h, (s, b) in found.items()])
    return wide.select("comparison_pair", "known_gaps", F.explode(rows).alias("r")).select("comparison_pair", "r.*", F.col("known_gaps").alias("known_limits"))


def decisions(effects: DataFrame, lift: DataFrame, outlook: DataFrame, diagnostics: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Per pair who leads, by how much, the driver behind problem weeks, hypotheses that hold and fail, and what they say."""
    counts = hypotheses.groupBy("comparison_pair").agg(F.count_if(F.col("status") == "suportada").alias("supported_hypotheses"), F.count_if(F.col("status") == "nao_suportada").alias("not_supported_hypotheses"))
    wide = _joined(diagnostics, effects, lift, outlook).join(counts, "comparison_pair", "left")
    driver = F.coalesce("lift.driver", F.lit("sem_driver_forte"))
    seen = F.col("ahead.expected_vs_pair")
    shown = F.coalesce(seen, F.lit("<NA>"))
    lead = F.when(F.col("vigor.winner") == "favorece_convencional", "o convencional segue a referencia temporal de NDVI").when(F.col("vigor.winner") == "favorece_4_0", "o 4.0 sustenta vantagem temporal de NDVI").otherwise("o NDVI ainda nao fecha vencedor estatistico")
    message = F.concat(F.lit("No par "), F.col("comparison_pair"), F.lit(", "), lead, F.lit("; o principal bloco de risco associado e "), driver, F.lit("; o outlook 4.0 atual e "), shown, F.lit("."))
    step = (
        F.when(seen == "tende_a_chegar_abaixo_do_par", F.concat(F.lit("Priorizar plano corretivo em "), driver, F.lit(" e reavaliar a aderencia operacional do 4.0 no par "), F.col("comparison_pair"), F.lit(".")))
        .when(seen == "tende_a_chegar_acima_do_par", F.concat(F.lit("Preservar a consistencia operacional e monitorar "), driver, F.lit(" para confirmar a vantagem pre-colheita no par "), F.col("comparison_pair"), F.lit(".")))
        .otherwise(F.concat(F.lit("Coletar mais cobertura e revisar "), driver, F.lit(" antes de fechar conclusao executiva no par "), F.col("comparison_pair"), F.lit(".")))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wide.select(
        "comparison_pair", F.col("trajectory_winner").alias("temporal_winner"), F.col("vigor.winner").alias("ndvi_effect_direction"), F.col("vigor.advantage_4_0").alias("ndvi_effect_value"), driver.alias("top_problem_driver"),
        zero("supported_hypotheses"), zero("not_supported_hypotheses"), seen.alias("expected_vs_pair_4_0"), message.alias("decision_message"), step.alias("next_step"),
    )


def season_gaps(scenes: DataFrame, weather_daily: DataFrame, soil: DataFrame, ops: DataFrame | None, sources: set[str], timeline: DataFrame | None = None) -> list[str]:
    """Known gaps of a season, each once, in order; sources names what the drop holds. A handful of scalars come to the driver."""
    out = []
    first = scenes.agg(F.min(F.to_date("date"))).first()[0]
    weather = weather_daily.agg(F.min(F.to_date("date"))).first()[0]
    if first and weather and first < weather:
        out.append(f"Clima local cobre apenas de {weather:%Y-%m-%d} em diante; agosto a outubro de 2025 ficaram sem meteo local.")
    if soil.count() <= 8:
        out.append("Solo local tem apenas 8 amostras e nao oferece cobertura espacial completa por talhao.")
    if not {"pest_list", "pest_details", "traps_events"} <= sources:
        out.append("Pacote local de MIIP esta incompleto para uma leitura biologica completa.")
    if ops is not None and "spray_pressure_active_share" in ops.columns and ops.agg(F.coalesce(F.bool_and(F.coalesce("spray_pressure_active_share", F.lit(0.0)) == 0), F.lit(True))).first()[0]:
        out.append("A camada de pressao de pulverizacao veio zerada no pacote atual; use apenas como indicio de indisponibilidade.")
    out.append("A vinculacao espacial com os talhoes continua aproximada pelo bbox do NDVI, nao por limite vetorial oficial do talhao.")
    if timeline is not None:
        if not {"alarm", "param_alert"} <= sources:
            out.append("Camadas de alarmes operacionais nao vieram completas; a atribuicao de risco operacional fica parcial.")
        if "telemetry" not in sources:
            out.append("Sem telemetria de comunicacao; nao da para medir perda de qualidade de monitoramento em todas as semanas.")
        share = timeline.agg(F.avg(flag(F.col("has_weather_coverage_week").cast("boolean")).cast("double"))).first()[0]
        if share is not None and share < 0.5:
            out.append("Menos da metade das semanas NDVI tem clima local associado; leituras clima->NDVI continuam parciais.")
        out += [
            "Sem GeoTIFF numerico original, a inspeção visual usa JPG e a prova quantitativa continua limitada aos metadados do NDVI.",
            "Sem colheita final consolidada, esta fase entrega expectativa pré-colheita e nao prova produtiva final.",
        ]
    return list(dict.fromkeys(out))
