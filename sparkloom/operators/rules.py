"""Row-rule engines: rules held as data, compiled to one projection.

A rule's condition is a SQL predicate; a missing measurement never makes one true. An engine gives each row additive
scores, lists of alerts and a severity by the first level whose condition holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(predicate: str) -> Column:
    """Whether a predicate is true; unknown is false."""
    return F.coalesce(F.expr(predicate), F.lit(False))


@dataclass
class Engine:
    """flags: name -> predicate; scores: name -> [(predicate, points)]; lists: name -> [(predicate, message)]; levels: [(level, predicate)], first wins.

    Scores are made first, then flags in their order, then lists; each may name what was made before.
    """

    scores: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)
    lists: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    levels: list[tuple[str, str]] = field(default_factory=list)
    otherwise: str = "low"

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column for each score, list and the severity; levels may name scores."""
        for name, parts in self.scores.items():
            rows = rows.withColumn(name, sum((F.when(holds(p), v).otherwise(0) for p, v in parts), F.lit(0)))
        for name, predicate in self.flags.items():
            rows = rows.withColumn(name, holds(predicate))
        for name, parts in self.lists.items():
            rows = rows.withColumn(name, F.array_compact(F.array(*(F.when(holds(p), F.lit(m)) for p, m in parts))))
        severity = F.lit(self.otherwise)
        for level, predicate in reversed(self.levels):
            severity = F.when(holds(predicate), level).otherwise(severity)
        return rows.withColumn("severity", severity)


def sql(engine: Engine, source: str, key: str) -> str:
    """The engine as SQL over ``source``, for checks."""
    case = lambda p, v: f"CASE WHEN coalesce(({p}), false) THEN {v} END"
    scores = [f"({' + '.join(f'coalesce({case(p, v)}, 0)' for p, v in parts)})::INT AS {n}" for n, parts in engine.scores.items()]
    lists = ["list_filter([" + ", ".join(case(p, "'" + m + "'") for p, m in parts) + f"], lambda x: x IS NOT NULL) AS {n}" for n, parts in engine.lists.items()]
    levels = " ".join(f"WHEN coalesce(({p}), false) THEN '{v}'" for v, p in engine.levels)
    names = ", ".join([*engine.scores, *engine.flags, *engine.lists])
    inner = f"SELECT *, {', '.join(scores)} FROM {source}" if scores else f"SELECT * FROM {source}"
    for n, p in engine.flags.items():
        inner = f"SELECT *, coalesce(({p}), false) AS {n} FROM ({inner})"
    inner = f"SELECT *, {', '.join(lists)} FROM ({inner})" if lists else inner
    return f"SELECT {key}, {names}, CASE {levels} ELSE '{engine.otherwise}' END AS severity FROM ({inner})"


#: Sepsis screen: one point each for breathing rate, blood pressure and mental state; actions while the first hour runs.
SEPSIS = Engine(
    scores={"qsofa": [("respiratory_rate >= 22", 1), ("systolic_bp <= 100", 1), ("altered", 1)]},
    lists={
        "alerts": [
            ("infection AND map < 65", "vasopressor"),
            ("lactate >= 4", "lactate_high"),
            ("lactate >= 2 AND lactate < 4", "lactate_raised"),
            ("infection AND minutes > 60", "antibiotic_late"),
        ]
    },
    levels=[("critical", "infection AND (map < 65 OR lactate >= 4)"), ("high", "infection AND qsofa >= 2"), ("medium", "qsofa >= 2 OR lactate >= 2")],
)

#: Bands of one measure, as the engines of kidney, blood and metabolism have them.
BANDED = Engine(
    scores={"stage": [("m >= 20", 1), ("m >= 40", 1), ("m >= 60", 1), ("m >= 80", 1)]},
    lists={"alerts": [("m >= 80", "escalate"), ("m >= 60 AND flag", "review"), ("m IS NULL", "missing")]},
    levels=[("critical", "stage >= 4"), ("high", "stage = 3"), ("medium", "stage BETWEEN 1 AND 2")],
)

#: Two additive scores of which the higher names the condition, unless both are below 2 or they are within 1.
ARGMAX = Engine(
    scores={
        "score_a": [("l_quantity > 25", 2), ("l_discount > 0.05", 1), ("l_returnflag = 'R'", 1)],
        "score_b": [("l_tax > 0.04", 2), ("l_linestatus = 'O'", 1), ("l_returnflag = 'N'", 1)],
    },
    lists={"red_flags": [("l_quantity > 48", "volume"), ("l_discount > 0.09 AND l_tax > 0.07", "terms")]},
    levels=[("undetermined", "(score_a < 2 AND score_b < 2) OR abs(score_a - score_b) <= 1"), ("a", "score_a > score_b")],
    otherwise="b",
)


# The rules of six engines, with the messages that they give.

SEPSIS_BUNDLE = Engine(
    scores={"qsofa": [("respiratory_rate >= 22", 1), ("systolic_bp <= 100", 1), ("altered", 1)]},
    flags={"high_risk": "infection AND qsofa >= 2", "shock": "lactate >= 4 OR (map < 65 AND vasopressor)"},
    lists={
        "bundle": [
            ("high_risk AND NOT coalesce(cultures, false)", "Extraer hemocultivos antes de antibiotico si no retrasa inicio."),
            ("high_risk AND NOT coalesce(antibiotics, false)", "Iniciar antibioterapia de amplio espectro en <1 hora."),
            ("high_risk AND coalesce(fluids, 0) < 30", "Completar fluidoterapia inicial hasta 30 ml/kg (cristaloides)."),
            ("high_risk AND lactate IS NULL", "Solicitar lactato inicial y planificar control seriado."),
            ("NOT high_risk", "Mantener reevaluacion clinica y vigilancia de disfuncion organica."),
        ],
        "escalation": [
            ("shock", "Escalar a circuito de shock septico y avisar equipo senior/UCI."),
            ("shock", "Objetivo PAM >=65 mmHg con noradrenalina si refractario a fluidos."),
            ("shock", "Monitorizar lactato y perfusion de forma estrecha."),
            ("minutes > 60", "Revisar demora del bundle de sepsis y corregir cuellos de botella."),
        ],
        "alerts": [
            ("NOT coalesce(infection, false)", "Sin infeccion sospechada: validar pertinencia del protocolo."),
            ("high_risk", "qSOFA >=2 con infeccion sospechada: alto riesgo de sepsis."),
            ("infection AND shock", "Criterios operativos compatibles con shock septico."),
            ("infection AND lactate > 2", "Lactato elevado: requiere reevaluacion y control de tendencia."),
            ("infection AND minutes > 60", "Ventana >60 min desde deteccion: riesgo de retraso terapeutico."),
        ],
    },
    levels=[("critical", "shock"), ("high", "high_risk"), ("medium", "qsofa >= 2")],
)

SCASEST = Engine(
    flags={
        "suspected": "(coalesce(chest_pain, false) OR coalesce(dyspnea, false) OR coalesce(syncope, false)) AND (coalesce(st_depression, false) OR coalesce(t_inversion, false) OR coalesce(troponin, false))",
        "high_risk": "suspected AND (coalesce(unstable, false) OR coalesce(arrhythmia, false) OR coalesce(refractory, false) OR coalesce(grace > 140, false))",
    },
    lists={
        "diagnosis": [
            ("NOT suspected", "Reevaluar diagnostico diferencial de dolor toracico."),
            ("suspected", "Realizar ECG seriado y monitorizacion continua."),
            ("suspected", "Solicitar troponinas seriadas y analitica basica."),
            ("suspected", "Solicitar radiografia de torax y valorar ecocardiograma temprano."),
        ],
        "treatment": [
            ("NOT suspected", "No activar tratamiento SCASEST hasta confirmacion clinica."),
            ("suspected AND NOT coalesce(no_antiplatelet, false)", "Valorar AAS carga inicial y segundo antiagregante segun protocolo."),
            ("suspected AND NOT coalesce(no_anticoagulation, false)", "Valorar anticoagulacion inicial (ej. fondaparinux) segun protocolo."),
            ("suspected", "Valorar nitratos y control de sintomas isquemicos."),
            ("suspected AND heart_rate > 60", "Valorar betabloqueo si no hay contraindicaciones hemodinamicas."),
        ],
        "escalation": [
            ("high_risk", "Escalar a circuito coronario urgente y avisar cardiologia."),
            ("high_risk", "Priorizar cama monitorizada/UCI coronaria segun estabilidad."),
            ("NOT high_risk AND grace IS NOT NULL", "Estratificar destino segun GRACE y evolucion clinica."),
        ],
        "alerts": [
            ("NOT suspected", "SCASEST no claramente soportado por datos actuales."),
            ("high_risk", "SCASEST de alto riesgo: no demorar escalado invasivo."),
            ("suspected AND unstable", "Inestabilidad hemodinamica detectada."),
            ("suspected AND arrhythmia", "Arritmias ventriculares: riesgo de deterioro inmediato."),
            ("suspected AND oxygen < 90", "Hipoxemia significativa: corregir oxigenacion de inmediato."),
        ],
    },
    levels=[("high", "high_risk"), ("medium", "suspected")],
)

RESPIRATORY = Engine(
    flags={
        "vulnerable": "age >= 65 OR coalesce(immunosuppressed, false) OR coalesce(comorbidities, 0) > 0 OR vaccinated = false",
        "relative_shock": "baseline_bp >= 140 AND current_bp <= 110",
    },
    lists={
        "diagnosis": [
            ("antigen = 'no_realizado'", "Realizar test de antigeno respiratorio en triaje."),
            ("antigen = 'negativo' AND (vulnerable OR coalesce(needs_oxygen, false))", "Escalar a PCR / tecnica molecular multiple por alto riesgo."),
            ("pathogen = 'vrs' AND antigen = 'negativo'", "Para VRS en adulto: usar muestra combinada (saliva + exudado nasofaringeo)."),
        ],
        "antiviral": [
            ("pathogen = 'covid' AND needs_oxygen", "Valorar Remdesivir IV 5-10 dias por cuadro grave."),
            ("pathogen = 'covid' AND NOT coalesce(needs_oxygen, false) AND vulnerable AND onset_hours <= 120 AND no_oral", "Valorar Remdesivir IV 3 dias por contraindicación de antiviral oral."),
            ("pathogen = 'covid' AND NOT coalesce(needs_oxygen, false) AND vulnerable AND onset_hours <= 120 AND NOT coalesce(no_oral, false)", "Valorar Nirmatrelvir/Ritonavir VO 5 dias (<5 dias de inicio)."),
            ("pathogen = 'covid' AND NOT coalesce(needs_oxygen, false) AND vulnerable AND onset_hours > 120 AND onset_hours <= 168", "Valorar Remdesivir IV 3 dias (<7 dias de inicio)."),
            ("pathogen = 'gripe' AND needs_oxygen", "Iniciar Oseltamivir precozmente; objetivo operativo ideal <6h desde llegada."),
            ("pathogen = 'gripe' AND NOT coalesce(needs_oxygen, false) AND vulnerable AND onset_hours <= 48", "Iniciar Oseltamivir en ventana <48h."),
            ("pathogen = 'vrs'", "No hay antiviral estandar de urgencias; priorizar soporte y vigilancia estrecha."),
        ],
        "isolation": [
            ("pathogen = 'covid'", "Aplicar control de aerosoles estricto y mascarilla."),
            ("pathogen = 'covid'", "Minimizar estancia en zonas congestionadas y reforzar ventilacion."),
            ("pathogen = 'gripe'", "Aplicar aislamiento respiratorio segun protocolo local."),
            ("pathogen = 'vrs'", "Aislar de forma activa para prevenir transmision nosocomial en mayores."),
        ],
    },
    levels=[("high", "relative_shock OR needs_oxygen"), ("medium", "vulnerable")],
)

PITYRIASIS = Engine(
    scores={
        "versicolor": [
            ("age BETWEEN 15 AND 45", 1), ("site IN ('torax', 'espalda', 'areas_seborreicas', 'tronco')", 2), ("fine_scaling", 1), ("scratch_sign", 3),
            ("wood = 'amarillo_naranja'", 2), ("koh = 'positivo_spaghetti_albondigas'", 4), ("recurrent", 1), ("colour IN ('hipocromica', 'hipercromica', 'mixta')", 1),
        ],
        "rosada": [
            ("herald_patch", 3), ("tree_pattern", 3), ("prodrome", 1), ("site IN ('tronco', 'torax', 'espalda')", 1), ("itch >= 4", 1), ("age BETWEEN 10 AND 35", 1),
            ("koh = 'positivo_spaghetti_albondigas'", -2),
        ],
        "alba": [("age < 16", 3), ("site IN ('cara', 'extremidades_superiores')", 2), ("colour = 'hipocromica'", 2), ("fine_scaling", 1), ("atopic", 1), ("recurrent", 1)],
    },
    lists={
        "red_flags": [
            ("sensory_loss", "Perdida de sensibilidad en lesion: descartar lepra tuberculoide con prioridad."),
            ("warm_pain", "Eritema doloroso/caliente profundo: descartar celulitis o erisipela."),
            ("systemic AND warm_pain", "Signos sistemicos con foco cutaneo doloroso: valorar antibioticoterapia sistemica urgente."),
        ]
    },
    levels=[
        ("indeterminado", "greatest(versicolor, rosada, alba) < 3"),
        ("indeterminado", "greatest(versicolor, rosada, alba) - (versicolor + rosada + alba - greatest(versicolor, rosada, alba) - least(versicolor, rosada, alba)) <= 1"),
        ("versicolor", "versicolor = greatest(versicolor, rosada, alba)"),
        ("rosada", "rosada = greatest(versicolor, rosada, alba)"),
    ],
    otherwise="alba",
)

ACNE_ROSACEA = Engine(
    scores={
        "acne": [
            ("comedones", 4), ("pattern IN ('polimorfo', 'nodulo_quistico')", 2), ("site IN ('torax', 'espalda')", 2), ("hyperandrogenism AND sex = 'femenino'", 1),
            ("coalesce(flushing, false) OR coalesce(telangiectasias, false)", -1),
        ],
        "rosacea": [
            ("NOT coalesce(comedones, false)", 2), ("flushing", 2), ("telangiectasias", 2), ("coalesce(triggers, false) OR coalesce(photosensitive, false)", 1),
            ("site IN ('mejillas', 'nariz', 'frente', 'menton')", 1), ("ocular", 1), ("phymatous", 2),
        ],
    },
    lists={
        "red_flags": [
            ("severe_nodules AND systemic AND raised_markers", "Sospecha de acne fulminans: priorizar valoracion dermatologica urgente."),
            ("phymatous", "Rosacea fimatosa: valorar derivacion para manejo quirurgico/laser especializado."),
            ("ocular", "Rosacea ocular probable: coordinar valoracion oftalmologica precoz."),
        ]
    },
    levels=[("indeterminado", "(acne < 2 AND rosacea < 2) OR abs(acne - rosacea) <= 1"), ("acne", "acne > rosacea")],
    otherwise="rosacea",
)

CARDIO_RISK = Engine(
    scores={
        "score": [
            ("age >= 75", 4), ("age >= 65 AND age < 75", 3), ("age >= 55 AND age < 65", 2), ("age >= 45 AND age < 55", 1), ("smoker", 2),
            ("systolic_bp >= 160", 2), ("systolic_bp >= 140 AND systolic_bp < 160", 1), ("non_hdl >= 220", 3), ("non_hdl >= 190 AND non_hdl < 220", 2),
            ("non_hdl >= 160 AND non_hdl < 190", 1), ("apob >= 130", 2), ("apob >= 100 AND apob < 130", 1), ("diabetes", 2), ("kidney_disease", 2),
            ("family_history", 1), ("inflammatory", 1),
        ]
    },
    levels=[("very_high", "coalesce(established, false) OR score >= 10"), ("high", "score >= 7"), ("moderate", "score >= 4")],
)
#: Of each level of cardiovascular risk the ten-year risk in percent and the LDL target; the non-HDL target is 30 above.
CARDIO_LEVELS = {"low": (4.0, 116), "moderate": (9.0, 100), "high": (18.0, 70), "very_high": (30.0, 55)}


def cardio_plan(scored: DataFrame) -> DataFrame:
    """``scored`` rows of ``CARDIO_RISK`` with risk, targets, and whether habits must change and a drug is suggested."""
    level = F.col("severity")
    pick = lambda i: F.coalesce(*(F.when(level == n, F.lit(v[i])) for n, v in CARDIO_LEVELS.items()))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = scored.withColumn("risk_percent", pick(0)).withColumn("ldl_target", pick(1)).withColumn("non_hdl_target", F.col("ldl_target") + 30)
    above, grave = F.coalesce(F.col("non_hdl") > F.col("non_hdl_target"), F.lit(False)), level.isin("high", "very_high")
    drug = grave | yes("established") | (yes("diabetes") & above) | F.coalesce(F.col("non_hdl") >= 190, F.lit(False))
    return rows.select("*", (grave | yes("smoker") | yes("diabetes") | above).alias("intensive_lifestyle"), drug.alias("drug_suggested"))


def toxic_threshold(hours: Column) -> Column:
    """The treatment line: 150 up to four hours, then 6.25 less an hour, 25 from twenty-four on."""
    return F.when(hours <= 4, 150.0).when(hours >= 24, 25.0).otherwise(150.0 - 6.25 * (hours - 4))
