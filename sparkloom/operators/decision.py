"""What a question says of risk: perceived intensity of pain, vital signs, warning words, and how to speak of it; facts of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .learn import fechner, logistic_risk

#: How questions name pain, blood pressure, saturation and potassium.
PAIN_RANGE = r"(?i)(?:dolor|escala)\s*(?:de\s*)?(\d{1,2})\s*(?:a|-)\s*(\d{1,2})(?:\s*/\s*10)?"
PAIN_LEVEL = r"(?i)(?:dolor(?:\s*(?:nivel|intensidad))?\s*)(\d{1,2})(?:\s*/\s*10)?"
PRESSURE = r"(?i)(?:\bta\b|tension arterial)\s*[:=]?\s*(\d{2,3})\s*/\s*(\d{2,3})"
SATURATION = r"(?i)(?:\bsat(?:o2)?\b|\bspo2\b)\s*[:=]?\s*(\d{2,3})%?"
POTASSIUM = r"(?i)\bk(?:\s*\+)?\s*[:=]?\s*(\d+(?:[.,]\d+)?)"
RED_FLAGS = (
    "shock", "inestable", "inestabilidad", "anuria", "oliguria", "disnea intensa", "convulsion", "hemorragia", "hemorragico", "cefalea intensa", "fosfenos",
)
#: The least risk of each level, its name and its frame.
LEVELS = ((0.60, "high", "loss_avoidance_critical"), (0.35, "medium", "loss_avoidance_moderate"), (0.0, "low", "gain_focus_monitoring"))
MOST_SIGNALS = 8

#: Fixed values of the model of risk: each feature's median, mean, deviation and weight; the bias; the least probability of each priority.
RISK_MODEL = {
    "systolic_bp": (118.0, 118.0, 18.0, -0.65),
    "potassium": (4.1, 4.2, 0.8, 0.95),
    "creatinine": (1.0, 1.1, 0.7, 0.72),
    "oliguria_flag": (0.0, 0.1, 0.3, 0.88),
    "qrs_wide_flag": (0.0, 0.05, 0.2, 0.91),
    "fever_flag": (0.0, 0.2, 0.4, 0.36),
    "neutropenia_flag": (0.0, 0.08, 0.27, 0.64),
    "hypoxemia_flag": (0.0, 0.15, 0.36, 0.77),
}
RISK_BIAS, HIGH_RISK, MEDIUM_RISK = -0.2, 0.75, 0.45
#: How folded texts name the features.
NAMED = {
    "systolic_bp": r"\b(?:ta|tas)\s*[:=]?\s*(\d{2,3})(?:\s*/\s*(\d{2,3}))?",
    "potassium": r"\b(?:k|potasio)\s*[:=]?\s*(\d+(?:[.,]\d+)?)",
    "creatinine": r"\bcreatinina(?:\s*(?:actual|act))?\s*[:=]?\s*(\d+(?:[.,]\d+)?)",
}
SATURATED, LOW_SATURATION = r"\b(?:sat(?:o2)?|saturacion)\s*[:=]?\s*(\d{2,3})", 92
FLAGGED = {"oliguria_flag": ("oliguria", "anuria"), "qrs_wide_flag": ("qrs ancho",), "fever_flag": ("fiebre", "febril"), "neutropenia_flag": ("neutropenia",), "hypoxemia_flag": ("hipox", "sat")}
#: Fixed value: a fact that stands for a wide QRS and, where no potassium is named, for one of 6.
POTASSIUM_FACT, POTASSIUM_OF_FACT = "logic_rule:nephro_hyperkalemia_critical", 6.0

#: Numbers with units, comparisons, and terms that are facts by themselves.
UNITS = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:mmhg|mg/dl|mmol/l|lpm|%|h|horas|min|ml/kg|cmh2o|ng/ml)\b"
COMPARISONS = r"(?i)(?:>=|<=|>|<)\s*\d+(?:[.,]\d+)?"
SPOKEN = (
    (("rechaza",), "decision:rechazo_tratamiento"),
    (("familiar", "acompan"), "contexto:acompanante_presente"),
    (("consentimiento",), "legal:consentimiento_mencionado"),
    (("alerg",), "seguridad:alergia_reportada"),
)
TERMS = (
    "sepsis", "shock", "scasest", "ictus", "hsa", "cpap", "bipap", "consentimiento", "rechaza", "alergia", "pediatria", "pediatrico", "neonatal", "paciente", "caso", "sospecha",
    "fiebre", "febril", "dolor", "disnea", "taquicardia", "urgencia", "urgencias", "oncologia", "cancer",
)
MOST_FACTS = 16


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    """The number in a group of the first match; null where there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.translate(F.nullif(found, F.lit("")), ",", ".").try_cast("double")


def pain(text: Column) -> tuple[Column, Column]:
    """C17: perceived intensity, of a range's end or of a level, and the perceived step of a range; null where none is named."""
    start, end, level = _number(text, PAIN_RANGE), _number(text, PAIN_RANGE, 2), _number(text, PAIN_LEVEL)
    return F.when(end.isNotNull(), fechner(end)).when(level.isNotNull(), fechner(level)), F.when(end.isNotNull(), F.abs(fechner(end) - fechner(start)))


def decision_risk(text: Column, domain: Column) -> dict[str, Column]:
    """C17: ``intensity, change, risk, level, frame, signals, memory`` of a question of a domain; a null text is empty.

    Each finding adds to the risk, which is 1 at most, and gives a signal, the first eight of which are told.
    """
    text = F.coalesce(text, F.lit(""))
    low = fold(text)
    intensity, change = pain(text)
    systolic, diastolic = _number(text, PRESSURE), _number(text, PRESSURE, 2)
    saturation, potassium = _number(text, SATURATION), _number(text, POTASSIUM)
    severe = (systolic >= 160) | (diastolic >= 110)
    found = [
        (systolic <= 90, 0.45, "hypotension_critical"),
        (severe, 0.35, "hypertension_severe"),
        (saturation <= 91, 0.40, "oxygenation_critical"),
        ((saturation > 91) & (saturation <= 94), 0.20, "oxygenation_warning"),
        (potassium >= 6.0, 0.45, "hyperkalemia_critical"),
        ((potassium < 6.0) & (potassium >= 5.5), 0.25, "hyperkalemia_warning"),
        (intensity >= 0.82, 0.15, "pain_high_perceived_intensity"),
        (change >= 0.18, 0.15, "pain_perceived_worsening"),
        *((F.contains(low, F.lit(w)), 0.08, f"red_flag:{w.replace(' ', '_')}") for w in RED_FLAGS),
        ((domain == "gynecology_obstetrics") & severe, 0.10, "obstetric_hypertensive_priority"),
    ]
    total = sum((F.when(holds, points).otherwise(0.0) for holds, points, _ in found), F.lit(0.0))
    risk = F.round(F.least(F.lit(1.0), total), 9)  # sums of hundredths
    level, frame = (F.when(risk >= LEVELS[0][0], LEVELS[0][i]).when(risk >= LEVELS[1][0], LEVELS[1][i]).otherwise(LEVELS[2][i]) for i in (1, 2))
    signals = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for holds, _, name in found)))
    told = [(F.lit(True), F.concat(F.lit("prospect_frame:"), frame)), (F.lit(True), F.concat(F.lit("prospect_risk:"), level))]
    told += [(x.isNotNull(), F.concat(F.lit(f"fechner_{n}:"), F.format_string("%.3f", x))) for n, x in (("intensity", intensity), ("change", change))]
    memory = F.array_compact(F.array(*(F.when(holds, line) for holds, line in told)))
    return {
        "intensity": F.round(intensity, 3), "change": F.round(change, 3), "risk": F.round(risk, 3), "level": level, "frame": frame, "signals": F.slice(signals, 1, MOST_SIGNALS), "memory": memory,
    }


def question_facts(text: Column) -> Column:
    """A question's numbers with units, comparisons, circumstances and terms, each once in this order, sixteen at most."""
    text = F.coalesce(text, F.lit(""))
    low = fold(text)

    def matches(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(f"{name}:"), F.translate(fold(x), " ", "")))

    def any_of(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    spoken = F.array_compact(F.array(*(F.when(any_of(words), F.lit(fact)) for words, fact in SPOKEN)))
    terms = F.transform(F.filter(F.array(*map(F.lit, TERMS)), lambda w: F.contains(low, w)), lambda w: F.concat(F.lit("termino:"), w))
    return F.slice(F.array_distinct(F.concat(matches("umbral", UNITS), matches("comparador", COMPARISONS), spoken, terms)), 1, MOST_FACTS)


def risk_features(text: Column, facts: Column | None = None) -> dict[str, Column]:
    """The features of a question and, if given, of the facts known of it (an array); numbers that it doesn't name are null."""
    low = fold(F.coalesce(text, F.lit("")))
    told = F.contains(fold(F.concat_ws(" ", facts)), F.lit(POTASSIUM_FACT)) if facts is not None else F.lit(False)
    found = {name: _number(low, pattern) for name, pattern in NAMED.items()}
    for name, words in FLAGGED.items():
        held = F.lit(False)
        for w in words:
            held = held | F.contains(low, F.lit(w))
        if name == "hypoxemia_flag":
            held = held | F.coalesce(_number(low, SATURATED) < LOW_SATURATION, F.lit(False))
        found[name] = F.when(held | told if name == "qrs_wide_flag" else held, 1.0).otherwise(0.0)
    found["potassium"] = F.coalesce(found["potassium"], F.when(told, POTASSIUM_OF_FACT))
    return found


def text_risk(rows: DataFrame, keys: list[str], text: str, facts: str | None = None) -> DataFrame:
    """``keys, missing, probability, priority, anomaly, is_anomalous`` of each row's question.

    Features that are missing take their median; scaled ones are weighed into a logistic probability, and the mean of their sizes tells
    how unusual the row is.
    """
    found = risk_features(F.col(text), F.col(facts) if facts else None)
    named = rows.select(*keys, *(found[n].alias(n) for n in RISK_MODEL))
    scored = logistic_risk(named, RISK_MODEL, RISK_BIAS)
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in RISK_MODEL)))
    priority = F.when(F.col("risk") >= HIGH_RISK, "high").when(F.col("risk") >= MEDIUM_RISK, "medium").otherwise("low")
    return scored.select(*keys, missing.alias("missing"), F.col("risk").alias("probability"), priority.alias("priority"), "anomaly", "is_anomalous")
