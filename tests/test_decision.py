"""Risk and facts of questions, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import decision as D


def at(spark, text, domain="cardio"):
    rows = spark.createDataFrame([(text, domain)], "t string, d string")
    return rows.select(*(c.alias(n) for n, c in D.decision_risk(F.col("t"), F.col("d")).items())).first()


def test_risk(spark):
    r = at(spark, "Dolor 3 a 8/10, TA 85/50, SatO2: 93%")
    step = (math.log1p(8) - math.log1p(3)) / math.log1p(10)
    assert (r["intensity"], r["change"]) == (round(math.log1p(8) / math.log1p(10), 3), round(step, 3))
    assert r["signals"] == ["hypotension_critical", "oxygenation_warning", "pain_high_perceived_intensity", "pain_perceived_worsening"]
    assert r["risk"] == pytest.approx(0.95) and (r["level"], r["frame"]) == ("high", "loss_avoidance_critical")
    assert r["memory"] == ["prospect_frame:loss_avoidance_critical", "prospect_risk:high", f"fechner_intensity:{math.log1p(8) / math.log1p(10):.3f}", f"fechner_change:{step:.3f}"]
    r = at(spark, "tension arterial = 165 / 90 y K 5,6", "gynecology_obstetrics")
    assert r["signals"] == ["hypertension_severe", "hyperkalemia_warning", "obstetric_hypertensive_priority"] and r["risk"] == pytest.approx(0.70)
    r = at(spark, "Convulsión con hemorragia")
    assert r["signals"] == ["red_flag:convulsion", "red_flag:hemorragia"] and (r["risk"], r["level"]) == (0.16, "low") and r["intensity"] is None
    r = at(spark, "dolor intensidad 12, sat 80, k+ 7 y ta 200/120, shock, inestable, anuria, oliguria, fosfenos")
    assert r["risk"] == 1.0 and len(r["signals"]) == 8 and r["intensity"] == 1.0
    assert at(spark, "satisfecho, etapa 90/60")["signals"] == [] and at(spark, None)["level"] == "low" and at(spark, "", None)["risk"] == 0.0


def test_facts(spark):
    texts = ["FC 120 lpm y lactato > 4, PAM <= 65 mmHg en 30 min; Rechaza CPAP, acompañante con alergia. Sepsis, sepsis", "", None, " ".join(f"{i} min" for i in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", D.question_facts(F.col("t")).alias("f")).collect()
    got = {r["i"]: r["f"] for r in rows}
    assert got[0] == ["umbral:120lpm", "umbral:65mmhg", "umbral:30min", "comparador:>4", "comparador:<=65", "decision:rechazo_tratamiento", "contexto:acompanante_presente", "seguridad:alergia_reportada",
                      "termino:sepsis", "termino:cpap", "termino:rechaza", "termino:alergia"]
    assert got[1] == got[2] == [] and got[3] == [f"umbral:{i}min" for i in range(16)]


def test_model_of_risk(spark):
    rows = [
        (1, "TA 90/60, K: 6,5, creatinina act 2.1, oliguria, QRS ancho, fiebre, neutropenia, SatO2 88", None),
        (2, "", []),
        (3, None, ["otra", "logic_rule:nephro_hyperkalemia_critical"]),
        (4, "potasio 5", ["logic_rule:nephro_hyperkalemia_critical"]),
    ]
    frame = spark.createDataFrame(rows, "id long, q string, facts array<string>").withColumn("risk", F.lit("clash"))
    got = {r["id"]: r for r in D.text_risk(frame, ["id"], "q", "facts").collect()}
    values = {1: (90, 6.5, 2.1, 1, 1, 1, 1, 1), 2: (118, 4.1, 1.0, 0, 0, 0, 0, 0), 3: (118, 6.0, 1.0, 0, 1, 0, 0, 0), 4: (118, 5.0, 1.0, 0, 1, 0, 0, 0)}
    for i, own in values.items():
        z = [(v - mean) / dev for v, (_, mean, dev, _) in zip(own, D.RISK_MODEL.values())]
        linear = D.RISK_BIAS + sum(w * x for x, (*_, w) in zip(z, D.RISK_MODEL.values()))
        assert got[i]["probability"] == pytest.approx(1 / (1 + math.exp(-linear)))
        assert got[i]["anomaly"] == pytest.approx(sum(map(abs, z)) / 8)
    assert got[1]["missing"] == [] and got[1]["priority"] == "high" and got[1]["is_anomalous"]
    assert got[2]["missing"] == ["systolic_bp", "potassium", "creatinine"] and got[2]["priority"] == "low"
    assert got[3]["missing"] == ["systolic_bp", "creatinine"]
