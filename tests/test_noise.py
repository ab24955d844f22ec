"""Noise and clean snippets, by hand."""

from pyspark.sql import functions as F

from sparkloom.operators import noise as N

GOOD = "Una linea sobre el manejo de la sepsis grave"


def test_noisy_lines_and_sources(spark):
    lines = {"": True, "  ": True, GOOD: False, "pip install sepsis en el servidor central": True, "solo letras pocas": True, "Documento: manejo de la sepsis grave": True, "ÁÉÍÓÚ ñandú ñandú áéíóú": False, "123 456 789 012 345 678": True}
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", N.noisy_line(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in rows} == lines
    sources = {"docs/39_a.md": True, "docs/40_a.md": False, "docs/86_a.md": False, "docs/87_a.md": True, "Docs\\Decisions\\x.md": True, "other/1_a.md": False, "": False, "docs/99999999999999999999_x": True, "x/roadmap.md": True}
    rows = spark.createDataFrame([(x,) for x in [*sources, None]], "x string").select("x", N.noisy_source(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in rows} == sources | {None: False}


def test_noisy_chunks_go_unless_all_do(spark):
    noise = "\n".join(["git status"] * 8)
    rows = [(1, 1, GOOD), (1, 2, noise), (1, 3, noise + "\n" + GOOD), (1, 4, "x\n" + GOOD), (2, 5, noise), (2, 6, None), (None, 7, GOOD)]
    frame = spark.createDataFrame(rows, "q long, c long, text string").withColumn("noise", F.lit("clash"))
    got = {(r["c"], r["fell_back"]) for r in N.drop_noisy(frame, "q", "text").collect()}
    assert got == {(1, False), (4, False), (5, True), (6, True), (7, False)}  # of 3 only the first eight lines count
    assert N.drop_noisy(frame.limit(0), "q", "text").collect() == []


def test_clean_snippets(spark):
    texts = [
        f"git pull\n  {GOOD}   y  algo \r\ncurl x\n{GOOD}",
        f"{GOOD} en docs/40_motor.md) y C:\\notes\\old\\plan.pdf o /a/b/c.txt fin",
        "corto  \n  y   solo",
        f"{GOOD}\n" * 20,
        "",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.clean_snippet(F.col("t"), 100).alias("s")).collect()
    got = {r["i"]: r["s"] for r in rows}
    assert got[0] == f"{GOOD} y algo {GOOD}"[:100]
    assert got[1] == f"{GOOD} en ) y o fin"
    assert got[2] == "corto y solo" and got[4] == "" and not got[5]
    assert got[3] == " ".join([GOOD] * 3)[:100]
